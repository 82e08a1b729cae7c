"""Items of varying size in containers of fixed capacity, by multiway differencing.

Items are dealt to blocks by a hash of their row, each block worth about ``WINDOWS`` containers.
Inside a block the largest differencing method (Karmarkar and Karp, generalised to k sets) runs: every
item starts as a partial partition of its own; the two partitions with the largest imbalance are
merged with their sums in opposite order, until one is left. It evens sums out but knows no
capacity, so some sets are above it. Such a set is then differenced again together with one or two
sets below it, whose imbalance is opposed to its own; where no such group fits, the number of
containers rises. Every set comes out of differencing; no item is moved by itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.tables import materialize

#: Containers and rows a block is laid out for; both bound what one task holds.
WINDOWS, ROWS = 128, 20_000
#: Groups of three sets that are tried for one set above the capacity before the number of containers rises.
TRIES = 20


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers needed at least: by volume, and by items of which no two fit together."""
    ordered = np.sort(sizes)
    below = np.concatenate(([0], np.cumsum(ordered)))
    lows = np.append(np.unique(ordered[ordered * 2 <= capacity]), capacity // 2 + 1)
    # Beside an item above the capacity less ``low`` nothing of ``low`` or more fits.
    large = np.searchsorted(ordered, capacity - lows, side="right")
    half = int(np.searchsorted(ordered, capacity // 2, side="right"))
    first = np.minimum(np.searchsorted(ordered, lows, side="left"), half)
    n_middle = large - half
    rest = below[half] - below[first] - (n_middle * capacity - (below[large] - below[half]))
    most = int((len(ordered) - half + np.maximum(0, -(-rest // capacity))).max())
    return max(most, -(-int(below[-1]) // capacity), 1)


def difference(sizes: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """The largest sum, and the set (0 to k-1) of each item, of a partition into at most ``k`` sets."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    spread = lambda s: int(s[0] - (s[-1] if len(s) == k else 0))
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = np.array([sizes[i]])
        heap.append((-spread(s), len(heap), s, np.array([i])))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        shared = len(a) + len(b) - k
        if shared > 0:
            # Smallest sums of one meet largest of the other as far as there are not enough free sets.
            over_a, over_b = a_nodes[len(a) - shared :], b_nodes[len(b) - shared :][::-1]
            fresh = np.arange(len(left), len(left) + shared)
            left.extend(over_a.tolist())
            right.extend(over_b.tolist())
            sums = np.concatenate((a[: len(a) - shared], a[len(a) - shared :] + b[len(b) - shared :][::-1], b[: len(b) - shared]))
            nodes = np.concatenate((a_nodes[: len(a) - shared], fresh, b_nodes[: len(b) - shared]))
        else:
            sums, nodes = np.concatenate((a, b)), np.concatenate((a_nodes, b_nodes))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-spread(sums), turn, sums, nodes))
        turn += 1
    _, _, sums, nodes = heap[0]
    group = np.zeros(n, dtype=np.int64)
    for g, node in enumerate(nodes.tolist()):
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                group[x] = g
            else:
                todo += (left[x], right[x])
    return int(sums[0]), group


def difference_few(sizes: list[int], k: int) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, items) of ``k`` sets, largest sum first: the same method for a handful of items."""
    heap = [(-n, i, ((n, (i,)), *((0, ()),) * (k - 1))) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))], reverse=True)
        heapq.heappush(heap, (both[-1][0] - both[0][0], turn, both))
        turn += 1
    return list(heap[0][2])


def _largest_sum(sizes: list[int], k: int) -> int:
    """The largest sum that ``difference_few`` leaves; most groups are only asked for that."""
    heap = [(-n, i, [n] + [0] * (k - 1)) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    pop = heapq.heappop
    while len(heap) > 1:
        a, b = pop(heap)[2], pop(heap)[2]
        b.reverse()
        both = [x + y for x, y in zip(a, b)]
        both.sort(reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], turn, both))
        turn += 1
    return heap[0][2][0]


def fit(sizes: np.ndarray, group: np.ndarray, k: int, capacity: int, tries: int = TRIES) -> tuple[np.ndarray, int]:
    """(set of each item, items differenced again): the sets of a partition brought under the capacity.

    A set above the capacity is differenced again with one set below it, the fullest first, then
    with two, until a group fits; a set for which no group does gets an empty one beside it. Two
    sets suffice for that, as no item exceeds the capacity.
    """
    order = np.argsort(group, kind="stable")
    sets = [s.tolist() for s in np.split(order, np.cumsum(np.bincount(group, minlength=k))[:-1])]
    size = sizes.tolist()
    sums = [sum(size[i] for i in s) for s in sets]
    version = list(range(k))
    turn, failed, again = k, set(), set()

    def possible(which: tuple[int, ...]) -> bool:
        """Whether some items of the sets fill one container so far that the rest may fit in the others: a bit for each sum they can have."""
        reach, rest = 1, sum(sums[g] for g in which) - (len(which) - 1) * capacity
        for g in which:
            for i in sets[g]:
                reach |= reach << size[i]
        return rest <= 0 or (reach >> rest) & ((1 << capacity - rest + 1) - 1) != 0

    def redo(which: tuple[int, ...]) -> bool:
        nonlocal turn
        key = tuple(version[g] for g in which)
        if key in failed:
            return False
        if not possible(which):
            failed.add(key)
            return False
        items = [i for g in which for i in sets[g]]
        own = [size[i] for i in items]
        if _largest_sum(own, len(which)) > capacity:
            failed.add(key)
            return False
        found = difference_few(own, len(which))
        for g, (total, own) in zip(which, found):
            sets[g], sums[g], version[g] = [items[i] for i in own], total, turn
            turn += 1
        again.update(items)
        return True

    def settle(g: int) -> bool:
        below = sorted((h for h in range(len(sets)) if sums[h] <= capacity), key=lambda h: -sums[h])
        if any(redo((g, h)) for h in below if sums[g] + sums[h] <= 2 * capacity):
            return True
        left = tries
        below.reverse()
        for at, h in enumerate(below):
            for other in below[at + 1 :]:
                if sums[g] + sums[h] + sums[other] > 3 * capacity:
                    break
                if not left:
                    return False
                left -= 1
                if redo((g, h, other)):
                    return True
        return False

    while over := sorted((g for g, n in enumerate(sums) if n > capacity), key=lambda g: -sums[g]):
        if not sum([settle(g) for g in over]):
            sets.append([])
            sums.append(0)
            version.append(turn)
            turn += 1
    out = np.empty(len(sizes), dtype=np.int64)
    for g, own in enumerate(sets):
        out[own] = g
    return out, len(again)


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; no item may exceed the capacity. Items of size zero go to container 0.

    Differencing begins with the lower bound of containers.
    """
    group = np.zeros(len(sizes), dtype=np.int64)
    real = np.flatnonzero(sizes > 0)
    if len(real):
        k = min(lower_bound(sizes[real], capacity), len(real))
        most, found = difference(sizes[real], k)
        group[real] = found if most <= capacity else fit(sizes[real], found, k, capacity)[0]
    return group


def pack(sizes: DataFrame, capacities: dict[int, int], id_col: str, size_col: str = "n_tokens") -> DataFrame:
    """(limit_id, container, id, piece, start, size): every item in a container of each capacity.

    An item above the capacity, and only such a one, is cut: into full pieces, each alone in its
    container, and a rest that is packed like any other item; ``start`` is the offset of a piece.
    Items of size zero, and of null size, take part with size zero, so that every row comes out.
    Repeated rows, and rows whose id is null, are items of their own, spread over blocks like any
    others; an empty table gives an empty result. ``container`` is unique within a limit.
    """
    each = sizes.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    # Written once, so that rows keep their numbers and sizes are not counted again.
    each = materialize(each)
    # What is left to pack when full pieces are cut off decides how many blocks there are.
    left = {c: F.coalesce(F.sum(F.when(F.col("n") > c, F.col("n") % c).otherwise(F.col("n"))), F.lit(0)).alias(str(c)) for c in set(capacities.values())}
    found = each.agg(F.count(F.lit(1)).alias("rows"), *left.values()).first()
    blocks = {c: max(1, round(found[str(c)] / (c * WINDOWS)), found["rows"] // ROWS) for c in left}
    limits = F.explode(F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("bigint").alias("cap"), F.lit(blocks[c]).cast("bigint").alias("blocks")) for i, c in sorted(capacities.items()))))
    each = each.withColumn("l", limits).select("row", "id", "n", "l.limit_id", "l.cap", F.pmod(F.xxhash64("row", "l.limit_id"), F.col("l.blocks")).alias("block"))
    n_full = F.when(F.col("n") > F.col("cap"), F.floor(F.col("n") / F.col("cap"))).otherwise(0)
    pieces = F.sequence(F.lit(0).cast("bigint"), n_full - F.when((n_full > 0) & (F.col("n") % F.col("cap") == 0), 1).otherwise(0))
    cut = each.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * F.col("cap")).withColumn("size", F.least(F.col("n") - F.col("start"), F.col("cap")))
    full = (F.col("size") == F.col("cap")) & (F.col("n") > F.col("cap"))
    id_type = each.schema["id"].dataType.simpleString()

    def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row", "piece"], ascending=[False, True, True], kind="stable")
        found = pack_block(pdf["size"].to_numpy(np.int64), int(pdf["cap"].iloc[0]))
        container = f"b{pdf['block'].iloc[0]}." + pd.Series(found, index=pdf.index).astype(str)
        return pd.DataFrame({"limit_id": pdf["limit_id"], "container": container, "id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "size": pdf["size"]})

    # Full pieces fill a container each without looking at others.
    alone = cut.where(full).select("limit_id", F.concat(F.lit("r"), F.col("row"), F.lit("."), F.col("piece")).alias("container"), "id", "piece", "start", "size")
    together = cut.where(~full).groupBy("limit_id", "block").applyInPandas(lay_out, f"limit_id int, container string, id {id_type}, piece bigint, start bigint, size bigint")
    return together.unionByName(alone).withColumnRenamed("id", id_col)
