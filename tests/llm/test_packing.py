import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm.packing import _largest_sum, difference, difference_few, fit, lower_bound, pack, pack_block


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_blocks(sizes):
    sizes = np.array(sizes)
    group = pack_block(sizes, 100)
    sums = np.bincount(group, weights=sizes)
    assert sums.max() <= 100 and lower_bound(sizes, 100) <= (sums > 0).sum() <= len(sizes)
    most, parts = difference(sizes, 5)
    assert most == np.bincount(parts, weights=sizes).max() and parts.max() < 5


def test_little_space_is_left():
    sizes = np.random.RandomState(1).randint(1, 60, 1000)
    used = len(set(pack_block(sizes, 100).tolist()))
    assert used <= 1.02 * lower_bound(sizes, 100)


def test_sets_come_out_of_differencing():
    sizes = np.sort(np.random.RandomState(2).randint(1, 250, 400))[::-1].copy()
    k = lower_bound(sizes, 300)
    most, found = difference(sizes, k)
    group, again = fit(sizes, found, k, 300)
    # Sets that fit from the start, or were never asked to help, are as differencing left them.
    same = {frozenset(np.flatnonzero(found == g)) for g in range(k)} & {frozenset(np.flatnonzero(group == g)) for g in range(group.max() + 1)}
    assert most > 300 and again == len(sizes) - sum(map(len, same)) < len(sizes)
    # One set above the capacity and one below become what differencing makes of their items.
    group, again = fit(np.array([60, 50, 40, 30]), np.array([0, 0, 1, 1]), 2, 100)
    assert again == 4 and sorted(np.bincount(group, weights=[60, 50, 40, 30])) == [90, 90]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(2, 4))
def test_few_items_as_many(sizes, k):
    sums = [n for n, _ in difference_few(sizes, k)]
    assert sums == sorted(sums, reverse=True) and sums[0] == _largest_sum(sizes, k) == difference(np.array(sizes), k)[0]
    assert sorted(i for _, own in difference_few(sizes, k) for i in own) == list(range(len(sizes)))


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, 25), (1, 25), (None, 25), (None, 25), (None, None)], "doc_id bigint, n_tokens bigint")
    fill = {}
    for r in pack(df, {1: 10}, "doc_id").collect():
        fill[r.container] = fill.get(r.container, 0) + r["size"]
    assert max(fill.values()) == 10 and sum(fill.values()) == 100


def test_differencing_balances():
    most, _ = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert most == 16  # the classic example: differencing gives 16 against 14
    most, _ = difference(np.full(64, 3), 8)
    assert most == 24


def test_table(spark):
    rows = [(1, 10), (2, 25), (3, 0), (4, None), (5, 20), (6, 7), (6, 7), (7, 3)] + [(100 + i, i % 10) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as container", "2 as size", "3 as block")
    got = pack(df, {1: 10, 2: 50}, "doc_id").collect()
    for limit, capacity in ((1, 10), (2, 50)):
        own = [r for r in got if r.limit_id == limit]
        fill = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r["size"]
        assert max(fill.values()) <= capacity
        total = {}
        for r in own:
            total[r.doc_id] = total.get(r.doc_id, 0) + r["size"]
        assert total == {i: sum(n or 0 for j, n in rows if j == i) for i, _ in rows}
    pieces = sorted((r.piece, r.start, r["size"]) for r in got if r.limit_id == 1 and r.doc_id == 2)
    assert pieces == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sorted((r.piece, r["size"]) for r in got if r.limit_id == 1 and r.doc_id == 5) == [(0, 10), (1, 10)]
    assert [r.piece for r in got if r.limit_id == 2 and r.doc_id == 2] == [0]
    assert pack(df.limit(0), {1: 10}, "doc_id").count() == 0
