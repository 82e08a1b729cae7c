"""Records that differ only in layout, collapsed through dictionary-encoded columns.

Messages are canonicalised: name-value fields are taken out, letter case is folded and everything
but letters and digits is dropped. The canonical rest, each field and the type become integer
identifiers; a record becomes the sorted tuple of these integers, and only such tuples are
grouped. Identifiers are hashes (128 bits of the rest, 64 of a field or type), so the dictionary needs no
coordination between executors. Where messages repeat, each distinct one is canonicalised once and
joined back by its identifier; where nearly all differ, a dictionary would hold nearly as many
rows as the table, so they are canonicalised where they are read and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.plans.tables import materialize

#: Names of the fields a message may hold; part of the problem's statement.
FIELD_NAMES = ("area", "owner", "prio", "due", "size")

#: Share of distinct messages from which on a dictionary of them is not worth its shuffles.
DISTINCT_SHARE = 0.5

_ITEM = r"(?i)(?<![\p{L}\p{N}_])(?:%s)[\s\p{Z}]*[=:][\s\p{Z}]*[\p{L}\p{N}]+(?:[-_./+][\p{L}\p{N}]+)*"
_DROP = r"(?<!\p{Nd})[^\p{L}\p{N}]|[^\p{L}\p{N}](?!\p{Nd})|[\s\p{Z}\p{C}]"


def _fold(column: Column) -> Column:
    """Upper case: the one case that joins sharp s with SS and dotless i with i; the dotted capital I is joined too."""
    return F.replace(F.upper(column), F.lit("İ"), F.lit("I"))


def _letters_and_digits(column: Column) -> Column:
    """Folded letters and digits, and a single mark that stands between two digits."""
    return F.regexp_replace(_fold(column), _DROP, "")


def with_tuples(df: DataFrame, message: str, names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """``df`` with its column ``message`` replaced by ``tuple``: one integer per field, sorted, then the two halves of the rest's identifier.

    Rows with a message in which nothing counts (punctuation only) are left out.
    """
    pattern = _ITEM % "|".join(names)
    kept = [c for c in df.columns if c != message]
    m, has = F.col(message), F.col("has")
    # Scanning twice for items is only worth it for the messages that have any.
    df = df.withColumn("has", F.lower(m).rlike("(?:%s)[\\s\\p{Z}]*[=:]" % "|".join(names)))
    items = F.when(has, F.regexp_extract_all(m, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = _letters_and_digits(F.when(has, F.regexp_replace(m, pattern, " ")).otherwise(m))
    # A generator between, so that the condition below is not pushed under these expressions and evaluates them again.
    df = df.select(*kept, F.inline(F.array(F.struct(items.alias("items"), rest.alias("rest")))))
    df = df.where((F.length("rest") > 0) | (F.size("items") > 0))

    def code(item: Column) -> Column:
        name = _fold(F.regexp_extract(item, r"^\w+", 0))
        number = F.lit(0)
        for i, n in enumerate(names, 1):
            number = F.when(name == n.upper(), i).otherwise(number)
        return F.xxhash64(number, _letters_and_digits(F.regexp_replace(item, r"^\w+[\s\p{Z}]*[=:]", "")))

    codes = F.when(F.size("items") > 0, F.array_sort(F.transform("items", code))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*kept, F.concat(codes, F.array(F.xxhash64("rest"), F.xxhash64(F.lit("rest"), "rest"))).alias("tuple"))


def record_keys(df: DataFrame, id_col: str, type_col: str, message_col: str, share: float | None = None) -> DataFrame:
    """(id, key_hi, key_lo) of each record in which something counts; records with nothing are left out.

    ``share`` is that of distinct messages, counted (approximately, in one pass) if not given; it
    decides where messages are canonicalised, not what comes out.
    """
    records = df.select(F.col(id_col).alias("id"), F.upper(F.coalesce(F.col(type_col), F.lit(""))).alias("t"), F.col(message_col).alias("m")).where(
        F.col("m").isNotNull() & (F.col("m") != "")
    )
    if share is None:
        share = records.agg(F.try_divide(F.approx_count_distinct("m"), F.count(F.lit(1)))).first()[0] or 0.0
    if share > DISTINCT_SHARE:
        each = with_tuples(records, "m")
    else:
        mid = [F.xxhash64("m").alias("m_hi"), F.xxhash64(F.lit("message"), "m").alias("m_lo")]
        dictionary = with_tuples(records.select("m").distinct().select("m", *mid), "m")
        each = records.select("id", "t", *mid).join(dictionary, ["m_hi", "m_lo"])
    whole = F.concat(F.array(F.xxhash64("t")), F.col("tuple"))
    return each.select("id", F.xxhash64(whole).alias("key_hi"), F.xxhash64(F.lit("record"), whole).alias("key_lo"))


def _group_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key_hi", "key_lo").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collapse_copies(df: DataFrame, id_col: str = "task_id", type_col: str = "type", message_col: str = "message") -> DataFrame:
    """One row per group of copies: (first_id, copies).

    Types are equal regardless of case, a null type equals an empty one. Records whose message is
    null, empty or holds only punctuation form no group and are not listed. Repeated rows count as
    copies. An empty table gives an empty result; other columns are never read.
    """
    return _group_sizes(record_keys(df, id_col, type_col, message_col)).select("first_id", "copies")


def link_copies(df: DataFrame, id_col: str = "task_id", type_col: str = "type", message_col: str = "message") -> DataFrame:
    """(first_id, id) for each record that is a copy of an earlier one; same rules as ``collapse_copies``.

    Group sizes are pre-aggregated before the shuffle; the join back to the records sees one row
    per group, so a group that holds a third of all rows is split by the skew join of AQE.
    """
    keys = materialize(record_keys(df, id_col, type_col, message_col))
    groups = _group_sizes(keys).where("copies > 1").drop("copies")
    return keys.join(groups.hint("shuffle_merge"), ["key_hi", "key_lo"]).where("id > first_id").select("first_id", F.col("id").alias(id_col)).distinct()
