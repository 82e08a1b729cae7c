"""Frequency of every term and term sequence, by counting over sorted suffixes.

Each field value is a sequence of terms. Equal values are first counted together, so a value that
a third of all rows share is one row from here on. Every distinct value then gives its suffixes,
cut to ``max_n`` terms and weighted with the number of rows of the value. Suffixes are routed by
their first term and a salt taken from the value, sorted in reverse lexicographic order, and one
pass with a stack of at most ``max_n`` entries sums up the counts of all their prefixes. Counts
of the salts are added at the end.

The record set of a term sequence needs no set of ids: a suffix carries the length of its shortest
prefix that is new in its record (longer prefixes are new too), and only prefixes from that length
on count the record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of label terms: comma, semicolon, vertical bar and Unicode white space.
SEPARATORS = r"[,;|\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_PARTIAL = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("occurrences", T.LongType()),
        T.StructField("records", T.LongType()),
    ]
)


def split_terms(column: Column) -> Column:
    """Lower-case pieces of ``column`` between separators; empty for a null or blank value."""
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), SEPARATORS), lambda x: x != "")


def whole_value(column: Column) -> Column:
    """The value itself as the only term; none for a null or empty value."""
    return F.when(column.isNull() | (column == ""), F.array().cast("array<string>")).otherwise(F.array(column))


_SUFFIX = "field string, first string, suffix array<string>, weight bigint, fresh int, salt int"


def _suffixes(values: DataFrame, max_n: int, salts: int) -> DataFrame:
    """The suffixes of each value, cut to ``max_n`` terms, and from which length on their prefixes are new in the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[tuple] = []
            for field, terms, weight, salt in zip(*(batch.column(i).to_pylist() for i in range(4))):
                seen: set[tuple[str, ...]] = set()
                for p, first in enumerate(terms):
                    suffix = terms[p : p + max_n]
                    fresh = next((k for k in range(1, len(suffix) + 1) if tuple(suffix[:k]) not in seen), len(suffix) + 1)
                    seen.update(tuple(suffix[:k]) for k in range(fresh, len(suffix) + 1))
                    out.append((field, first, suffix, weight, fresh, salt))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["field", "first", "suffix", "weight", "fresh", "salt"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], ["field", "first", "suffix", "weight", "fresh", "salt"])

    # Chosen by the value, so that all its suffixes with the same first term meet.
    salt = F.pmod(F.xxhash64("terms"), F.lit(salts)).cast("int").alias("salt")
    return values.select("field", "terms", F.col("weight").cast("long"), salt).mapInArrow(run, _SUFFIX)


def _stack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the prefixes of suffixes that come in reverse lexicographic order of (field, suffix)."""
    field, terms, occurrences, records = None, [], [], []
    out: list[tuple[str, list[str], int, int]] = []

    def pop_to(depth: int) -> None:
        while len(terms) > depth:
            n, r = occurrences.pop(), records.pop()
            out.append((field, terms[:], n, r))
            terms.pop()
            if terms:
                occurrences[-1] += n

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.list_(pa.string())),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
            ],
            ["field", "terms", "occurrences", "records"],
        )

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(4))
        for this, suffix, weight, fresh in zip(*columns):
            if this != field:
                pop_to(0)
                field = this
            common, most = 0, min(len(terms), len(suffix))
            while common < most and terms[common] == suffix[common]:
                common += 1
            pop_to(common)
            for term in suffix[common:]:
                terms.append(term)
                occurrences.append(0)
                records.append(0)
            occurrences[-1] += weight
            for k in range(fresh - 1, len(suffix)):
                records[k] += weight
        if len(out) > 20_000:
            yield flush()
    pop_to(0)
    yield flush()


def count_terms(df: DataFrame, fields: dict[str, Column], max_n: int = 3, salts: int | None = None) -> DataFrame:
    """Count every sequence of up to ``max_n`` terms in each field.

    ``fields`` maps a field's name to a column of type array<string>: the record's terms in order.
    Returns (field, terms, occurrences, records): how often the sequence occurs and in how many
    records. A term that begins a large share of the distinct values is spread over ``salts`` tasks,
    by default as many as a shuffle has partitions. Null values, null terms and empty arrays count nothing; an empty table gives an empty
    result; other columns of ``df`` are never read.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if salts is None else salts
    if max_n < 1 or salts < 1:
        raise ValueError("max_n and salts must be at least 1")
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), terms.alias("terms")) for name, terms in fields.items())))
    values = (
        df.select(pairs.alias("v"))
        .select("v.field", F.filter("v.terms", lambda x: x.isNotNull()).alias("terms"))
        .where(F.size("terms") > 0)
        .groupBy("field", "terms")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    routed = _suffixes(values, max_n, salts).repartition("field", "first", "salt").sortWithinPartitions(F.desc("field"), F.desc("suffix"))
    partial = routed.select("field", "suffix", "weight", "fresh").mapInArrow(_stack_counts, _PARTIAL)
    return partial.groupBy("field", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """Single terms of ``counts`` with a ``mark``: ``rare``, ``common`` or null."""
    return counts.where(F.size("terms") == 1).select(
        "field",
        F.col("terms")[0].alias("term"),
        "occurrences",
        "records",
        F.when(F.col("records") > common_share * n_records, "common").when(F.col("records") < rare_below, "rare").alias("mark"),
    )
