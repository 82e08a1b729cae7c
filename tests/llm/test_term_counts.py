from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import term_counts


def brute(records, max_n):
    occurrences, records_with = Counter(), Counter()
    for terms in records:
        grams = [tuple(terms[i : i + k]) for i in range(len(terms)) for k in range(1, max_n + 1) if i + k <= len(terms)]
        occurrences.update(grams)
        records_with.update(set(grams))
    return {g: (occurrences[g], records_with[g]) for g in occurrences}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=12), st.integers(1, 4))
def test_counts_against_brute_force(spark, records, max_n):
    df = spark.createDataFrame([(r,) for r in records], "v array<string>")
    got = {tuple(r.terms): (r.occurrences, r.records) for r in term_counts.count_terms(df, {"f": F.col("v")}, max_n, 3).collect()}
    assert got == brute(records, max_n)


def test_labels_and_types(spark):
    rows = [("infra, INFRA", "TODO"), ("infra", "Todo"), (None, None), ("", ""), (" ; | ", "TODO"), ("x　y", "TODO")]
    df = spark.createDataFrame(rows, "label string, type string").withColumns({"field": F.lit(1), "terms": F.lit(2), "weight": F.lit(3)})
    counts = term_counts.count_terms(df, {"label": term_counts.split_terms(F.col("label")), "type": term_counts.whole_value(F.col("type"))}, 1)
    got = {(r.field, r.terms[0]): (r.occurrences, r.records) for r in counts.collect()}
    assert got == {("label", "infra"): (3, 2), ("label", "x"): (1, 1), ("label", "y"): (1, 1), ("type", "TODO"): (3, 3), ("type", "Todo"): (1, 1)}
    marks = {r.term: r.mark for r in term_counts.mark_terms(counts, 6).collect()}
    assert marks["infra"] == "common" and marks["x"] == "common"
    assert {r.term: r.mark for r in term_counts.mark_terms(counts, 140).collect()} == {"infra": "rare", "x": "rare", "y": "rare", "TODO": "common", "Todo": "rare"}
    assert term_counts.count_terms(df.limit(0), {"label": term_counts.split_terms(F.col("label"))}).count() == 0


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("a b a")).otherwise(F.concat(F.lit("a "), F.col("id").cast("string"))).alias("v"))
    got = {tuple(r.terms): (r.occurrences, r.records) for r in term_counts.count_terms(df, {"f": term_counts.split_terms(F.col("v"))}, 2).collect()}
    assert got["a",] == (5000, 3000) and got["a", "b"] == (2000, 2000) and len(got) == 1 + 1 + 2 + 2 * 1000
