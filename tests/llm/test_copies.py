from scholia.llm import copies

SCHEMA = "task_id bigint, type string, message string, m string, t string, id int"


def links(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash", "clash", 7) for i, r in enumerate(rows, 1)], SCHEMA)
    return {tuple(r) for r in copies.link_copies(df).collect()}


def test_layout_does_not_matter(spark):
    rows = [
        ("TODO", "Fix the parser {area: cli, prio: 2}"),
        ("todo", "fix  the　PARSER -- PRIO:2,AREA:Cli"),
        ("Todo", "(fix_the parser?!) [prio=2; area=cli]"),
        ("FIXME", "Fix the parser {area: cli, prio: 2}"),
        ("TODO", "Fix the parser {area: cli, prio: 3}"),
        ("TODO", "Fix the parser {area: 2, prio: cli}"),
        ("TODO", "fix the parser"),
    ]
    assert links(spark, rows) == {(1, 2), (1, 3)}


def test_digits_and_letters(spark):
    rows = [("A", "since v5.8"), ("A", "since v58"), ("A", "SINCE V5.8!"), ("A", "since v5-8"), ("A", "straße"), ("A", "STRASSE"), ("A", "satır"), ("A", "SATIR"), ("A", "size 5 of 6"), ("A", "size=5 of 6")]
    assert links(spark, rows) == {(1, 3), (5, 6), (7, 8)}


def test_nulls_empty_and_repeated(spark):
    rows = [("A", None), ("A", None), ("A", ""), ("A", ""), ("A", "..."), ("A", "!"), (None, "x"), ("", "x"), (None, "x"), ("A", "prio=1"), ("A", "PRIO: 1"), ("A", "y" * 50_000), ("A", "Y" * 50_000)]
    assert links(spark, rows) == {(7, 8), (7, 9), (10, 11), (12, 13)}
    assert links(spark, [("A", "x")] * 4) == {(1, 2), (1, 3), (1, 4)}
    df = spark.createDataFrame([], SCHEMA)
    assert copies.link_copies(df).count() == 0 and copies.collapse_copies(df).count() == 0


def test_both_ways_give_the_same(spark):
    rows = [(i, "A", f"fix {i % 7} {'prio=1' if i % 2 else 'PRIO: 1'} {'!' * (i % 3)}") for i in range(60)] + [(60, None, "..."), (61, "a", "fix 3 prio=1")]
    df = spark.createDataFrame(rows, "task_id bigint, type string, message string")
    ways = [sorted(map(tuple, copies.record_keys(df, "task_id", "type", "message", share).collect())) for share in (0.0, 1.0, None)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 61 and len({k[1:] for k in ways[0]}) == 7


def test_collapse_counts(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "a", "X."), (3, "A", "z"), (4, "A", None)], "task_id bigint, type string, message string")
    assert sorted(map(tuple, copies.collapse_copies(df).collect())) == [(1, 2), (3, 1)]
