import pytest

from scholia.operators.markers import markers_of

SCHEMA = "text string, line int, multiline boolean, start_tok string, end_tok string"


def found(spark, text, start="//", end=None, **options):
    df = spark.createDataFrame([(text, 5, end is not None, start, end)], SCHEMA)
    return [(r.type, r.label, r.message, r.line) for r in markers_of(df, **options).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("// TODO is a function.", []),
        ("// TODO foo", []),
        ("//TODO foo", [("TODO", "", "foo", 5)]),
        ("//TODOfoo", [("TODO", "", "foo", 5)]),
        ("//WARNING: x", [("WARN", "", "ING: x", 5)]),
        ("// WARNING: x", [("WARNING", "", "x", 5)]),
        ("//bugfix later", [("bug", "", "fix later", 5)]),
        ("// hack/make-rules/x", []),
        ("// TODO-foo", []),
        ("// TODO(a): foo (bar)", [("TODO", "a): foo (bar", "", 5)]),
        ("// TODO(a) - foo", [("TODO", "a", "foo", 5)]),
        ("// TODO(a) / foo", [("TODO", "a", "foo", 5)]),
        ("// TODO(a) foo", [("TODO", "a", "foo", 5)]),
        ("//// TODO: x", [("TODO", "", "x", 5)]),
        ("// @TODO: x", [("TODO", "", "x", 5)]),
        ("// TODO", [("TODO", "", "", 5)]),
        ("// TODO: x ", [("TODO", "", "x", 5)]),
        (None, []),
        ("", []),
    ],
)
def test_line(spark, text, expected):
    assert found(spark, text) == expected


def test_block(spark):
    assert found(spark, "/**\n * TODO: a\n * @todo(b): c\n */", "/*", "*/") == [("TODO", "", "a", 6), ("todo", "b", "c", 7)]
    assert found(spark, "=begin\nTODO: needed\n=end", "=begin", "=end") == [("TODO", "", "", 6)]
    assert found(spark, "=pod\nTODO: fix output\n=cut", "=", "=cut") == [("TODO", "", "fix outp", 6)]
    assert found(spark, "=begin\nbug: x\n=end", "=begin", "=end") == []


def test_types_and_labels(spark):
    assert found(spark, "// NOTE(a/b): x", types=["NOTE"], labels=["a*"]) == [("NOTE", "a/b", "x", 5)]
    assert found(spark, "// NOTE(a/b): x", types=["NOTE"], labels=["b*"]) == []
    assert found(spark, "// TODO: x", types=[""]) == []
    assert found(spark, "// A.B: x", types=["A.B"]) == [("A.B", "", "x", 5)] and found(spark, "// AxB: x", types=["A.B"]) == []
