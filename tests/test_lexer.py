import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from scholia.functions.langs import LANGUAGES, language_of, rules_of
from scholia.operators.lexer import comments_of, scan
from scholia.plans.queries import QUERIES


def comments(language, text):
    return [(t.text, t.line) for t in scan(text, LANGUAGES[language]) if t.kind != "string"]


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("OCaml", "(* a (* b *)*) x (* c *) ", []),
        ("OCaml", "(* a (* b *) *) x (* c *) ", [("(* a (* b *) *)", 1), ("(* c *)", 1)]),
        ("Elixir", "x\n# TODO: x", []),
        ("Elixir", "x\n# TODO: x\n12345678", [("# TODO: x", 2)]),
        ("C", 'x = "\\\\" // TODO: a\ny', []),
        ("C", "/* a\n// b\n", []),
        ("C", '// a\n"x\n// b\n', [("// a", 1)]),
        ("C", "// a\r\n// b", [("// a", 1), ("// b", 2)]),
        ("C", "// a\r", [("// a\r", 1)]),
        ("Ruby", "''=begin\nx\n=end\nzzzzzzzz", [("=begin\nx\n=end", 1)]),
        ("Ruby", " =begin\nx\n=end\nzzzzzzzz", []),
        ("Vim Script", '" a\nlet x = "b" " c\n', [('" a', 1), ('" c', 2)]),
        ("SQL", "'it''s' -- x\n", [("-- x", 1)]),
        ("Perl", "=pod\nx\n=cut\n# y\n", [("=pod\nx\n=cut", 1), ("# y", 4)]),
        ("CODEOWNERS", "a # b\n  # c\n", [("# c", 2)]),
        ("Python", '"""a\nb"""\n# c', [('"""a\nb"""', 1), ("# c", 3)]),
        ("Pascal", "{ a } (* b *) // c\n", [("{ a }", 1), ("(* b *)", 1), ("// c", 1)]),
        ("Lua", "--[[ a\n--]] -- b\n", [("--[[ a\n--]]", 1), ("-- b", 2)]),
        ("Go", "`// no\n` // yes\n", [("// yes", 2)]),
        ("Fortran", 'x = "a\\" ! b\n', [("! b", 1)]),
        ("PowerShell", '"a`" # no" # yes\n<# b #>', [("# yes", 1), ("<# b #>", 2)]),
        ("Markdown", "`<!-- no -->` <!-- yes -->", [("<!-- yes -->", 1)]),
        ("C", "", []),
    ],
)
def test_rules(language, text, expected):
    assert comments(language, text) == expected


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_every_language_finds_its_own_comments(language):
    rules = LANGUAGES[language]
    for rule in rules.lines:
        assert comments(language, f"x\n{rule.start} a\n" + "x" * 20) == [(f"{rule.start} a", 2)]
    for rule in rules.blocks:
        found = comments(language, f"\n{rule.start} a\n{rule.end}\n" + "y" * 20)
        assert found == [(f"{rule.start} a\n{rule.end}", 2)]


_PIECES = st.sampled_from([("code", "x = 1;\n"), ("string", '"// no /* */"'), ("string", "'\\''"), ("line", "// yes"), ("block", "/* a\n * b */"), ("code", " \r\n"), ("code", "ü — 日本\n")])


@given(st.lists(_PIECES, max_size=30))
def test_random_sequences(pieces):
    text, expected = "", []
    for kind, piece in pieces:
        if kind == "line":
            expected.append((piece, 1 + text.count("\n")))
            text += piece + "\n"
        else:
            if kind == "block":
                expected.append((piece, 1 + text.count("\n")))
            text += piece
    assert comments("C", text + "ok") == expected


def test_language_of():
    assert language_of("a/b", "#!/usr/bin/env python3\n") == "Python"
    assert language_of("a/b", "#!/bin/bash -e\n") == "Shell"
    assert language_of("x.ts", "<?xml") == "XML"
    assert language_of("x.ts", "let a") == "TypeScript"
    assert language_of("go.mod") == "Go Module"
    assert language_of("x.m", "% comment\nfunction y = f(x)\n") == "MATLAB"
    assert language_of("x.h", "#import <a.h>") == "Objective-C"
    assert language_of(None) is None and language_of("x.unknown") is None
    assert language_of("x.unknown", "", {"unknown": "C"}) == "C"
    assert rules_of("Coq") == LANGUAGES["<generic>"] and rules_of("Text") is None and rules_of(None) is None


def test_content_tests_read_the_whole_file(spark, tmp_path):
    header = "// licence\n" * 1000
    files = [("a.h", header + "class A {};\n", "C++"), ("b.h", header + "@interface B\n", "Objective-C"), ("c.h", header, "C"), ("d.m", "\n" * 9000 + "  % x\n", "MATLAB")]
    assert [language_of(p, c) for p, c, _ in files] == [x for _, _, x in files]
    spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(files)], "file_id bigint, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    assert {r.file_id: r.language for r in QUERIES["lang_detect"](spark, str(tmp_path)).collect()} == {i: x for i, (_, _, x) in enumerate(files)}


def test_comments_of_a_table(spark):
    rows = [(1, "a.c", "// x\n"), (2, "b.c", None), (3, None, "// x\n"), (4, "c.c", ""), (5, "d.txt", "// x"), (1, "a.c", "// x\n")]
    df = spark.createDataFrame(rows, "n int, p string, c string")
    found = comments_of(df, "p", "c", ("n",)).collect()
    assert [(r.n, r.text, r.line, r.multiline, r.start_tok, r.end_tok) for r in found] == [(1, "// x", 1, False, "//", None)] * 2
    assert comments_of(df.limit(0), "p", "c").count() == 0
    assert comments_of(df, "p", "c", lang="c++").where("lang = 'C++'").count() == 4
    with pytest.raises(ValueError):
        comments_of(df, "p", "c", lang="no such language")


_MARKS = {"py": "#", "rb": "#", "sh": "#", "yaml": "#", "lua": "--", "hs": "--", "sql": "--", **dict.fromkeys(("php", "rs", "c", "java", "js", "go", "tsx"), "//")}
_EXTENSIONS = {
    **{n: set(_MARKS) | {"ml", "html"} for n in ("comments", "line_comments", "block_comments", "comment_lines")},
    "html_comments": {"html"}, "generic_fallback": {"tsx"}, "lang_python": {"py"}, "lang_ruby": {"rb"}, "lang_lua": {"lua"}, "lang_haskell": {"hs"}, "lang_ocaml": {"ml"},
    "lang_sql": {"sql"}, "lang_php": {"php"}, "lang_rust": {"rs"}, "lang_shell": {"sh", "yaml"}, "lang_c_family": {"c", "java", "js", "go"},
}


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """Two files of each extension; the record of the earlier scan lists only the first."""
    root, files = str(tmp_path_factory.mktemp("recorded")), []
    for e in sorted([*_MARKS, "ml", "html"]):
        start, end = (_MARKS[e], "") if e in _MARKS else ("(* ", " *)") if e == "ml" else ("<!-- ", " -->")
        for k in range(2):
            files.append((len(files), f"a/b{k}.{e}", f"x{k}\n{start} first {k}{end}\ny z\n\n{start} second {k}{end}\n" + "w" * 20 + "\n"))
    spark.createDataFrame(files, "file_id bigint, path string, content string").write.parquet(f"{root}/source_files.parquet")
    rows = [(f[0], f[1], "?", 1) for f in files[::2]]
    spark.createDataFrame(rows, "file_id bigint, path string, text string, line int").write.parquet(f"{root}/comments.parquet")
    return root, files


@pytest.mark.parametrize("name", sorted(_EXTENSIONS))
def test_queries_lex_files_without_a_record(spark, recorded, name):
    root, files = recorded
    expected = set()
    for i, path, content in files:
        e = path.rsplit(".")[-1]
        if e in _EXTENSIONS[name] and (name not in ("line_comments", "block_comments") or (name == "line_comments") == (e in _MARKS)):
            found = re.compile(re.escape(_MARKS[e]) + ".*" if e in _MARKS else r"\(\*.*?\*\)|<!--.*?-->")
            expected |= {(i, m.group(), n) for n, line in enumerate(content.split("\n"), 1) for m in found.finditer(line)}
    got = QUERIES[name](spark, root).collect()
    if name == "comment_lines":
        assert sorted((r.file_id, r.first_line, r.last_line, r.n) for r in got) == [(f[0], 2, 5, 2) for f in files]
    else:
        assert expected and sorted((r.file_id, r.text, r.line) for r in got) == sorted(expected)
