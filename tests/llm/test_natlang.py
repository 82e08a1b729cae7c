import os

import pytest

from scholia.functions.langs import LANGUAGES
from scholia.llm.bpe import TOKENIZER_DIR
from scholia.llm.natlang import find_languages, fit, snippets, unescape

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabulary files here")
TEXTS = {
    "en": "Check that the label pattern is closed before the marker table starts.\nThis is slow because the path filter is rebuilt for every line of the file.\nRemove this workaround once the cache supports empty input.",
    "de": "Das ist zu langsam, weil der äußere Block für jede Zeile neu entsteht.\nHier fehlt noch eine Prüfung für überlange Zeilen.\nKlären, warum die Rückgabe hier zwei Einträge zurückgibt.",
    "ja": "コメント走査が直ったらこの回避策を消してください\nこの部分は別の小さなモジュールに移したい\n長すぎる行の検査がまだここにありません",
    "zh": "这里还缺少对超长行的检查，以后再补上\n把这一段代码移到单独的小模块里面去\n不清楚为什么转义规则在这里返回了",
}
CODE = ["if (x > 3) { run(); }\nreturn x + 1;\nSELECT id, name FROM scans WHERE depth > 3 ORDER BY id;\nconst a = foo.bar(baz);\nimport os, sys\ndef run(self, rows): yield row\n"] * 5


@pytest.fixture(scope="module")
def model():
    return fit([(k, v) for k, v in TEXTS.items()] * 5, CODE, sorted(TEXTS))


def languages(model, text):
    return sorted(language for language, _ in model.sentences(text))


def test_sentences(model):
    for language, text in TEXTS.items():
        assert languages(model, text.split("\n")[0]) == [language]
    assert languages(model, "TODO(x): check that the label pattern is\nclosed before the table starts") == ["en"]
    assert languages(model, "check that the label pattern is closed\n" + TEXTS["ja"].split("\n")[0]) == ["en", "ja"]
    for other in ("not found", "SELECT id, name FROM scans WHERE depth = 4 ORDER BY id", "if (run > 3) { run(); return x + 1; }", "", "日本語", "12 34 56 78 90", "/var/lib/cache-3"):
        assert languages(model, other) == []


def test_snippets():
    text = 'x = "a \\u00e9 \\"b\\""; // c\n/*\n * d\n * e */ "\\ud83d\\ude00"'
    assert list(snippets(text, LANGUAGES["C"])) == ['a é "b"', "c", "d\ne ", "😀"]
    assert unescape("\\u{1F600}\\x41\\n\\q") == "😀A\nq"


def test_files(spark, model):
    rows = [
        (1, "a.py", None, f'x = 1  # {TEXTS["en"].splitlines()[0]}\ny = "{TEXTS["de"].splitlines()[0]}"\n'),
        (2, "b.c", "C", None),
        (3, "c.c", None, ""),
        (4, "d.unknown", "go", f"// {TEXTS['ja'].splitlines()[0]}\n"),
        (5, "e.unknown", None, "// Check that the label pattern is closed\n"),
        (6, "f.c", "C", "the label pattern is closed before this outside of any comment\n"),
        (7, "g.c", "C", "int x;\n" * 20_000 + f"// {TEXTS['en'].splitlines()[0]}\n"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, path string, lang string, content string").selectExpr("*", "1 as id", "2 as nat_lang", "3 as n_chars")
    got = sorted((r.file_id, r.nat_lang, r.n_sentences) for r in find_languages(df, model).collect())
    assert got == [(1, "de", 1), (1, "en", 1), (4, "ja", 1), (7, "en", 1)]
    assert find_languages(df.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_shares(spark):
    from scholia.llm.queries import p2_found, p2_shares

    d = "/root/testdata/sf0.001"
    rows = p2_shares(spark, d).collect()
    chars = {r.file_id: len(r.content) for r in spark.read.parquet(f"{d}/source_files.parquet").collect() if r.content}
    assert {(r.file_id, r.nat_lang) for r in rows} == {tuple(r) for r in p2_found(spark, d).collect()} and rows
    for r in rows:
        assert r.n_sentences >= 1 and r.n_chars >= 10 and r.share == round(r.n_chars / chars[r.file_id], 4) <= 1
    by_file = {}
    for r in rows:
        by_file[r.file_id] = by_file.get(r.file_id, 0) + r.n_chars
    assert all(n <= chars[i] for i, n in by_file.items())
