import io
import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from scholia import cli
from scholia.api import scan_tree
from scholia.functions.charsets import CharsetError, decode, resolve
from scholia.functions.globs import glob_to_regex
from scholia.functions.langs import languages_in
from scholia.functions.reports import plain_line
from scholia.operators.blame import beyond_authors
from scholia.sources import codefiles
from scholia.sources.gitblame import blame_of, parse_porcelain
from scholia.sources.walk import WalkOptions, list_files


@pytest.fixture
def tree(tmp_path):
    for path, content in {
        "a.go": "// TODO(x): one\n",
        ".hidden.go": "// TODO: two\n",
        ".git/c.go": "// TODO: no\n",
        "vendor/d.go": "// TODO: no\n",
        "sub/e.py": "# FIXME: three\n",
        "sub/skip.py": "# FIXME: no\n",
        "sub/.gitignore": "# comment\nskip.py\n",
        "gen.go": "// Code generated by x. DO NOT EDIT.\n// TODO: no\n",
        "bin.c": "\0\0// TODO: no\n",
        "note.txt": "// TODO: no\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    return tmp_path


def names(listing, root):
    return sorted(os.path.relpath(p, root) for p, _ in listing.files)


def test_listing(tree):
    assert names(list_files([str(tree)]), tree) == [".hidden.go", "a.go", "bin.c", "gen.go", "note.txt", "sub/.gitignore", "sub/e.py"]
    assert "sub/e.py" not in names(list_files([str(tree)], WalkOptions(exclude_dirs=["su*/"])), tree)
    assert names(list_files([str(tree)], WalkOptions(exclude=["*.go"], exclude_hidden=True)), tree) == ["bin.c", "note.txt", "sub/e.py"]
    assert "vendor/d.go" in names(list_files([str(tree)], WalkOptions(include_vendored=True)), tree)
    assert list_files([str(tree / "vendor/d.go")], WalkOptions(exclude=["*"])).files == [(str(tree / "vendor/d.go"), True)]
    assert list_files([str(tree / "none")]).errors


def test_links(tree):
    os.symlink(tree / "sub", tree / "alias")
    os.symlink(tree, tree / "sub" / "up")
    assert not any("alias" in p for p, _ in list_files([str(tree)]).files)
    followed = list_files([str(tree)], WalkOptions(follow=True))
    assert any("alias" in p for p, _ in followed.files) and [e for e in followed.errors if "loop" in e[1]]
    os.symlink(tree / "gone", tree / "broken.go")
    assert [(os.path.basename(p), m) for p, m in list_files([str(tree)]).errors] == [("broken.go", "no such file or directory")]


def test_folders_that_cannot_be_read(tree, monkeypatch):
    listdir = os.listdir

    def refuse(path):
        if str(path).endswith("sub"):
            raise PermissionError(13, "Permission denied")
        return listdir(path)

    monkeypatch.setattr(os, "listdir", refuse)
    found = list_files([str(tree)])
    assert found.errors == [(str(tree / "sub"), "Permission denied")] and "a.go" in names(found, tree)


def test_listing_is_shared_out(tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        (tmp_path / f"d{i}" / "in" / "a.go").write_text("")
        (tmp_path / f"d{i}" / "b.go").write_text("")
    os.symlink(tmp_path, tmp_path / "d3" / "in" / "up")
    monkeypatch.setattr(codefiles, "FOLDERS", 8)
    reader = codefiles.CodeFilesReader({"path": str(tmp_path), "follow": "true"})
    parts = reader.partitions()
    assert len(parts) > 8 and sum(len(p.files) for p in parts) < 60
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[0] for r in rows if r[3] is None) == sorted(p for p, _ in list_files([str(tmp_path)]).files) and len([r for r in rows if r[3]]) == 1


def test_ignore_rules_have_no_order(tmp_path):
    for name in ("a.go", "b.go"):
        (tmp_path / name).write_text("")
    (tmp_path / ".gitignore").write_text("!a.go\n*.go\n")
    assert names(list_files([str(tmp_path)]), tmp_path) == [".gitignore", "a.go"]


def test_scan_tree(spark, tree):
    tasks, errors = scan_tree(spark, [str(tree)])
    assert sorted((r.type, r.label, r.message) for r in tasks.collect()) == [("FIXME", "", "three"), ("TODO", "", "two"), ("TODO", "x", "one")]
    assert errors.count() == 0
    tasks, errors = scan_tree(spark, [str(tree / "bin.c"), str(tree / "gen.go"), str(tree / "note.txt")])
    assert [r.message for r in tasks.collect()] == ["no"] and sorted(r.message for r in errors.collect()) == ["binary file", "unsupported language: Text"]
    lines = spark.createDataFrame([(str(tree / "a.go"), 1, "A", "a@x"), (str(tree / "a.go"), 1, "A", "a@x")], "path string, line int, name string, email string")
    tasks, _ = scan_tree(spark, [str(tree / "a.go"), str(tree / "sub/e.py")], blame=lines)
    assert sorted((r.message, r.git_user and tuple(r.git_user)) for r in tasks.collect()) == [("one", ("A", "a@x")), ("three", None)]


def test_command_line(spark, tree, monkeypatch):
    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(args), spark, out, err), out.getvalue(), err.getvalue()

    a = str(tree / "a.go")
    assert run("-o", "default", a) == (1, f"{a}:1:// TODO(x): one\n", "")
    assert run("-o", "github", a) == (1, f"::warning file={a},line=1::// TODO(x): one\n", "")
    assert run("-o", "json", a)[1] == f'{{"path":"{a}","type":"TODO","text":"// TODO(x): one","label":"x","message":"one","line":1,"comment_line":1}}\n'
    assert run("--todo-types", "HACK", a) == (0, "", "")
    assert run("--label", "[", a)[0] == 2 and run("-c", "no-such", a)[0] == 2 and run("-o", "xml", a)[0] == 2
    assert run("--profile", str(tree / "cpu.prof"), "-o", "default", a)[0] == 1 and (tree / "cpu.prof").stat().st_size > 0
    code, _, err = run(str(tree / "none"), a)
    assert code == 3 and "none: no such file or directory" in err
    os.symlink(tree, tree / "sub" / "up")
    code, _, err = run("--follow", str(tree))
    assert code == 3 and err.count("\n") == 1 and "symbolic link loop" in err
    monkeypatch.setattr(cli, "scan_tree", lambda *a, **k: 1 / 0)
    code, _, err = run(a)
    assert code == 4 and "division by zero" in err


def test_further_languages(spark, tree):
    listed = tree / "languages.yml"
    listed.write_text("---\n# a list\nPython:\n  type: programming\n  extensions:\n  - \".py\"\n  - \".bzl.in\"\n  filenames:\n  - 'BUILD.x'\nNo Such:\n  extensions:\n  - \".go\"\n  - .zzz\n")
    assert languages_in(listed.read_text()) == {"bzl.in": "Python", "BUILD.x": "Python"}
    for name in ("a.BZL.in", "BUILD.x", "b.in"):
        (tree / name).write_text(f"# TODO: {name}\n")
    out = io.StringIO()
    paths = [str(tree / n) for n in ("a.BZL.in", "BUILD.x", "b.in")]
    assert cli.main(["--languages", str(listed), "-o", "default", "--no-error-on-unsupported", *paths], spark, out, io.StringIO()) == 1
    assert [x.rsplit(": ", 1)[1] for x in out.getvalue().splitlines()] == ["BUILD.x", "a.BZL.in"]
    assert cli.main(["--languages", str(tree / "none"), *paths], spark, out, io.StringIO()) == 2


def test_standard_input(spark, tree, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"# TODO: from a pipe\n")))
    out = io.StringIO()
    assert cli.main(["-o", "default", "-g", "python", "-", str(tree / "a.go")], spark, out, io.StringIO()) == 1
    assert out.getvalue() == "stdin:1:# TODO: from a pipe\n"


def test_lines_without_author(spark):
    tasks = spark.createDataFrame([("a.py", 3), ("a.py", 9), ("b.py", 1)], "path string, line int")
    lines = spark.createDataFrame([("a.py", 1, "A", None), ("a.py", 8, "A", None)], "path string, line int, name string, email string")
    assert [tuple(r) for r in beyond_authors(tasks, lines).collect()] == [("a.py", "no author of line 9")]


def test_plain_report(spark):
    df = spark.createDataFrame([("a", 1, "t", ("N", "e@x")), ("a", 1, "t", ("N", "")), ("a", 1, "t", (None, None)), ("a", 1, "t", None)], "path string, line int, text string, u struct<name:string,email:string>")
    assert [r.v for r in df.select(plain_line(F.col("u")).alias("v")).collect()] == ["a:1:N <e@x>:t", "a:1:N:t", "a:1::t", "a:1:t"]
    assert df.select(plain_line(F.col("u"), True).alias("v")).first().v == "\x1b[35ma\x1b[0m\x1b[36m:\x1b[0m\x1b[32m1\x1b[0m\x1b[36m:\x1b[0m\x1b[32mN <e@x>\x1b[0m\x1b[36m:\x1b[0mt"


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from scholia.plans import tables

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context, {}

    class Frame:
        sparkSession = Session

    with pytest.raises(ValueError):
        tables.materialize(Frame)


def test_charsets():
    assert decode("über".encode("utf-16"), "detect") == "über" and decode("日本語の".encode("shift_jis"), "detect") == "日本語の"
    assert decode("é".encode(), "ISO-8859-1") == "é" and resolve("GB-18030") == "gb18030"
    with pytest.raises(CharsetError):
        resolve("no-such")


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("// TODO: この部分はまだ遅いので、後で直すこと\n", ("shift_jis", "euc_jp")),
        ("// TODO: カタカナのコメントも読める\n", ("shift_jis", "euc_jp")),
        ("// TODO: 这里太慢了，因为任务队列每一行都要重新创建\n", ("gb18030",)),
        ("// TODO: 這裡太慢了，因為工作佇列每一行都要重新建立\n", ("big5",)),
        ("// TODO: 이 부분은 나중에 더 작은 모듈로 옮기는 것이 좋겠다\n", ("euc_kr",)),
        ("// TODO: перенести этот код в отдельный модуль поменьше\n", ("cp1251", "koi8-r", "iso8859-5", "cp866")),
        ("// TODO: αυτό το τμήμα είναι πολύ αργό ακόμη\n", ("cp1253",)),
        ("// TODO: la règle imbriquée échoue à la fin, très coûteux\n", ("cp1252",)),
        ("// TODO: das Übergabeformat zählt Umlaute wie ü und ö doppelt\n", ("cp1252",)),
    ],
)
def test_charset_detection(text, names):
    for name in names:
        assert decode(text.encode(name), "detect") == text, name


def test_globs():
    import re

    hit = lambda g, s: re.fullmatch(glob_to_regex(g), s) is not None
    assert hit("*.go", "a/b.go") and hit("[!a]?", "bc") and not hit("[!a]?", "ac") and hit("{a,b}c", "bc") and hit(r"\*", "*") and not hit("a", "ab")
    with pytest.raises(ValueError):
        glob_to_regex("[a")


def test_porcelain():
    out = f"{'a' * 40} 1 1 1\nauthor A B\nauthor-mail <a@b>\n\tx\n{'b' * 40} 2 2\nauthor C\nauthor-mail <c@d>\n\ty"
    assert list(parse_porcelain(out)) == [(1, "A B", "a@b"), (2, "C", "c@d")]


def test_library_does_not_need_its_optional_part():
    code = "import sys; sys.modules['scholia.llm'] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run(["python", "-c", code], cwd=root, capture_output=True).returncode == 0


@pytest.mark.skipif(not shutil.which("git"), reason="no git here")
def test_line_authors_from_git(spark, tmp_path):
    def git(*args, who="A B"):
        env = {"PATH": os.environ["PATH"], "HOME": str(tmp_path), "GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who[0].lower()}@x.example", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x.example"}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    (tmp_path / "sub").mkdir()
    file = tmp_path / "sub" / "a.py"
    file.write_text("# TODO: one\n")
    git("init", "-q")
    git("add", "sub/a.py")
    git("commit", "-qm", "x")
    file.write_text("# TODO: one\n# TODO: two\n")
    git("commit", "-qam", "y", who="D E")
    file.write_text("# TODO: one\n# TODO: two\n# TODO: not committed\n")
    (tmp_path / "sub" / "new.py").write_text("# TODO: new\n")
    tasks, _ = scan_tree(spark, [str(tmp_path / "sub")])
    lines = blame_of(tasks)
    assert sorted(map(tuple, lines.collect())) == [(str(file), 1, "A B", "a@x.example"), (str(file), 2, "D E", "d@x.example")]
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["--blame", "-o", "default", str(tmp_path / "sub")], spark, out, err) == 3
    assert out.getvalue().splitlines()[:2] == [f"{file}:1:A B <a@x.example>:# TODO: one", f"{file}:2:D E <d@x.example>:# TODO: two"]
    assert err.getvalue() == f"scholia: {file}: no author of line 3\n"
