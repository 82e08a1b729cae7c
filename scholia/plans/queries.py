"""Queries of the engine's own operators, by name, each with SQL that gives the same rows where SQL can.

Two kinds of input: the project's tables, and source files written from table columns inside the
query, whose markers are then known from the columns without any lexer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.api import scan_table
from scholia.functions.globs import any_glob
from scholia.functions.langs import ALIASES, EXTENSIONS, GENERIC, LANGUAGES, NAMES, language_of
from scholia.functions.reports import github_line, json_line, plain_line, severity
from scholia.operators import blame, paths
from scholia.operators.lexer import comments_of
from scholia.operators.markers import DEFAULT_TYPES, markers_of, patterns, trim_space
from scholia.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Comments of source files, against a lexer in SQL: one pattern per language cuts a file into strings, comments and the rest.


def _comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of all files, line ends unified, repeated rows once."""
    files = table(spark, d, "source_files").select("file_id", F.col("path").alias("p"), "content")
    found = comments_of(files, "p", "content", ("file_id",))
    return found.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))).select("file_id", "text", "line", "multiline", "start_tok", "end_tok").distinct()


# Pieces of the SQL patterns. A string ends at its mark unless a backslash stands right before it; what is never closed takes the rest of the file.
_DQ = r'"(?:[^"\\]|\\+[^\\])*"|"(?:[^"\\]|\\+[^\\])*\\*\z'
_SQ = r"'(?:[^'\\]|\\+[^\\])*'|'(?:[^'\\]|\\+[^\\])*\\*\z"
_STAR = r"/\*.*?\*/|/\*.*\z"
# One comment inside another; behind an inner end one more character is taken before anything counts again.
_NESTED = r"\(\*(?:\(\*(?:[^*]|\*+[^*)])*\*+\).|[^(*]|\(+[^*(]|\*+[^*)])*\*+\)|\(\*.*\z"
_ARROW = r"<!--.*?-->|<!--.*\z"
#: Extensions, pattern of strings and comments, characters that begin one, marks of line comments, marks of blocks.
_SQL_LEXERS: dict[str, tuple[tuple[str, ...], str, str, tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    "python": (("py",), rf'""".*?"""|""".*\z|{_DQ}|{_SQ}|#[^\n]*', "\"'#", ("#",), (('"""', '"""'),)),
    "ruby": (("rb",), rf"(?m:^)=begin.*?(?m:^)=end|(?m:^)=begin.*\z|%\{{[^}}]*\}}|{_DQ}|{_SQ}|#[^\n]*", "\"'#=%", ("#",), (("=begin", "=end"),)),
    "lua": (("lua",), rf"--\[\[.*?--\]\]|--\[\[.*\z|{_DQ}|{_SQ}|--[^\n]*", "\"'-", ("--",), (("--[[", "--]]"),)),
    "haskell": (("hs",), rf"\{{-.*?-\}}|\{{-.*\z|{_DQ}|{_SQ}|--[^\n]*", "\"'{-", ("--",), (("{-", "-}"),)),
    "ocaml": (("ml",), rf"{_NESTED}|{_DQ}|{_SQ}", "\"'(", (), (("(*", "*)"),)),
    "sql": (("sql",), rf"""{_STAR}|"(?:[^"]|"")*"|"[^"]*\z|'(?:[^']|'')*'|'[^']*\z|--[^\n]*""", "\"'-/", ("--",), (("/*", "*/"),)),
    "php": (("php",), rf"{_STAR}|{_DQ}|{_SQ}|(?:#|//)[^\n]*", "\"'#/", ("#", "//"), (("/*", "*/"),)),
    "rust": (("rs",), rf"{_STAR}|{_DQ}|//[^\n]*", '"/', ("//",), (("/*", "*/"),)),
    "shell": (("sh", "yaml"), rf"{_DQ}|{_SQ}|#[^\n]*", "\"'#", ("#",), ()),
    "c_family": (("c", "java", "js"), rf"{_STAR}|{_DQ}|{_SQ}|//[^\n]*", "\"'/", ("//",), (("/*", "*/"),)),
    "go": (("go",), rf"{_STAR}|`[^`]*`|`[^`]*\z|{_DQ}|{_SQ}|//[^\n]*", "\"'`/", ("//",), (("/*", "*/"),)),
    "html": (("html",), rf"{_ARROW}|{_DQ}|{_SQ}", "\"'<", (), (("<!--", "-->"),)),
    "generic": (("tsx",), rf"{_STAR}|{_ARROW}|{_DQ}|{_SQ}|(?:#|//)[^\n]*", "\"'#/<", ("//", "#"), (("/*", "*/"), ("<!--", "-->"))),
}


def _lexed(name: str) -> str:
    """SQL: every comment of the files of one lexer, text as it stands."""
    extensions, tokens, begin, lines, blocks = _SQL_LEXERS[name]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    other = "[^" + "".join("\\" + c if c in "-[]^" else c for c in begin) + "]+|."
    starts = " ".join(f"WHEN starts_with(tok, {quote(a)}) THEN {quote(a)}" for a, _ in blocks) + " " + " ".join(f"WHEN starts_with(tok, {quote(a)}) THEN {quote(a)}" for a in lines)
    ends = " ".join(f"WHEN starts_with(tok, {quote(a)}) THEN {quote(b)}" for a, b in blocks)
    closed = " OR ".join([*(f"(starts_with(tok, {quote(a)}) AND ends_with(tok, {quote(b)}) AND len(tok) >= {len(a) + len(b)})" for a, b in blocks), *(f"(starts_with(tok, {quote(a)}) AND NOT ({' OR '.join(f'starts_with(tok, {quote(b)})' for b, _ in blocks) or 'false'}))" for a in lines)])
    # A piece that only begins a comment, at the very end of a file, is none.
    return f"""
SELECT file_id, repo, path, CASE WHEN end_tok IS NULL THEN regexp_replace(tok, chr(13) || '$', '') ELSE tok END AS text, CAST(line AS INTEGER) AS line, end_tok IS NOT NULL AS multiline, start_tok, end_tok FROM (
  SELECT *, CASE {starts} END AS start_tok, {f"CASE {ends} END" if ends else "CAST(NULL AS VARCHAR)"} AS end_tok FROM (
    SELECT file_id, repo, path, tok, 1 + coalesce(sum(len(tok) - len(replace(tok, chr(10), ''))) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM (
      SELECT file_id, repo, path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k FROM (
        SELECT file_id, repo, path, regexp_extract_all(content, {quote(tokens + "|" + other)}, 0, 's') AS toks FROM source_files
        WHERE content <> '' AND regexp_extract(path, '[.]([a-z]+)$', 1) IN ({", ".join(map(quote, extensions))}))))
  WHERE {closed})"""


def _unified(*names: str) -> str:
    return "SELECT DISTINCT file_id, replace(text, chr(13) || chr(10), chr(10)) AS text, line, multiline, start_tok, end_tok FROM (" + " UNION ALL ".join(_lexed(n) for n in names) + ")"


_COMMENTS_SQL = _unified(*_SQL_LEXERS)


@_query(_COMMENTS_SQL)
def comments(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d)


@_query(f"SELECT file_id, text, line, start_tok FROM ({_COMMENTS_SQL}) WHERE NOT multiline")
def line_comments(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).where("not multiline").select("file_id", "text", "line", "start_tok")


@_query(f"SELECT file_id, text, line, start_tok, end_tok FROM ({_COMMENTS_SQL}) WHERE multiline")
def block_comments(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).where("multiline").select("file_id", "text", "line", "start_tok", "end_tok")


@_query(f"SELECT file_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM ({_COMMENTS_SQL}) GROUP BY file_id")
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).groupBy("file_id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT file_id, line, replace(text, chr(13) || chr(10), chr(10)) AS text, true AS found FROM comments")
def comments_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The record of an earlier scan, which lacks some files, and whether each of its comments is found again."""
    record = table(spark, d, "comments").select("file_id", "line", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text")).distinct()
    found = _comments(spark, d).select("file_id", "line", "text", F.lit(True).alias("f")).distinct()
    return record.join(found, ["file_id", "line", "text"], "left").select("file_id", "line", "text", F.coalesce("f", F.lit(False)).alias("found"))


def _of_extension(*names: str):
    extensions = [e for n in names for e in _SQL_LEXERS[n][0]]
    sql = f"SELECT DISTINCT file_id, text, line FROM ({_unified(*names)})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        files = table(spark, d, "source_files").select("file_id", F.col("path").alias("p"), "content").where(F.regexp_extract("p", "[.]([a-z]+)$", 1).isin(*extensions))
        return comments_of(files, "p", "content", ("file_id",)).select("file_id", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"), "line").distinct()

    return sql, run


for _name, _lexers in {
    "html_comments": ("html",),
    "generic_fallback": ("generic",),
    "lang_python": ("python",),
    "lang_ruby": ("ruby",),
    "lang_lua": ("lua",),
    "lang_haskell": ("haskell",),
    "lang_ocaml": ("ocaml",),
    "lang_sql": ("sql",),
    "lang_php": ("php",),
    "lang_rust": ("rust",),
    "lang_shell": ("shell",),
    "lang_c_family": ("c_family", "go"),
}.items():
    _sql, _run = _of_extension(*_lexers)
    _query(_sql, _name)(_run)


# Languages.

_CODES = {"go": "Go", "py": "Python", "js": "JavaScript", "java": "Java", "tsx": "TSX", "c": "C", "rs": "Rust", "sh": "Shell", "yaml": "YAML", "php": "PHP", "sql": "SQL", "rb": "Ruby", "html": "HTML", "lua": "Lua", "hs": "Haskell", "ml": "OCaml"}


@_query("SELECT file_id, CASE regexp_extract(path, '[.]([a-z]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in _CODES.items()) + " END AS language FROM source_files")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    detect = F.udf(language_of, "string", useArrow=True)
    return table(spark, d, "source_files").select("file_id", detect("path", "content").alias("language"))


@_query(
    "SELECT file_id, lang, CASE lower(trim(lang)) WHEN 'golang' THEN 'Go' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'bash' THEN 'Shell' "
    + " ".join(f"WHEN '{v.lower()}' THEN '{v}'" for v in (*_CODES.values(), "TypeScript"))
    + " END AS language FROM source_files WHERE lang IS NOT NULL"
)
def lang_override(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return table(spark, d, "source_files").where("lang is not null").select("file_id", "lang", F.try_element_at(known, F.lower(trim_space(F.col("lang")))).alias("language"))


@_query()
def lang_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every language with its file names, extensions and delimiters."""
    names = lambda of, n, dot="": " ".join(sorted(f"{dot}{k}" for k, v in of.items() if v == n))
    rows = [
        (n, names(NAMES, n), names(EXTENSIONS, n, "."), " ".join(r.start for r in rules.lines), " ".join(f"{r.start} {r.end}" for r in rules.blocks), " ".join(r.start for r in rules.strings))
        for n, rules in sorted(LANGUAGES.items())
        if n != GENERIC
    ]
    return spark.createDataFrame(rows, "lang string, file_names string, extensions string, line_tokens string, block_tokens string, string_tokens string").orderBy("lang")


# Markers, from recorded comments.

_TRIM = r"[\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_TRIM}|{_TRIM}$', '', 'g')"


def _markers_sql(types=DEFAULT_TYPES, source: str = "SELECT * FROM comments", key: str = "comment_id, file_id") -> str:
    p = {k: v.replace("(?d)", "").replace("'", "''") for k, v in patterns(types).items()}

    def part(text: str, pattern: str) -> str:
        g = [f"regexp_extract({text}, '{pattern}', {i})" for i in range(7)]
        pick = lambda a, b: _trim(f"CASE WHEN {g[a]} <> '' THEN {g[a]} ELSE {g[b]} END")
        return f"{{'type': {g[1]}, 'label': {pick(3, 5)}, 'message': {pick(4, 6)}}}"

    return f"""
WITH trimmed AS (
  SELECT {key}, line, multiline, start_tok, end_tok, {_trim("text")} AS t FROM ({source}) WHERE text IS NOT NULL
), lines AS (
  SELECT {key}, line, start_tok, end_tok, multiline, unnest(string_split(t, chr(10))) AS own, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS k FROM trimmed WHERE multiline
  UNION ALL SELECT {key}, line, start_tok, end_tok, multiline, t, 0 FROM trimmed WHERE NOT multiline
), bare AS (
  SELECT *, CASE WHEN multiline THEN rtrim(ltrim(own, start_tok), end_tok) ELSE ltrim(own, start_tok) END AS b FROM lines
), parts AS (
  SELECT *, CASE WHEN multiline THEN CASE WHEN regexp_matches(b, '{p["block"]}') THEN {part("b", p["block"])} END
    WHEN regexp_matches(b, '{p["spaced"]}') THEN {part("b", p["spaced"])}
    WHEN regexp_matches(b, '{p["tight"]}') THEN {part("b", p["tight"])} END AS p FROM bare
)
SELECT {key}, p.type AS type, {_trim("own")} AS text, p.label AS label, p.message AS message, CAST(line + k AS INTEGER) AS line, line AS comment_line FROM parts WHERE p.type <> ''
"""


def _marked(spark: SparkSession, d: str, types=DEFAULT_TYPES, labels=()) -> DataFrame:
    return markers_of(table(spark, d, "comments"), types, labels).select("comment_id", "file_id", "type", "text", "label", "message", "line", "comment_line")


@_query(_markers_sql())
def todo_rows(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


@_query(f"SELECT t.* FROM ({_markers_sql()}) t JOIN comments USING (comment_id) WHERE NOT multiline".replace("t.*", "comment_id, t.type, t.label, t.message, t.line"))
def todo_line(spark: SparkSession, d: str) -> DataFrame:
    return markers_of(table(spark, d, "comments").where("not multiline")).select("comment_id", "type", "label", "message", "line")


@_query(_markers_sql(("FIXME", "HACK")))
def custom_types(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, ("FIXME", "HACK"))


@_query(f"SELECT * FROM ({_markers_sql()}) WHERE regexp_matches(label, '^(?:core-.*|#[0-9].*)$')")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, labels=("core-*", "#[0-9]*"))


@_query(f"SELECT type, count(*) AS n FROM ({_markers_sql()}) GROUP BY type")
def todo_types(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT label, count(*) AS n FROM ({_markers_sql()}) WHERE label <> '' GROUP BY label")
def todo_labels(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT message, count(*) AS n, count(DISTINCT file_id) AS files FROM ({_markers_sql()}) WHERE message <> '' GROUP BY message")
def todo_messages(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("message <> ''").groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"))


@_query(_markers_sql(source=" UNION ALL ".join(_lexed(n) for n in _SQL_LEXERS), key="file_id, repo, path"))
def scan(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: files to markers in one narrow stage."""
    files = table(spark, d, "source_files").select("file_id", "repo", "path", "content")
    return scan_table(files, keep=("file_id", "repo"))


# Paths.

_BASE = "list_extract(string_split(path, '/'), -1)"
_DIRS = "list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda s: s NOT IN ('', '.', '..'))"


def _path_query(condition: str, predicate: Callable[[Column], Column], name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "source_files").where(predicate(F.col("path"))).select("file_id", "path")

    _query(f"SELECT file_id, path FROM source_files WHERE {condition}", name)(run)


_path_query(f"NOT regexp_matches({_BASE}, '^(?:.*[.]py|.*[.]go)$')", lambda p: ~paths.excluded(p, ["*.py", "*.go"]), "exclude_glob")
_path_query(f"len(list_filter({_DIRS}, lambda s: regexp_matches(s, '^(?:test.*|scripts)$'))) = 0", lambda p: ~paths.in_excluded_dir(p, ["test*", "scripts/"]), "exclude_dir_glob")
_path_query("len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.') AND s NOT IN ('.', '..'))) = 0", lambda p: ~paths.hidden(p), "hidden_paths")
_path_query(f"len(list_filter({_DIRS}, lambda s: regexp_matches(s || '/', '{paths.VENDORED}'))) > 0", paths.vendored, "vendored_dirs")
_path_query(
    f"len(list_filter({_DIRS}, lambda s: regexp_matches(s || '/', '{paths.VENDORED}') OR s IN ('.git', '.hg', '.svn') OR s = 'docs')) = 0 AND NOT ends_with(path, '.sql')",
    lambda p: paths.keep(p, exclude=["*.sql"], exclude_dirs=["docs"]),
    "path_filter",
)


@_query("SELECT n_nationkey FROM nation WHERE n_nationkey % 5 < 3")
def vcs_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Of paths written from nations' keys those below a folder of a version control system."""
    middle = F.element_at(F.array(*map(F.lit, (".git/", "sub/.hg/", ".svn/x/", ".github/", "git/"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), middle, F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 4, ".git").otherwise(""))
    return table(spark, d, "nation").where(paths.in_vcs_dir(path)).select("n_nationkey")


#: Name and first line of written files; the first of each are generated.
_GENERATED = (
    ("package-lock.json", "{"), ("yarn.lock", "# yarn"), ("api.pb.go", "package api"), ("api_pb2.py", "x = 1"), ("site.min.js", "f()"), ("a.go", "// Code generated by stringer. DO NOT EDIT."),
    ("b.js", "/* @generated */"), ("c.cc", "/* DO NOT EDIT THIS FILE - it is machine generated */"), ("d.js", "f()" + "," * 400), ("package.json", "{"), ("a_test.go", "// Code written by hand."), ("min.js", "f()"), ("c.py", "# generated? no"), ("lock.py", "x = 1"),
)


@_query("SELECT n_nationkey, 2 AS line FROM nation WHERE n_nationkey % 14 >= 9")
def generated_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of files written from nations' keys, each with a marker in its second line, those that a scan does not take for generated."""
    pick = lambda i: F.element_at(F.array(*(F.lit(g[i]) for g in _GENERATED)), (F.col("n_nationkey") % len(_GENERATED) + 1).cast("int"))
    mark = F.when(pick(0).rlike("[.](?:py|lock)$"), "# TODO: x\n").otherwise("// TODO: x\n")
    files = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("src/"), pick(0)).alias("path"), F.concat(pick(1), F.lit("\n"), mark).alias("content"))
    return scan_table(files, keep=("n_nationkey",)).select("n_nationkey", "line")


# Authors and reports, from recorded tasks.

_KEY = ("repo", "path", "line")
_AUTHORS = "SELECT repo, path, line, min(struct_pack(a := name IS NULL, b := email IS NULL, name := name, email := email)) AS u FROM blame GROUP BY repo, path, line"


@_query(f"SELECT t.task_id, a.u.name AS name, a.u.email AS email, a.u IS NOT NULL AS known FROM tasks t LEFT JOIN ({_AUTHORS}) a USING (repo, path, line)")
def blame_join(spark: SparkSession, d: str) -> DataFrame:
    joined = blame.with_authors(table(spark, d, "tasks").select("task_id", *_KEY), table(spark, d, "blame"), _KEY, "u")
    return joined.select("task_id", F.col("u.name").alias("name"), F.col("u.email").alias("email"), F.col("u").isNotNull().alias("known"))


@_query("SELECT task_id FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM blame b WHERE b.repo = t.repo AND b.path = t.path AND b.line = t.line)")
def blame_anti(spark: SparkSession, d: str) -> DataFrame:
    return blame.without_authors(table(spark, d, "tasks").select("task_id", *_KEY), table(spark, d, "blame"), _KEY).select("task_id")


@_query(
    "SELECT task_id, concat_ws(':', path, CAST(line AS VARCHAR), CASE WHEN git_user IS NOT NULL THEN coalesce(git_user.name, '') || CASE WHEN git_user.email <> '' THEN ' <' || git_user.email || '>' ELSE '' END END, text) AS report FROM tasks"
)
def fmt_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("task_id", plain_line(F.col("git_user")).alias("report"))


_SEVERITY = "CASE WHEN type IN ('TODO', 'HACK', 'COMBAK') THEN 'warning' WHEN type IN ('FIXME', 'XXX', 'BUG') THEN 'error' ELSE 'notice' END"


@_query(f"SELECT task_id, '::' || {_SEVERITY} || ' file=' || path || ',line=' || line || '::' || text AS report FROM tasks")
def fmt_github(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("task_id", github_line().alias("report"))


def _json_field(name: str, value: str, first: bool = False) -> str:
    return f"CASE WHEN {value} IS NULL THEN '' ELSE '{'' if first else ','}\"{name}\":' || CAST(to_json({value}) AS VARCHAR) END"


_USER_JSON = "CASE WHEN git_user IS NULL THEN '' ELSE ',\"git_user\":{' || ltrim(" + _json_field("name", "git_user.name") + " || " + _json_field("email", "git_user.email") + ", ',') || '}' END"


@_query(
    "SELECT task_id, replace(replace(replace('{' || "
    + " || ".join(_json_field(c, c, c == "path") for c in ("path", "type", "text", "label", "message", "line", "comment_line"))
    + f" || {_USER_JSON} || '}}', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS report FROM tasks"
)
def fmt_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("task_id", json_line(F.col("git_user")).alias("report"))


@_query(f"SELECT type, {_SEVERITY} AS severity, count(*) AS n FROM tasks GROUP BY 1, 2", "severity")
def _severity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", severity(F.col("type")).alias("severity"), "n")


@_query("SELECT repo, path, count(*) AS n, rank() OVER (PARTITION BY repo ORDER BY count(*) DESC) AS place FROM tasks GROUP BY repo, path")
def files_by_markers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = table(spark, d, "tasks").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.rank().over(Window.partitionBy("repo").orderBy(F.desc("n"))))


@_query("SELECT label, count(*) AS n, count(DISTINCT path) AS files FROM tasks WHERE regexp_matches(label, '^#[0-9]+$') GROUP BY label")
def issue_checklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").where(F.col("label").rlike("^#[0-9]+$")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


@_query("SELECT task_id, path, line FROM tasks ORDER BY scanned_at, task_id LIMIT 100")
def first_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").orderBy("scanned_at", "task_id").select("task_id", "path", "line").limit(100)


@_query("SELECT coalesce(lang, 'all') AS lang, coalesce(type, 'all') AS type, count(*) AS n FROM tasks WHERE lang IS NOT NULL AND type IS NOT NULL GROUP BY ROLLUP (lang, type)")
def marker_rollup(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "tasks").where("lang is not null and type is not null")
    return known.rollup("lang", "type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("type", F.lit("all")).alias("type"), "n")


# Source files written from columns: what the lexer must find is known from the columns.


def _written(name: str, extension: str, pieces: list[str], expected: str) -> None:
    """A query over files of ``part`` made of ``pieces`` (SQL string expressions); ``expected`` gives (line, label, message)."""
    content = " || ".join(pieces)

    def run(spark: SparkSession, d: str) -> DataFrame:
        files = table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(f".{extension}")).alias("path"), F.expr(content).alias("content"))
        return scan_table(files, keep=("p_partkey",)).select("p_partkey", "line", "type", "label", "message")

    _query(f"SELECT p_partkey, CAST(line AS INTEGER) AS line, type, label, message FROM (SELECT p_partkey, unnest({expected}, recursive := true) FROM part)", name)(run)


_NL = "chr(10)"


def _rows(*rows: tuple[int, str, str, str]) -> str:
    return "[" + ", ".join(f"{{'line': {n}, 'type': '{t}', 'label': {label}, 'message': {message}}}" for n, t, label, message in rows) + "]"


_KEYED = "CAST(p_partkey AS STRING)"
_written("strings_skipped", "go", ["'x := \"// TODO: no '", "p_name", "'\"'", _NL, "'y := `'", _NL, "'// TODO: no` // TODO('", "p_brand", "'): '", "p_name", _NL], _rows((3, "TODO", "p_brand", "p_name")))
_written("escape_char", "c", ["'x = \"a \\\\\\\" // TODO: no\"; // FIXME: '", "p_name", _NL], _rows((1, "FIXME", "''", "p_name")))
_written("escape_double", "sql", ["'SELECT ''it''''s -- TODO: no'' -- BUG('", "p_brand", "'): '", "p_name", _NL], _rows((1, "BUG", "p_brand", "p_name")))
_written("escape_none", "f90", ["'x = \"a\\\\\" ! TODO: '", "p_name", _NL], _rows((1, "TODO", "''", "p_name")))
_written("vim_tie", "vim", ["'let x = \"TODO: no\"'", _NL, "'\" TODO: '", "p_name", _NL, "'\" end of file'", _NL], _rows((2, "TODO", "''", "p_name")))
_written("ruby_block", "rb", ["' =begin'", _NL, "'=begin'", _NL, "'TODO('", "p_brand", "'): '", "p_type", "'.'", _NL, "' =end'", _NL, "'=end'", _NL, "'# TODO: '", "p_name", _NL], _rows((3, "TODO", "p_brand", "p_type || '.'"), (6, "TODO", "''", "p_name")))
_written("lex_overlap", "lua", ["'--[[ TODO: '", "p_name", _NL, "'--]] -- HACK: '", "p_brand", _NL], _rows((1, "TODO", "''", "p_name"), (2, "HACK", "''", "p_brand")))
_written("lex_order", "dart", ["'/// TODO('", "p_brand", "'): '", "p_name", _NL], _rows((1, "TODO", "p_brand", "p_name")))
_written("eof_guard", "ex", ["'# TODO: '", "p_name", _NL, "'x = 1; y = 22222'", _NL, "'# TODO: no'"], _rows((1, "TODO", "''", "p_name")))
_written("at_prefix", "py", ["'# @TODO('", "p_brand", "') - '", "p_name", _NL], _rows((1, "TODO", "p_brand", "p_name")))
_written("javadoc_star", "java", ["'/**'", _NL, "' * @todo: '", "p_name", _NL, "' */'", _NL], _rows((2, "todo", "''", "p_name")))
_written(
    "todo_block",
    "c",
    ["'/* TODO: '", "p_name", _NL, "' * @FIXME('", "p_brand", "'): '", "p_type", _NL, "'   see TODO: no'", _NL, "' HACK - '", "p_name", "' */ x = 1; /* BUG: '", "p_brand", "' */'", _NL],
    _rows((1, "TODO", "''", "p_name"), (2, "FIXME", "p_brand", "p_type"), (4, "HACK", "''", "p_name"), (4, "BUG", "''", "p_brand")),
)
_written("nested_comments", "ml", ["'(* (* TODO: inner *) '", _NL, "'TODO: '", "p_name", "' *)'", _NL, "'let x = 1'", _NL], _rows((2, "TODO", "''", "p_name")))


@_query(
    "SELECT n_nationkey, CAST(2 AS INTEGER) AS line, n_name AS message FROM nation",
    "line_start_only",
)
def _line_start(spark: SparkSession, d: str) -> DataFrame:
    """A hash is a comment in an ignore list only where nothing but white space stands before it."""
    content = F.concat(F.lit("build # TODO: no\n  # TODO: "), F.col("n_name"), F.lit("\n"))
    files = table(spark, d, "nation").select("n_nationkey", F.lit("src/.gitignore").alias("path"), content.alias("content"))
    return scan_table(files, keep=("n_nationkey",)).select("n_nationkey", "line", "message")


@_query("SELECT count(*) AS n FROM tasks WHERE regexp_matches(label, '^(?:core-.*|infra)$')")
def labels_counted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").where(any_glob(F.col("label"), ("core-*", "infra"))).agg(F.count(F.lit(1)).alias("n"))
