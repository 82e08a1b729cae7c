"""Command line: scan a tree and print its task markers."""

from __future__ import annotations

import argparse
import cProfile
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia import __version__
from scholia.api import scan_files, scan_tree
from scholia.functions.charsets import DEFAULT_CHARSET, CharsetError
from scholia.functions.globs import glob_to_regex
from scholia.functions.langs import languages_in
from scholia.functions.reports import REPORTS
from scholia.operators.blame import beyond_authors, with_authors
from scholia.operators.markers import DEFAULT_TYPES
from scholia.sources.gitblame import blame_of
from scholia.sources.walk import IGNORE_FILES, WalkOptions

#: Exit codes: nothing found, found, wrong flags, error while listing or reading, anything else.
NONE_FOUND, FOUND, FLAG_ERROR, WALK_ERROR, UNKNOWN_ERROR = 0, 1, 2, 3, 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scholia", description="Find task markers in the comments of source code.")
    p.add_argument("paths", nargs="*", default=["."], help="files and directories, - for standard input")
    p.add_argument("--blame", action="store_true")
    p.add_argument("-c", "--charset", default=DEFAULT_CHARSET)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--exclude-dir", action="append", default=[])
    p.add_argument("--exclude-hidden", action="store_true")
    p.add_argument("--follow", action="store_true")
    p.add_argument("--ignore-file-name", action="append", default=[])
    p.add_argument("--include-vcs", action="store_true")
    p.add_argument("--include-generated", action="store_true")
    p.add_argument("--include-vendored", action="store_true")
    p.add_argument("--languages", default=None, help="a list of languages with further file names and extensions")
    p.add_argument("-l", "--label", action="append", default=[])
    p.add_argument("-g", "--language", default=None)
    p.add_argument("--no-error-on-unsupported", action="store_true")
    p.add_argument("-o", "--output", default="", choices=["", *REPORTS])
    p.add_argument("--profile", default=None, metavar="FILE", help="write a CPU profile of the driver to FILE; tasks are seen in Spark's own interface")
    p.add_argument("--todo-types", default=None)
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        a = parser().parse_args(argv)
        for glob in (*a.exclude, *a.exclude_dir, *a.label):
            glob_to_regex(glob)
    except SystemExit as e:
        return FLAG_ERROR if e.code else NONE_FOUND
    except ValueError as e:
        print(f"scholia: {e}", file=err)
        return FLAG_ERROR
    try:
        spark = spark or SparkSession.builder.appName("scholia").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        if not a.profile:
            return _scan(a, spark, out, err)
        profile = cProfile.Profile()
        try:
            return profile.runcall(_scan, a, spark, out, err)
        finally:
            profile.dump_stats(a.profile)
    except Exception as e:
        print(f"scholia: unexpected error: {e}", file=err)
        return UNKNOWN_ERROR


def _stdin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("stdin", True, bytearray(sys.stdin.buffer.read()), None)], "path string, explicit boolean, content binary, error string")


def _scan(a: argparse.Namespace, spark: SparkSession, out, err) -> int:
    types = DEFAULT_TYPES if a.todo_types is None else [t.strip() for t in a.todo_types.split(",")]
    walk = WalkOptions(a.exclude, a.exclude_dir, a.exclude_hidden, a.include_vcs, a.include_vendored, a.follow, a.ignore_file_name or IGNORE_FILES)
    try:
        extra = None
        if a.languages:
            with open(a.languages, encoding="utf-8") as f:
                extra = languages_in(f.read())
        scans = []
        if "-" in a.paths:
            scans.append(scan_files(_stdin(spark), types, a.label, a.charset, a.language, True, not a.no_error_on_unsupported, extra=extra))
        if named := [p for p in a.paths if p != "-"]:
            scans.append(scan_tree(spark, named, walk, types, a.label, a.charset, a.language, a.include_generated, not a.no_error_on_unsupported, extra=extra))
    except (CharsetError, ValueError, OSError) as e:
        print(f"scholia: {e}", file=err)
        return FLAG_ERROR
    tasks, errors = (reduce(DataFrame.unionByName, side) for side in zip(*scans))
    user = None
    if a.blame:
        # Asked for three times: for its paths, its lines and its errors.
        tasks = tasks.persist()
        lines = blame_of(tasks).persist()
        errors = errors.unionByName(beyond_authors(tasks, lines))
        tasks, user = with_authors(tasks, lines), F.col("git_user")
    report = a.output or ("github" if os.environ.get("GITHUB_ACTIONS") == "true" else "default")
    coloured = out.isatty() and not os.environ.get("NO_COLOR")
    found = failed = False
    # Rows come partition by partition, so the driver holds one partition at a time.
    for row in tasks.orderBy("path", "line").select(REPORTS[report](user, coloured).alias("v")).toLocalIterator():
        found = True
        print(row.v, file=out)
    for row in errors.orderBy("path", "message").toLocalIterator():
        failed = True
        print(f"scholia: {row.path}: {row.message}", file=err)
    return WALK_ERROR if failed else FOUND if found else NONE_FOUND


if __name__ == "__main__":
    sys.exit(main())
