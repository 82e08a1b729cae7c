"""Scanning source files for task markers, from a table or from a file tree."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.charsets import DEFAULT_CHARSET, DETECT, CharsetError, decode, resolve
from scholia.functions.langs import by_alias, language_of, rules_of
from scholia.operators import blame as authors
from scholia.operators import paths as path_rules
from scholia.operators.lexer import comments_of
from scholia.operators.markers import DEFAULT_TYPES, markers_of
from scholia.sources import codefiles
from scholia.sources.walk import WalkOptions

OUTPUT = ("path", "type", "text", "label", "message", "line", "comment_line")


def scan_table(
    files: DataFrame,
    path_col: str = "path",
    content_col: str = "content",
    keep: Sequence[str] = (),
    types: Sequence[str] = DEFAULT_TYPES,
    labels: Sequence[str] = (),
    lang: str | None = None,
    lang_col: str | None = None,
    include_generated: bool = False,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Task markers of a table of decoded files: kept columns and the output columns, without a shuffle.

    Generated files are left out unless asked for. Kept columns must not be named like output ones.
    """
    if not include_generated:
        files = files.where(~path_rules.generated(F.col(path_col), F.col(content_col)))
    comments = comments_of(files, path_col, content_col, tuple(keep), lang, lang_col, extra)
    return markers_of(comments, types, labels).select(*keep, *OUTPUT)


def _decoded(files: DataFrame, charset: str, lang: str | None, extra: dict[str, str] | None) -> DataFrame:
    """Text and language of each file, or the reason why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, explicit, content, error in zip(*(c.to_pylist() for c in batch.columns)):
                text = language = None
                if error is None and b"\0" in content[:8000] and not (charset not in (DETECT, DEFAULT_CHARSET) or content[:2] in (b"\xff\xfe", b"\xfe\xff")):
                    error = "binary file"
                if error is None:
                    try:
                        text = decode(content, charset)
                    except CharsetError as e:
                        error = str(e)
                if text is not None:
                    language = by_alias(lang) if lang else language_of(path, text, extra)
                    if rules_of(language) is None:
                        text, error = None, f"unsupported language: {language or 'unknown'}"
                out.append((path, explicit, text, language, error))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "explicit", "text", "lang", "error"])

    return files.select("path", "explicit", "content", "error").mapInArrow(run, "path string, explicit boolean, text string, lang string, error string")


def scan_tree(
    spark: SparkSession,
    paths: Sequence[str],
    options: WalkOptions | None = None,
    types: Sequence[str] = DEFAULT_TYPES,
    labels: Sequence[str] = (),
    charset: str = DEFAULT_CHARSET,
    lang: str | None = None,
    include_generated: bool = False,
    error_on_unsupported: bool = True,
    blame: DataFrame | None = None,
    extra: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tasks, errors) of a file tree.

    ``errors`` has path and message: missing paths, folders and files that cannot be read, loops of
    links, unsupported charsets, for files named explicitly binary and unsupported ones, and tasks
    on lines that a file's authors do not reach. ``blame`` (path, line, name, email) adds the author.
    """
    if charset != DETECT:
        resolve(charset)
    if lang is not None and by_alias(lang) is None:
        raise ValueError(f"unsupported language: {lang!r}")
    options = options or WalkOptions()
    codefiles.register(spark)
    o = asdict(options)
    files = (
        spark.read.format("codefiles")
        .option("paths", json.dumps(list(paths) or ["."]))
        .option("exclude", json.dumps(list(o["exclude"])))
        .option("excludedir", json.dumps(list(o["exclude_dirs"])))
        .option("excludehidden", str(options.exclude_hidden).lower())
        .option("includevcs", str(options.include_vcs).lower())
        .option("includevendored", str(options.include_vendored).lower())
        .option("follow", str(options.follow).lower())
        .option("ignorefiles", json.dumps(list(options.ignore_files)))
        .load()
    )
    return scan_files(files, types, labels, charset, lang, include_generated, error_on_unsupported, blame, extra)


def scan_files(files: DataFrame, types=DEFAULT_TYPES, labels=(), charset=DEFAULT_CHARSET, lang=None, include_generated=False, error_on_unsupported=True, blame=None, extra=None) -> tuple[DataFrame, DataFrame]:
    """(tasks, errors) of files as bytes: path, explicit, content, error; ``scan_tree`` without the listing."""
    text = _decoded(files, charset, lang, extra)
    told = F.col("error").isNotNull() & (F.col("explicit") & F.lit(error_on_unsupported) | ~F.col("error").rlike("^(?:binary|unsupported language)"))
    errors = text.where(told).select("path", F.col("error").alias("message"))
    readable = text.where("error is null")
    if not include_generated:
        readable = readable.where(F.col("explicit") | ~path_rules.generated(F.col("path"), F.col("text")))
    tasks = markers_of(comments_of(readable, "path", "text", (), lang, "lang"), types, labels).select(*OUTPUT)
    if blame is not None:
        errors = errors.unionByName(authors.beyond_authors(tasks, blame))
        tasks = authors.with_authors(tasks, blame)
    return tasks, errors
