"""The lexer: source text to comments and string literals.

Between tokens a compiled search jumps to the next place where any rule's start stands; only there
are the rules weighed against each other. Line and column flags follow the characters that were
read one by one, not delimiters that were skipped as a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.langs import Block, Line, Rules, Str, by_alias, language_of, rules_of


class Token(NamedTuple):
    """``kind`` is line, block or string; ``text`` has its delimiters."""

    kind: str
    text: str
    line: int
    start: str
    end: str | None


_NOT_SPACE = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=256)
def _search(starts: tuple[str, ...]):
    return re.compile("|".join(map(re.escape, sorted(starts, key=len, reverse=True)))).search


@lru_cache(maxsize=256)
def _closing(rule: Str):
    end = re.escape(rule.end)
    escaped = {"": "", "double": end + end}.get(rule.escape, re.escape(rule.escape) + end)
    return re.compile(f"({escaped})|{end}" if escaped else f"(?!)()|{end}")


class _Cursor:
    """Flags and line number after the characters read so far."""

    __slots__ = ("text", "line", "line_start", "first_column")

    def __init__(self, text: str):
        self.text, self.line, self.line_start, self.first_column = text, 1, True, True

    def read(self, a: int, b: int) -> None:
        if b <= a:
            return
        text = self.text
        newline = text.rfind("\n", a, b)
        if newline >= 0:
            self.line += text.count("\n", a, b)
            self.first_column = newline == b - 1
            self.line_start = not _NOT_SPACE.search(text, newline + 1, b)
        else:
            self.first_column = False
            if self.line_start and _NOT_SPACE.search(text, a, b):
                self.line_start = False


def _first(rules: tuple, text: str, at: int, usable) -> tuple[object | None, int]:
    """The first rule of a kind that starts here, and the longest start looked at to find out."""
    looked = 0
    for rule in rules:
        looked = max(looked, len(rule.start))
        if text.startswith(rule.start, at) and usable(rule):
            return rule, looked
    return None, looked


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    if end < 0:
        return len(text)
    return end - 1 if end > at and text[end - 1] == "\r" else end


def scan(text: str, rules: Rules) -> Iterator[Token]:
    """Comments and closed string literals in source order.

    A comment can only begin where every start looked at still fits before the end of the text;
    an unterminated block or string swallows the rest of the text.
    """
    if not rules.starts:
        return
    search, longest, size = _search(rules.starts), max(map(len, rules.starts)), len(text)
    cursor, at = _Cursor(text), 0
    while True:
        found = search(text, at)
        if not found or (found.start() > at and size - (found.start() - 1) < longest):
            return
        cursor.read(at, found.start())
        at = found.start()
        line, a = _first(rules.lines, text, at, lambda r: not r.at_line_start or cursor.line_start)
        block, b = _first(rules.blocks, text, at, lambda r: not r.at_first_column or cursor.first_column)
        string, c = _first(rules.strings, text, at, lambda r: True)
        if size - at < max(a, b, c):
            return
        most = max(len(r.start) if r else 0 for r in (line, block, string))
        if not most:
            cursor.read(at, at + 1)
            at += 1
            continue
        if block and len(block.start) == most:
            first_line = cursor.line
            end = _block_end(text, at, block, cursor)
            if end is None:
                return
            yield Token("block", text[at:end], first_line, block.start, block.end)
            at = end
        elif line and len(line.start) == most:
            end = _line_end(text, at)
            if string and len(string.start) == most:
                close = _string_end(text, at, string, cursor, end)
                if close is not None:
                    yield Token("string", text[at:close], cursor.line, string.start, string.end)
                    at = close
                    continue
            else:
                cursor.read(at, end)
            yield Token("line", text[at:end], cursor.line, line.start, None)
            at = end
        else:
            first_line = cursor.line
            close = _string_end(text, at, string, cursor, size)
            if close is None:
                return
            yield Token("string", text[at:close], first_line, string.start, string.end)
            at = close


def _string_end(text: str, at: int, rule: Str, cursor: _Cursor, limit: int) -> int | None:
    """Where the string that starts at ``at`` closes before ``limit``; reads its body."""
    p = at + len(rule.start)
    for m in _closing(rule).finditer(text, p, limit):
        cursor.read(p, m.start())
        p = m.end()
        if m.group(1) is None:
            return p
    cursor.read(p, limit)
    return None


def _block_end(text: str, at: int, rule: Block, cursor: _Cursor) -> int | None:
    p, depth = at + len(rule.start), 0
    if not rule.nested and not rule.at_first_column:
        end = text.find(rule.end, p)
        if end < 0:
            return None
        cursor.read(p, end)
        return end + len(rule.end)
    search = _search((rule.start, rule.end) if rule.nested else (rule.end,))
    while True:
        found = search(text, p)
        if not found:
            return None
        cursor.read(p, found.start())
        p = found.start()
        here = not rule.at_first_column or cursor.first_column
        if here and rule.nested and text.startswith(rule.start, p):
            p += len(rule.start)
            depth += 1
            continue
        if here and text.startswith(rule.end, p):
            p += len(rule.end)
            if depth == 0:
                return p
            depth -= 1
        # After an inner close one more character is read before anything is looked for again.
        if p >= len(text):
            return None
        cursor.read(p, p + 1)
        p += 1


def comments_of(
    df: DataFrame,
    path_col: str = "path",
    content_col: str = "content",
    keep: tuple[str, ...] = (),
    lang: str | None = None,
    lang_col: str | None = None,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """One row per comment: kept columns, path, lang, text, line, multiline, start_tok, end_tok.

    The language is ``lang`` (an alias), else the alias in ``lang_col`` where that is known, else
    found from path and content. Null, empty and unsupported files give no rows. Files are
    independent, so there is no shuffle; contents travel in small Arrow batches.
    """
    if lang is not None and by_alias(lang) is None:
        raise ValueError(f"unsupported language: {lang!r}")
    names = [*keep, "path", "lang", "text", "line", "multiline", "start_tok", "end_tok"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "path string, lang string, text string, line int, multiline boolean, start_tok string, end_tok string"])

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            paths, contents, langs = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            source, out = [], []
            for i, (path, content, named) in enumerate(zip(paths, contents, langs)):
                if not content:
                    continue
                language = by_alias(lang) if lang else named and by_alias(named) or language_of(path, content, extra)
                rules = rules_of(language)
                if rules is None:
                    continue
                for t in scan(content, rules):
                    if t.kind != "string":
                        source.append(i)
                        out.append((path, language, t.text, t.line, t.kind == "block", t.start, t.end))
            rows = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            taken = pa.array(source, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in columns), *(pa.array(list(v), k) for v, k in zip(rows, kinds))], names)

    named = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return df.select(*keep, F.col(path_col).alias("__path"), F.col(content_col).alias("__content"), named.alias("__lang")).mapInArrow(lex, schema)
