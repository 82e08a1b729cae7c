"""Task markers in comments, as column expressions only: no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marker types looked for by default, in the order in which they are tried.
DEFAULT_TYPES = (
    "TODO", "Todo", "todo", "FIXME", "Fixme", "fixme", "FIXIT", "Fixit", "fixit", "BUG", "Bug", "bug", "HACK", "Hack", "hack",
    "ISSUE", "Issue", "issue", "WARN", "Warn", "warn", "WARNING", "Warning", "warning", "XXX", "COMBAK",
)

#: White space in patterns, and the Unicode white space that is trimmed around texts.
_S = r"[\t\n\f\r ]"
_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# What may follow a marker; groups are label, message, lone label, message.
_AFTER_SPACED = rf"{_S}*|\((.*)\)(?:{_S}+[\-/]*|{_S}*:*){_S}*(.*)|\((.*)\){_S}*|{_S}*(?::+|{_S}+[\-/]+){_S}*(.*)"
_AFTER_TIGHT = rf"{_S}*|\((.*)\){_S}*(?:{_S}+[\-/]*|:*){_S}*(.*)|\((.*)\){_S}*|{_S}*(?:{_S}+[\-/]*|:*){_S}*(.*)"


def patterns(types: Sequence[str] = DEFAULT_TYPES) -> dict[str, str]:
    """Java patterns: ``spaced`` and ``tight`` for line comments, ``block`` for a line of a block.

    The dot matches everything but a line feed; the end is the absolute end of the text.
    """
    quoted = "|".join(re.escape(t) for t in types)
    return {
        "spaced": rf"(?d)^{_S}+@?({quoted})({_AFTER_SPACED})\z",
        "tight": rf"(?d)^@?({quoted})({_AFTER_TIGHT})\z",
        "block": rf"(?d)^{_S}*\*?{_S}*@?({quoted})({_AFTER_SPACED})\z",
    }


def trim_space(column: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(column, F.lit(_SPACE))


def _parts(column: Column, pattern: str) -> Column:
    group = [F.regexp_extract(column, pattern, i) for i in range(7)]
    first = lambda a, b: trim_space(F.when(group[a] != "", group[a]).otherwise(group[b]))
    return F.struct(group[1].alias("type"), first(3, 5).alias("label"), first(4, 6).alias("message"))


def _line_parts(text: Column, start: Column, p: dict[str, str]) -> Column:
    bare = F.ltrim(text, start)
    return F.when(bare.rlike(p["spaced"]), _parts(bare, p["spaced"])).when(bare.rlike(p["tight"]), _parts(bare, p["tight"]))


def markers_of(comments: DataFrame, types: Sequence[str] = DEFAULT_TYPES, labels: Sequence[str] = ()) -> DataFrame:
    """One row per task marker in ``comments`` (as ``lexer.comments_of`` gives them).

    A line comment has at most one marker, a block one per line. All columns but text, line,
    multiline, start_tok and end_tok are kept; added are type, text, label, message, line and
    comment_line. ``labels`` are globs of which one must match the whole label. An empty type
    list matches nothing. Null texts give no rows. No shuffle.
    """
    from scholia.functions.globs import any_glob

    kept = [c for c in comments.columns if c not in ("text", "line", "multiline", "start_tok", "end_tok")]
    p = patterns(types)
    # A plain search for each type is faster than any pattern; a type that holds another one is found with it.
    words = [t for t in types if t and not any(o and o != t and o in t for o in types)]
    if not words:
        p = patterns([r"\0"])
    quick = lambda c: reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words], F.lit(False))
    lines = F.posexplode(F.when(F.col("multiline"), F.split(trim_space(F.col("text")), "\n")).otherwise(F.array(trim_space(F.col("text")))))
    each = comments.where(quick(F.col("text"))).select(*kept, "line", "multiline", "start_tok", "end_tok", lines.alias("at", "own"))
    each = each.where(quick(F.col("own")))
    in_block = F.rtrim(F.ltrim(F.col("own"), F.col("start_tok")), F.col("end_tok"))
    part = F.when(F.col("multiline"), F.when(in_block.rlike(p["block"]), _parts(in_block, p["block"]))).otherwise(_line_parts(F.col("own"), F.col("start_tok"), p))
    # A generator between, so that the condition below is not pushed under the patterns and evaluates them again.
    each = each.select("*", F.explode(F.array(part)).alias("part"))
    found = each.where(F.col("part.type") != "").select(
        *kept,
        F.col("part.type").alias("type"),
        trim_space(F.col("own")).alias("text"),
        F.col("part.label").alias("label"),
        F.col("part.message").alias("message"),
        (F.col("line") + F.col("at")).alias("line"),
        F.col("line").alias("comment_line"),
    )
    return found.where(any_glob(F.col("label"), labels)) if labels else found
