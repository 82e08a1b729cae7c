"""Output lines of task rows: plain text, CI annotations and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity of a marker in CI annotations; any other type is a notice.
WARNINGS = ("TODO", "HACK", "COMBAK")
ERRORS = ("FIXME", "XXX", "BUG")


def severity(kind: Column) -> Column:
    return F.when(kind.isin(*WARNINGS), "warning").when(kind.isin(*ERRORS), "error").otherwise("notice")


#: Escape sequences of a terminal: path, line number and author, separators, back to plain.
_PATH, _LINE, _MARK, _PLAIN = "\x1b[35m", "\x1b[32m", "\x1b[36m", "\x1b[0m"


def plain_line(user: Column | None = None, coloured: bool = False) -> Column:
    """``path:line:[name[ <email>]:]text``; the address is left out where there is none."""
    address = F.when(F.coalesce(user["email"], F.lit("")) != "", F.concat(F.lit(" <"), user["email"], F.lit(">"))) if user is not None else None
    who = F.lit(None).cast("string") if user is None else F.when(user.isNotNull(), F.concat(F.coalesce(user["name"], F.lit("")), F.coalesce(address, F.lit(""))))
    if not coloured:
        return F.concat_ws(":", "path", F.col("line").cast("string"), who, "text")
    paint = lambda c, tone: F.concat(F.lit(tone), c, F.lit(_PLAIN))
    return F.concat_ws(f"{_MARK}:{_PLAIN}", paint(F.col("path"), _PATH), paint(F.col("line").cast("string"), _LINE), paint(who, _LINE), "text")


def github_line() -> Column:
    """``::severity file=path,line=n::text``"""
    return F.concat(F.lit("::"), severity(F.col("type")), F.lit(" file="), F.col("path"), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), F.col("text"))


def json_line(user: Column | None = None) -> Column:
    """One JSON object; fields in fixed order, the author left out when null, ``<>&`` escaped."""
    fields = [F.col(c) for c in ("path", "type", "text", "label", "message", "line", "comment_line")]
    if user is not None:
        fields.append(user.alias("git_user"))
    out = F.to_json(F.struct(*fields))
    for c in "&<>":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


REPORTS = {"default": plain_line, "github": lambda user=None, coloured=False: github_line(), "json": lambda user=None, coloured=False: json_line(user)}
