"""Shell globs as regular expressions that mean the same to Java, Python and RE2."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` match any character, also a slash; ``[abc]``, ``[!a-z]``, ``{x,y}`` and backslash work.

    The result is not anchored. A malformed glob raises ValueError.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "\\":
            if i == len(glob):
                raise ValueError(f"glob ends in a backslash: {glob!r}")
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            negated = glob[i : i + 1] in ("!", "^")
            i += negated
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in glob: {glob!r}")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", glob[i:end])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"unclosed brace in glob: {glob!r}")
    return "".join(out)


def any_glob(column: Column, globs: Sequence[str]) -> Column:
    """Whether one of ``globs`` matches the whole of ``column``; false for null."""
    whole = "|".join(glob_to_regex(g) for g in globs)
    return F.coalesce(column.rlike(rf"^(?:{whole})\z"), F.lit(False)) if globs else F.lit(False)
