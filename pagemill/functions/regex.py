"""Regular expressions with the meaning of ASCII-only patterns, on Spark's engine.

Patterns are written for a dialect in which ``\\b``, ``\\w``, ``\\d`` and ``\\s`` know
ASCII only and only ``\\n`` ends a line. ``java_pattern`` rewrites one for Spark;
a pattern that does not compile is found on the driver, never in a task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_EDGE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|.", re.DOTALL)


def groups(pattern: str) -> int | None:
    """Number of capturing groups, or None if the pattern does not compile."""
    try:
        return re.compile(pattern, re.ASCII).groups
    except re.error:
        return None


def _java_class(text: str) -> str:
    """A bracketed class in which Java's own operators, [ and &&, are plain characters."""
    inner = text[1:-1]
    head, inner = ("[^", inner[1:]) if inner.startswith("^") else ("[", inner)
    one = lambda m: {"\\b": r"\x08", "[": r"\[", "]": r"\]", "&": r"\&"}.get(m[0], m[0])
    return head + re.sub(r"\\.|.", one, inner, flags=re.DOTALL) + "]"


def java_pattern(pattern: str, flags: str = "") -> str:
    """``pattern`` for Spark. flags: of i (ASCII case) and s (dot takes line ends)."""
    name = lambda x: "g" + x.replace("_", "X")
    tokens = [m for m in _TOKEN.finditer(pattern)]
    plain = not re.search(r"\\[xuU0-9]", pattern)  # else a digit may be part of an escape

    def word(i: int) -> bool:
        """Whether token i is one character of a word, whatever it is repeated by ahead."""
        return plain and 0 <= i < len(tokens) and re.fullmatch(r"[A-Za-z0-9_]|\\[wd]", tokens[i][0]) is not None

    out, i = [], 0
    while i < len(tokens):
        m = tokens[i]
        once = i + 2 >= len(tokens) or tokens[i + 2][0] not in "?*+{"
        if m[0] == "\\b" and word(i + 1) and once:
            # The character first and what is before it then: most places fail at the first test.
            out.append(tokens[i + 1][0] + "(?<![A-Za-z0-9_].)")
            i += 1
        elif m[0] == "\\b" and (word(i - 1) or (i > 1 and tokens[i - 1][0] == "+" and word(i - 2))):
            out.append("(?![A-Za-z0-9_])")
        elif m[1]:
            out.append(f"(?<{name(m[1])}>")
        elif m[2]:
            out.append(f"\\k<{name(m[2])}>")
        elif m[0][0] == "[" and len(m[0]) > 1:
            out.append(_java_class(m[0]))
        else:
            out.append({"\\b": WORD_EDGE, "\\B": NO_EDGE, "\\Z": "\\z"}.get(m[0], m[0]))
        i += 1
    return f"(?d{flags})" + "".join(out)


def match_count(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, case ignored. An empty pattern matches once more than there are characters."""
    return F.regexp_count(text, F.lit(java_pattern(pattern, "i"))).cast("long")


def match_exists(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(java_pattern(pattern, "i"))).cast("long")


def found_joined(text: Column, pattern: str) -> Column:
    """All matches (or all of the one group) with blanks between; "" for a bad pattern."""
    n = groups(pattern)
    if n is None:
        return F.lit("")
    if n > 1:
        raise ValueError(f"at most one group is allowed: {pattern}")
    return F.array_join(F.regexp_extract_all(text, F.lit(java_pattern(pattern, "is")), F.lit(n)), " ")


def between(text: Column, after: str, before: str) -> Column:
    """The shortest text between the first match of ``after`` and ``before``, each the text's edge if empty."""
    after, before = after or "^", before or "$"
    if groups(f"{after}(.*?){before}") is None or (n := groups(after)) is None:
        return F.lit("")
    return F.regexp_extract(text, java_pattern(f"{after}(.*?){before}", "s"), n + 1)


def without_tags(text: Column) -> Column:
    """Tags that end on their line go."""
    return F.regexp_replace(text, java_pattern("<.*?>"), "")


def stripped(text: Column) -> Column:
    """No white space at either end."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+\z", "")


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, case counting; one pass over the text."""
    return F.rlike(text, F.lit("|".join(f"(?:{java_pattern(p)})" for p in patterns))) if patterns else F.lit(False)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
