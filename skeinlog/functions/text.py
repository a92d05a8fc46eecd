"""Text predicates as columns: folded substrings, globs and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What full case folding does beyond lower case, letter by letter, from Unicode's own table.
FOLDED = {low: low.casefold() for low in (chr(p).lower() for p in range(0x20000) if not 0xD800 <= p < 0xE000) if len(low) == 1 and low.casefold() != low}
_ONE = {a: b for a, b in FOLDED.items() if len(b) == 1}
_MANY = {a: b for a, b in FOLDED.items() if len(b) > 1}


def fold(col: Column, needle: str | None = None) -> Column:
    """Case folding: lower case, and the letters of FOLDED; those that fold to several only where a text has one.

    With a folded ``needle`` that the result is searched for or compared with, letters whose folded forms have nothing
    in common with it stay: they are in no match either way.
    """
    out = F.translate(F.lower(col), "".join(_ONE), "".join(_ONE.values()))
    many = {a: b for a, b in _MANY.items() if needle is None or set(b) & set(needle)}
    if not many:
        return out
    several = out
    for a, b in many.items():
        several = F.replace(several, F.lit(a), F.lit(b))
    return F.when(out.rlike(f"[{''.join(many)}]"), several).otherwise(out)


def fold_text(text: str) -> str:
    """The same for a needle."""
    return "".join(FOLDED.get(c, c) for c in text.lower())


def is_glob(value: str, classes: bool = False) -> bool:
    """Whether a value has wildcards."""
    return any(c in value for c in ("*?[" if classes else "*?"))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern: ``*``, ``?`` and, where closed, ``[...]``."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]")
            k = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def matches(col: Column, value: str, case_sensitive: bool = False) -> Column:
    """Substring, or the whole where the value is a glob; null text does not match."""
    needle = value if case_sensitive else fold_text(value)
    side = col if case_sensitive else fold(col, None if is_glob(value) else needle)
    found = side.rlike(glob_regex(needle)) if is_glob(value) else F.contains(side, F.lit(needle))
    return F.coalesce(found, F.lit(False))


def java_regex(pattern: str, case_sensitive: bool = True) -> str:
    """A pattern in the dialect of the JVM; raises re.error for what is no pattern."""
    re.compile(pattern)
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = out.replace(r"\Z", r"\z")
    return ("(?U)" if case_sensitive else "(?iuU)") + out


def literal_regex(text: str) -> str:
    """A pattern for exactly this text."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def smart_case(patterns: list[str]) -> bool:
    """Whether case counts: where some pattern has an upper-case letter."""
    return any(c.isupper() for p in patterns for c in p)
