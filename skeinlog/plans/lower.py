"""Trees of the query language as columns over records and sources.

Records decide in two values: every leaf is false where its field is missing, so NOT of it is true. Sources
decide in three: what a source does not know leaves it in.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions.text import fold, fold_text, glob_regex, is_glob, matches
from skeinlog.plans.query import All, Any_, Between, Compare, Equals, Exists, Node, Not, Term, instant, window

#: Fields that a term looks into.
SURFACE = ("text", "title", "role", "model", "path")
#: A written time that counts as one; fixed value.
ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::?\d\d(?::?\d\d(?:[.,]\d+)?)?)?(?:Z|[+-]\d\d(?::?\d\d)?)?)?$"


def moment(col: Column) -> Column:
    """The instant of a written time; null for what is none."""
    return F.when(col.rlike(ISO), col.try_cast("timestamp"))


def _all(parts: list[Column], none: bool) -> Column:
    out = F.lit(none)
    for k, p in enumerate(parts):
        out = p if k == 0 else out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for k, p in enumerate(parts):
        out = p if k == 0 else out | p
    return out


def _sure(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _at(when: datetime) -> Column:
    return F.lit(when)


def _dated(at: Column, node: Node) -> Column:
    if isinstance(node, Equals):
        low, high = window(node.value)
        return at == _at(low) if low == high else (at >= _at(low)) & (at < _at(high))
    if isinstance(node, Compare):
        bound = _at(instant(node.value))
        return {">": at > bound, ">=": at >= bound, "<": at < bound, "<=": at <= bound}[node.op]
    parts = []
    if node.low != "*":
        parts.append(at >= _at(instant(node.low)) if node.low_in else at > _at(instant(node.low)))
    if node.high != "*":
        parts.append(at <= _at(instant(node.high)) if node.high_in else at < _at(instant(node.high)))
    return _all([at.isNotNull(), *parts], True)


def path_matches(path: Column, pattern: str) -> Column:
    """A shell pattern over the whole path, case counting, or a substring; ``~`` is the home directory too."""
    variants = [pattern]
    if pattern == "~" or pattern.startswith("~/"):
        variants.append(os.path.expanduser("~") + pattern[1:])
    if any(is_glob(v, True) for v in variants):
        return _sure(_any([path.rlike(glob_regex(v)) for v in variants]))
    return _sure(_any([F.contains(path, F.lit(v)) for v in variants]))


def descends(path: Column, value: str) -> Column:
    """Whether a path is the given directory or below it; a glob matches the whole path."""
    if is_glob(value):
        return _sure(fold(path).rlike(glob_regex(fold_text(value))))
    target = value.replace("\\", "/").rstrip("/") or "/"
    if target == "~" or target.startswith("~/"):
        target = os.path.expanduser("~") + target[1:]
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    return _sure((plain == target) | plain.startswith(target.rstrip("/") + "/"))


def same_whole(col: Column, value: str) -> Column:
    """Equal but for case; a glob matches the whole value."""
    needle = fold_text(value)
    return _sure(fold(col).rlike(glob_regex(needle)) if is_glob(value) else fold(col, needle) == needle)


def _origin(name: str) -> Column:
    return F.col(f"origin.{name}")


def _project(value: str) -> Column:
    parts = []
    for name in ("repo", "worktree", "cwd"):
        parts += [same_whole(_origin(name), value), same_whole(F.regexp_extract(_origin(name), r"([^/\\]+)[/\\]*$", 1), value)]
    return _any(parts)


def in_scope(scope: str) -> Column:
    """Prompts by kind, conversations by the role of the store (column ``store_role``), all."""
    if scope == "prompts":
        return F.col("kind") == "prompt"
    return F.lit(True) if scope == "all" else F.col("store_role").isin("primary_chat", "supplementary_chat")


def term(text: str, case_sensitive: bool = False, columns: tuple[str, ...] = SURFACE) -> Column:
    """A substring in one of the columns; a glob is no wildcard here."""
    needle = text if case_sensitive else fold_text(text)
    return _any([_sure(F.contains(F.col(c) if case_sensitive else fold(F.col(c), needle), F.lit(needle))) for c in columns])


def records(node: Node, case_sensitive: bool = False) -> Column:
    """Whether a record satisfies a tree; never null."""
    if isinstance(node, Not):
        return ~records(node.of, case_sensitive)
    if isinstance(node, All):
        return _all([records(n, case_sensitive) for n in node.of], True)
    if isinstance(node, Any_):
        return _any([records(n, case_sensitive) for n in node.of])
    if isinstance(node, Term):
        return term(node.text, case_sensitive)
    name = node.name
    if name == "depth":
        return F.lit(True)
    if isinstance(node, Exists):
        if name in ("agent", "store", "adapter_id", "mtime", "scope", "kind"):
            return F.lit(True)
        if name == "project":
            return _any([_sure(F.length(_origin(c)) > 0) for c in ("repo", "worktree", "cwd")])
        col = _origin(name) if name in ("cwd", "repo", "worktree", "branch", "cwd_hash") else F.col(name)
        return _sure(F.length(col) > 0)
    if name == "timestamp":
        return _sure(_dated(moment(F.col("timestamp")), node))
    if name == "mtime" or not isinstance(node, Equals):
        return F.lit(False)
    value = node.value
    if name in ("agent", "kind"):
        return _sure(F.col(name) == value.lower())
    if name == "scope":
        return _sure(in_scope(value.lower()))
    if name == "path":
        return path_matches(F.col("path"), value)
    if name in ("cwd", "repo", "worktree"):
        return descends(_origin(name), value)
    if name in ("branch", "cwd_hash"):
        return same_whole(_origin(name), value)
    if name == "project":
        return _project(value)
    return matches(F.col(name), value, case_sensitive if name == "text" else False)


def sources(node: Node) -> Column:
    """Whether a source may hold what a tree wants: true, false, or null where only its records can tell."""
    unknown = F.lit(None).cast("boolean")
    if isinstance(node, Not):
        return ~sources(node.of)
    if isinstance(node, All):
        return _all([sources(n) for n in node.of], True)
    if isinstance(node, Any_):
        return _any([sources(n) for n in node.of])
    if isinstance(node, Term):
        return unknown
    name = node.name
    if isinstance(node, Exists):
        return F.lit(True) if name in ("agent", "store", "adapter_id", "path") else F.coalesce(F.col("mtime_ns") > 0, F.lit(False)) if name == "mtime" else unknown
    if name == "mtime":
        at = F.when(F.col("mtime_ns") > 0, F.timestamp_micros(F.call_function("div", F.col("mtime_ns"), F.lit(1000).cast("bigint"))))
        return _sure(_dated(at, node))
    if name == "agent":
        return F.col("agent") == node.value.lower()
    if name == "path":
        return path_matches(F.col("path"), node.value)
    return matches(F.col(name), node.value) if name in ("store", "adapter_id") else unknown


def may_hold(node: Node) -> Column:
    """Keeps a source unless the tree is certainly false for it."""
    return F.coalesce(sources(node), F.lit(True))
