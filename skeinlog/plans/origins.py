"""Same project, same place: tests on the origin of records, and what the origins of a source rule out."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.plans.lower import descends, same_whole
from skeinlog.plans.query import Equals

FIELDS = ("cwd", "repo", "worktree", "branch", "cwd_hash")
#: Fields of a record that may hold what an origin says of one field; fixed values.
HELD_BY = {"branch": ("branch",), "cwd": ("cwd",), "repo": ("repo", "worktree", "cwd"), "worktree": ("worktree", "cwd"), "cwd_hash": ("cwd_hash",)}
PATHS = ("cwd", "repo", "worktree")


def filters(**given: str | None) -> list[Equals]:
    """Query nodes for explicit filters on an origin; blank and missing ones give none."""
    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"no field of an origin: {sorted(unknown)}")
    return [Equals(name, given[name]) for name in FIELDS if given.get(name) and given[name].strip()]


def whole_path(value: str, here: str | None = None) -> str | None:
    """A path filter as an absolute path: ``~`` is the home directory, relative ones start ``here``; blank gives none, a glob stays."""
    text = value.strip()
    if not text or any(c in text for c in "*?["):
        return text or None
    text = os.path.expanduser(text) if text == "~" or text.startswith("~/") else text
    return os.path.normpath(text if os.path.isabs(text) else os.path.join(here or os.getcwd(), text))


def _one(field: str, value: str, values: list[Column]) -> Column:
    test = descends if field in PATHS else same_whole
    return reduce(lambda a, b: a | b, [test(v, value) for v in values])


def _held(field: str, value: str) -> Callable[[Column], Column]:
    return lambda o: _one(field, value, [o[h] for h in HELD_BY[field]])


def same_project(origin: dict[str, str | None], column: str = "origin") -> Column:
    """Whether a record comes from the place that ``origin`` describes: everything it says holds. One that says nothing matches nothing."""
    said = [(f, origin[f]) for f in FIELDS if origin.get(f)]
    if not said:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [_one(f, v, [F.col(f"{column}.{h}") for h in HELD_BY[f]]) for f, v in said])


def may_hold(origin: dict[str, str | None], origins: str = "origins", complete: str = "complete_fields") -> Column:
    """Whether a source may hold such records: true, false, or null where its summary does not tell.

    ``origins`` is an array of origins, ``complete`` the fields of which it lists all. Only a complete list rules a
    source out. An origin that says nothing rules nothing out.
    """
    said = [(f, origin[f]) for f in FIELDS if origin.get(f)]
    states = []
    for field, value in said:
        held = F.exists(F.col(origins), _held(field, value))
        listed = reduce(lambda a, b: a & b, [F.array_contains(complete, h) for h in HELD_BY[field]])
        states.append(F.when(held, True).when(listed, False))
    return reduce(lambda a, b: a & b, states, F.lit(True))
