"""Deeply nested records to related flat tables (problem 6).

Nested columns are shredded into one sequence per leaf: values with a repetition level (which repeated
ancestor starts anew) and a definition level (how much of the path exists). The table of any repeated
ancestor is then reconstructed from the level sequences alone. All of it runs on Arrow buffers, batch by
batch, without a shuffle; a record is never held twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Leaf:
    """The level sequences of one leaf path. ``lists`` has the definition level of an element of each list above."""

    rep: np.ndarray
    definition: np.ndarray
    index: np.ndarray  # into values, -1 where undefined
    values: pa.Array
    lists: list[int]
    most: int  # definition level of a value that exists


def shred(column: pa.Array, name: str = "") -> dict[str, Leaf]:
    """Level sequences of every leaf below ``column``; paths are dotted, lists add no name."""
    n = len(column)
    out: dict[str, Leaf] = {}
    _shred(column, name, np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n), 0, [], out)
    return out


def _shred(arr: pa.Array, path: str, rep: np.ndarray, dl: np.ndarray, at: np.ndarray, level: int, lists: list[int], out: dict[str, Leaf]) -> None:
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    here = at >= 0
    here[here] = valid[at[here]]
    kind = arr.type
    if pa.types.is_struct(kind):
        at, dl = np.where(here, at, -1), dl + here.astype(np.int16)
        if kind.num_fields == 0:
            out[path] = Leaf(rep, dl, np.full(len(at), -1), pa.nulls(len(arr)), lists, level + 1)
        for k in range(kind.num_fields):
            child = arr.field(k)
            _shred(child, f"{path}.{kind.field(k).name}".lstrip("."), rep, dl, at, level + 1, lists, out)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[here] = offsets[at[here]]
        size[here] = offsets[at[here] + 1] - start[here]
        times = np.maximum(size, 1)
        row = np.repeat(np.arange(len(at)), times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        filled = size[row] > 0
        new_rep = np.where(nth == 0, rep[row], len(lists) + 1).astype(np.int16)
        new_dl = (dl + here.astype(np.int16))[row] + filled.astype(np.int16)
        new_at = np.where(filled, start[row] + nth, -1)
        _shred(arr.values, path, new_rep, new_dl, new_at, level + 2, [*lists, level + 2], out)
    else:
        out[path] = Leaf(rep, dl + here.astype(np.int16), np.where(here, at, -1), arr, lists, level + 1)


@dataclass
class Rows:
    """A table reconstructed for one repeated ancestor."""

    slot: np.ndarray  # number of the parent's slot, counted over all parents
    pos: np.ndarray  # place in the array, null elements counted
    filled: np.ndarray  # false where the element is null
    own: np.ndarray  # number of the element's own slot


def assemble(leaf: Leaf, depth: int) -> Rows:
    """The elements of the ``depth``-th list above ``leaf`` (1 is the outermost), from its levels."""
    first = np.flatnonzero(leaf.rep <= depth)
    rep, dl = leaf.rep[first], leaf.definition[first]
    starts = rep < depth
    slot = np.cumsum(starts) - 1
    begin = np.flatnonzero(starts)
    pos = np.arange(len(first)) - begin[slot] if len(first) else np.zeros(0, np.int64)
    exists = dl >= leaf.lists[depth - 1]
    # A null element has nothing below it: its definition level stays at that of the bare element.
    bare = leaf.lists[depth - 1]
    return Rows(slot[exists], pos[exists], (dl > bare)[exists], np.flatnonzero(exists))


def leaf_at(leaf: Leaf, depth: int) -> pa.Array:
    """The leaf's values, one for each slot of its ``depth``-th list (null where undefined)."""
    index = leaf.index[leaf.rep <= depth]
    return pc.take(leaf.values, pa.array(index, mask=index < 0))


def _below(leaves: dict[str, Leaf], branch: str) -> Leaf:
    """Some leaf under ``branch``; the one with the fewest lists has the shortest sequence."""
    found = [leaf for path, leaf in leaves.items() if path == branch or path.startswith(branch + ".") or branch == ""]
    if not found:
        raise ValueError(f"no leaf below {branch!r}")
    return min(found, key=lambda leaf: len(leaf.lists))


def branch_rows(column: pa.Array, branches: list[tuple[str, int]], key: str, key_depth: int) -> Iterator[tuple[str, pa.Array, list[np.ndarray], np.ndarray]]:
    """For each ``(branch, depth of its list)``: key of the record above, places in the lists between, place.

    Null elements count for the places of later ones but give no row; elements without a key neither.
    """
    leaves = shred(column)
    keys = leaf_at(leaves[key], key_depth)
    for branch, depth in branches:
        leaf = _below(leaves, branch)
        rows = assemble(leaf, depth)
        above, places = rows.slot, []
        for d in range(depth - 1, key_depth, -1):
            up = assemble(leaf, d)
            back = np.full(int((leaf.rep <= d).sum()), -1, np.int64)
            back[up.own] = np.arange(len(up.own))
            pick = back[above]
            places.insert(0, up.pos[pick])
            above = up.slot[pick]
        owner = pc.take(keys, pa.array(above))
        keep = rows.filled & owner.is_valid().to_numpy(zero_copy_only=False)
        yield branch, owner.filter(pa.array(keep)), [place[keep] for place in places], rows.pos[keep]


LINKS = "branch string, parent_key string, pos int"


def nested_links(df: DataFrame, column: str, branches: dict[str, tuple[str, int]], key: str) -> DataFrame:
    """``branch, parent_key, pos`` of the non-null elements of nested arrays in ``column`` (an array of structs).

    ``branches`` maps the name given to a branch to its dotted path and the depth of its list (the column's
    own list is 1). ``key`` names the field of the outer elements that identifies them. Elements of a list
    within other lists below the outer one have ``#`` and the place of each of those lists' elements behind the key. Null and
    empty arrays and null elements at any level give no rows; elements without a key give none. Repeated
    rows are kept; use ``distinct`` where a record may be stored twice.
    """
    paths = {path: name for name, (path, _) in branches.items()}
    wanted = list(branches.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, owner, places, pos in branch_rows(batch.column(0), wanted, key, 1):
                for place in places:
                    owner = pc.binary_join_element_wise(owner, pc.cast(pa.array(place), pa.string()), "#")
                yield pa.record_batch({"branch": pa.array([paths[path]] * len(pos), pa.string()), "parent_key": owner, "pos": pa.array(pos, pa.int32())})

    return df.select(F.col(f"`{column}`").alias("nested")).mapInArrow(run, LINKS)


def _repeated(kind: T.DataType, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, T.DataType]]:
    if isinstance(kind, T.ArrayType):
        yield path, depth + 1, kind.elementType
        yield from _repeated(kind.elementType, path, depth + 1)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _repeated(f.dataType, f"{path}.{f.name}".lstrip("."), depth)


def _flat_leaves(kind: T.DataType, path: str = "") -> Iterator[tuple[str, T.DataType]]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _flat_leaves(f.dataType, f"{path}.{f.name}".lstrip("."))
    elif not isinstance(kind, T.ArrayType):
        yield path, kind


def flat_tables(df: DataFrame, column: str, key: str) -> dict[str, DataFrame]:
    """One table per repeated path of ``column``: ``key, places, pos`` and the element's own leaves.

    ``places`` has the places of the elements above, outermost first, so that ``key`` with ``places`` is
    the key of the parent row and ``key`` with ``places`` and ``pos`` the row's own. Leaves are named by their
    dotted path within the element with ``_`` for the dots, ``value`` for an element that is no struct. Null
    elements give no row but count for ``pos``. Maps are taken as leaves.
    """
    kind = df.schema[column].dataType
    out = {}
    for path, depth, element in _repeated(kind):
        if isinstance(element, T.ArrayType):
            continue
        leaves = list(_flat_leaves(element))
        names = [(leaf.replace(".", "_") or "value") for leaf, _ in leaves]
        schema = T.StructType(
            [T.StructField("__key", df.schema[key].dataType), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("pos", T.IntegerType())]
            + [T.StructField(n, t) for n, (_, t) in zip(names, leaves, strict=True)]
        )
        rows = df.select(F.col(f"`{key}`"), F.col(f"`{column}`")).mapInArrow(_table_maker(path, depth, [leaf for leaf, _ in leaves], names), schema)
        out[path] = rows.withColumnRenamed("__key", key) if key not in ("places", "pos", *names) else rows
    return out


def _table_maker(path: str, depth: int, leaves: list[str], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shred(batch.column(1))
            leaf = _below(found, path)
            rows = assemble(leaf, depth)
            above, places = rows.slot, []
            for d in range(depth - 1, 0, -1):
                up = assemble(leaf, d)
                back = np.full(int((leaf.rep <= d).sum()), -1, np.int64)
                back[up.own] = np.arange(len(up.own))
                pick = back[above]
                places.insert(0, up.pos[pick])
                above = up.slot[pick]
            keep = np.flatnonzero(rows.filled)
            flat = np.stack([p[keep] for p in places], axis=1).ravel() if places else np.zeros(0, np.int64)
            offsets = np.arange(len(keep) + 1) * len(places)
            columns = {
                "__key": pc.take(batch.column(0), pa.array(above[keep])),
                "places": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                "pos": pa.array(rows.pos[keep], pa.int32()),
            }
            for name, leaf_path in zip(names, leaves, strict=True):
                full = f"{path}.{leaf_path}".strip(".")
                columns[name] = pc.take(leaf_at(found[full], depth), pa.array(rows.own[keep]))
            yield pa.record_batch(columns)

    return run


ELEMENT = pa.struct([("type", pa.string()), ("text", pa.string()), ("name", pa.string()), ("input", pa.string()), ("bubbleId", pa.string())])


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def content_elements(raw: str | None) -> list | None:
    """The content elements of one transcript line, shapes made even; None where there is no content.

    A single value is its own element 0 and a text that is a JSON array is that array. An element that is no
    object becomes one with its text.
    """
    try:
        line = json.loads(raw, parse_constant=_no_constant) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    message = line.get("message") if isinstance(line, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    if content is None:
        return None
    if isinstance(content, str) and content.lstrip()[:1] == "[":
        try:
            inner = json.loads(content, parse_constant=_no_constant)
            content = inner if isinstance(inner, list) else content
        except (ValueError, RecursionError):
            pass
    if not isinstance(content, list):
        content = [content]
    return [
        None if e is None else {k: _text(e.get(k)) for k in ("type", "text", "name", "input", "bubbleId")} if isinstance(e, dict) else {"text": _text(e)}
        for e in content
    ]


CONTENT = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in ELEMENT]))


def parse_content(df: DataFrame, raw: str, key: str) -> DataFrame:
    """``key, content``: the content of raw transcript lines as an array of structs (null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = pa.array([content_elements(x) for x in batch.column(1).to_pylist()], pa.list_(ELEMENT))
            yield pa.record_batch({"key": pc.cast(batch.column(0), pa.string()), "content": content})

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("content", CONTENT)])
    return df.select(F.col(f"`{key}`"), F.col(f"`{raw}`")).mapInArrow(run, schema)
