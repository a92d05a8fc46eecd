"""Schemas that drift between files (problem 2).

Every file is profiled per field: type and a bottom-k sketch of its values, combined partition-locally before
any shuffle. Neighbouring files are compared by a bipartite matching between the fields that stop and those
that start, weighted by value overlap and name similarity; matched pairs are renames. Where a sketch may not hold
all values, those of the fields in question are counted by a join on value hashes. Renames of all files make
classes of names, and one name per class gives the consistent table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from skeinlog.operators.ordered import previous
from skeinlog.runtime import cut

#: Distinct values kept per field of a file, those of the smallest hashes; a sketch of fewer holds all.
SKETCH = 64
#: Least score of a rename.
RENAME = 0.5
#: Most names of fields that are shipped to every task.
NAMES = 200_000
#: Profiles held by a task before they are passed on.
HELD = 50_000

PARTIAL = "install_id string, store string, file_id string, written_at timestamp, field string, kind string, n bigint, sketch array<bigint>"
OPEN = "pair string, side string, install_id string, store string, file_id string, fields array<string>"
VALUES = "pair string, side string, field string, kind string, hash bigint"
CHANGES = "file_id string, change string, old_field string, new_field string"
FIELDS = "line_id bigint, file_id string, store string, field string, value string"


def kind_of(value: object) -> str:
    """The JSON type of a value that is not null."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _reject(_: str) -> None:
    raise ValueError("not JSON")


def read_object(raw: str | None) -> dict | None:
    """The object of one line, or None for anything else and for text that is no JSON."""
    if raw is None:
        return None
    try:
        line = json.loads(raw, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return line if isinstance(line, dict) else None


def fields_of(line: dict, prefix: str = "") -> Iterator[tuple[str, str, object]]:
    """Dotted path, type and value of every field through objects; nulls have none."""
    for name, value in line.items():
        if value is None:
            continue
        kind = kind_of(value)
        yield prefix + name, kind, value
        if kind == "object":
            yield from fields_of(value, prefix + name + ".")


def value_hash(kind: str, value: object) -> int:
    """A hash of a value that is equal for equal values of one type, whatever the order of an object's fields."""
    text = value if kind == "string" else json.dumps(value, sort_keys=True) if kind in ("object", "array") else repr(value)
    return xxhash.xxh64_intdigest(f"{kind}\x1e{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple, dict] = {}

    def flush() -> pd.DataFrame:
        rows = [(*key, field, kind, n, sorted(seen)[:SKETCH]) for key, by in held.items() for (field, kind), (n, seen) in by.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["install_id", "store", "file_id", "written_at", "field", "kind", "n", "sketch"])

    size = 0
    for pdf in batches:
        for install, store, file, at, raw in zip(pdf["install_id"], pdf["store"], pdf["file_id"], pdf["written_at"], pdf["raw"], strict=True):
            by = held.setdefault((install, store, file, at), {("", ""): [0, set()]})
            line = read_object(raw)
            if line is None:
                continue
            for field, kind, value in fields_of(line):
                entry = by.get((field, kind))
                if entry is None:
                    entry = by[field, kind] = [0, set()]
                    size += 1
                entry[0] += 1
                seen = entry[1]
                seen.add(value_hash(kind, value))
                if len(seen) > 8 * SKETCH:
                    entry[1] = set(sorted(seen)[:SKETCH])
        if size > HELD:
            yield flush()
            size = 0
    if held:
        yield flush()


def profile(lines: DataFrame) -> DataFrame:
    """One row per file: ``install_id, store, file_id, written_at, fields``.

    ``fields`` is an array of (field, kind, sketch); of several types of a field the most frequent counts. A
    file without a valid line has no fields but a row.
    """
    parts = lines.select("install_id", "store", "file_id", "written_at", "raw").mapInPandas(_profiles, PARTIAL)
    keys = ["install_id", "store", "file_id"]
    kinds = parts.groupBy(*keys, "field", "kind").agg(
        F.sum("n").alias("n"), F.max("written_at").alias("written_at"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"),
    )
    fields = kinds.groupBy(*keys, "field").agg(
        F.max("written_at").alias("written_at"), F.max_by(F.struct("field", "kind", "sketch"), F.struct("n", "kind")).alias("entry")
    )
    return fields.groupBy(*keys).agg(
        F.max("written_at").alias("written_at"), F.array_sort(F.collect_list(F.when(F.col("field") != "", F.col("entry")))).alias("fields")
    )


def _words(name: str) -> set[str]:
    leaf = name.rpartition(".")[2]
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", leaf)}


def name_similarity(a: str, b: str) -> float:
    """Share of common words and of common letter pairs of two field names, the larger one."""
    wa, wb = _words(a), _words(b)
    words = len(wa & wb) / max(1, len(wa | wb))
    flat = [re.sub(r"[^a-z0-9]", "", x.rpartition(".")[2].lower()) for x in (a, b)]
    pa, pb = ({x[i : i + 2] for i in range(len(x) - 1)} for x in flat)
    return max(words, len(pa & pb) / max(1, len(pa | pb)), 1.0 if flat[0] == flat[1] else 0.0)


def overlap_counts(va: list[int], vb: list[int]) -> tuple[int, int, int]:
    """Common values of two sketches and the values of each, of the hashes that neither has cut off."""
    ends = [max(v) for v in (va, vb) if len(v) >= SKETCH]
    sa, sb = ({x for x in v if not ends or x <= min(ends)} for v in (va, vb))
    return len(sa & sb), len(sa), len(sb)


def rename_score(old: tuple, new: tuple, counts: tuple[int, int, int] | None = None) -> float:
    """How well a new field goes on for an old one, from 0 to 1; 0 for different types.

    ``counts`` are the exact numbers of common, old and new values; without them the sketches tell.
    """
    (a, kind, va), (b, kind_b, vb) = old, new
    if kind != kind_b:
        return 0.0
    common, na, nb = counts or overlap_counts(va, vb)
    jaccard = common / max(1, na + nb - common)
    overlap = jaccard if kind == "number" else (jaccard + common / max(1, min(na, nb))) / 2
    alike = name_similarity(a, b)
    same_place = a.rpartition(".")[0] == b.rpartition(".")[0]
    if kind == "boolean":  # two values say nothing
        return alike if same_place else 0.0
    if overlap == 0 and alike >= 0.75 and min(len(set(va)), len(set(vb))) > 1 and same_place:  # values that never repeat, such as ids
        return alike * 0.8
    return 0.8 * overlap + 0.15 * alike + 0.05 * same_place


def best_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of a matching with the greatest sum of scores (shortest augmenting paths, n³)."""
    if not score or not score[0]:
        return []
    flip = len(score) > len(score[0])
    cost = [[-x for x in row] for row in (zip(*score, strict=True) if flip else score)]
    n, m = len(cost), len(cost[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _inner(field: str, whole: set[str]) -> bool:
    at = field.rfind(".")
    while at > 0:
        if field[:at] in whole:
            return True
        at = field.rfind(".", 0, at)
    return False


def _ends(before: dict[str, tuple], after: dict[str, tuple]) -> tuple[list[str], list[str], set[str]]:
    """The fields that stop, those that start and those of another type; of the first two only whole ones."""
    retyped = {x for x in before.keys() & after.keys() if before[x][1] != after[x][1]}
    stop, start = before.keys() - after.keys(), after.keys() - before.keys()
    gone, come = stop | retyped, start | retyped
    return sorted(x for x in stop if not _inner(x, gone)), sorted(x for x in start if not _inner(x, come)), retyped


def open_pairs(old: list[tuple], new: list[tuple]) -> list[tuple[str, str]]:
    """Pairs of a field that stops and one that starts of which a sketch may not hold all values."""
    before, after = {f[0]: f for f in old}, {f[0]: f for f in new}
    stop, start, _ = _ends(before, after)
    return [(a, b) for a in stop for b in start if before[a][1] == after[b][1] != "boolean" and max(len(before[a][2]), len(after[b][2])) >= SKETCH]


def compare(old: list[tuple], new: list[tuple], counts: dict[tuple[str, str], tuple[int, int, int]] | None = None) -> list[tuple[str, str, str]]:
    """Changes ``(change, old_field, new_field)`` between the fields of two files.

    Inner fields of an object that is added, removed, retyped or renamed as a whole are left out. ``counts``
    has the exact numbers of common, old and new values of pairs of fields.
    """
    before, after = {f[0]: f for f in old}, {f[0]: f for f in new}
    stop, start, retyped = _ends(before, after)
    score = [[rename_score(before[a], after[b], (counts or {}).get((a, b))) for b in start] for a in stop]
    renamed = [(stop[i], start[j]) for i, j in best_matching(score) if score[i][j] >= RENAME]
    from_, to = {a for a, _ in renamed}, {b for _, b in renamed}
    return (
        [("renamed", a, b) for a, b in renamed]
        + [("removed", a, "") for a in stop if a not in from_]
        + [("added", "", b) for b in start if b not in to]
        + [("retyped", x, x) for x in sorted(retyped) if not _inner(x, retyped)]
    )


def _fields(side: list[dict]) -> list[tuple]:
    return [(f["field"], f["kind"], [int(x) for x in f["sketch"]]) for f in side]


def _compare_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file, old, new, sizes, shared in zip(pdf["file_id"], pdf["old"], pdf["new"], pdf["sizes"], pdf["shared"], strict=True):
            sides = _fields(old), _fields(new)
            counts = {}
            if sizes is not None:
                own = {(x["side"], x["field"]): int(x["n"]) for x in sizes}
                both = {(x["old_field"], x["new_field"]): int(x["n"]) for x in (shared if shared is not None else [])}
                counts = {(a, b): (both.get((a, b), 0), own["old", a], own["new", b]) for a, b in open_pairs(*sides)}
            rows.extend((file, *change) for change in compare(*sides, counts))
        yield pd.DataFrame(rows, columns=["file_id", "change", "old_field", "new_field"])


def _open_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for pair, install, store, file, before, old, new in zip(*(pdf[c] for c in ("pair", "install_id", "store", "file_id", "before", "old", "new")), strict=True):
            sides = _fields(old), _fields(new)
            kinds = [{f[0]: f[1] for f in side} for side in sides]
            found = open_pairs(*sides)
            for k, (side, of) in enumerate((("old", before), ("new", file))):
                if names_ := sorted({x[k] for x in found}):
                    rows.append((pair, side, install, store, of, [f"{kinds[k][x]}\x1e{x}" for x in names_]))
        yield pd.DataFrame(rows, columns=["pair", "side", "install_id", "store", "file_id", "fields"])


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = set()
        for pair, side, fields, raw in zip(pdf["pair"], pdf["side"], pdf["fields"], pdf["raw"], strict=True):
            wanted = set(fields)
            for field, kind, value in fields_of(read_object(raw) or {}):
                if f"{kind}\x1e{field}" in wanted:
                    seen.add((pair, side, field, kind, value_hash(kind, value)))
        yield pd.DataFrame(list(seen), columns=["pair", "side", "field", "kind", "hash"])


def exact_counts(lines: DataFrame, both: DataFrame) -> DataFrame:
    """``pair, sizes, shared``: the distinct values of each field in question, and those common to two of a pair of files.

    ``both`` has ``pair, install_id, store, file_id, before, old, new``. Only hashes are shuffled, by their
    own value, so that no large file or field fills a task.
    """
    asked = cut(both.select("pair", "install_id", "store", "file_id", "before", "old", "new").mapInPandas(_open_fields, OPEN))
    told = lines.select(F.col("install_id").alias("i"), F.col("store").alias("s"), F.col("file_id").alias("f"), "raw")
    met = told.join(asked, F.col("i").eqNullSafe(F.col("install_id")) & F.col("s").eqNullSafe(F.col("store")) & (F.col("f") == F.col("file_id")))
    values = cut(met.select("pair", "side", "fields", "raw").mapInPandas(_values, VALUES).distinct())
    sizes = values.groupBy("pair", "side", "field").agg(F.count("*").alias("n")).groupBy("pair").agg(F.collect_list(F.struct("side", "field", "n")).alias("sizes"))
    old = values.where("side = 'old'").select("pair", "kind", "hash", F.col("field").alias("old_field"))
    new = values.where("side = 'new'").select("pair", "kind", "hash", F.col("field").alias("new_field"))
    shared = old.join(new, ["pair", "kind", "hash"]).groupBy("pair", "old_field", "new_field").agg(F.count("*").alias("n"))
    return sizes.join(shared.groupBy("pair").agg(F.collect_list(F.struct("old_field", "new_field", "n")).alias("shared")), "pair", "left")


def changes(lines: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """``file_id, change, old_field, new_field`` of each file against the one before it of its install and store.

    ``lines`` needs ``install_id, store, file_id, written_at, raw``. Lines that are no JSON object, null lines
    and null values have no fields; repeated lines change nothing; files of equal time are ordered by id; the
    first file and an empty table have no changes. Other columns are ignored.
    """
    known = cut(profiles if profiles is not None else profile(lines))
    order = previous(known.select("install_id", "store", "written_at", "file_id"), ["install_id", "store"], ["written_at"], "file_id", "before")
    pairs = order.where("before is not null").select("install_id", "store", "file_id", "before")
    new = known.select(*[F.col(c).alias(f"n_{c}") for c in ("install_id", "store", "file_id")], F.col("fields").alias("new"))
    old = known.select(*[F.col(c).alias(f"o_{c}") for c in ("install_id", "store", "file_id")], F.col("fields").alias("old"))

    def same(side: str, file: str):  # noqa: ANN202
        return F.col("install_id").eqNullSafe(F.col(f"{side}_install_id")) & F.col("store").eqNullSafe(F.col(f"{side}_store")) & (F.col(file) == F.col(f"{side}_file_id"))

    both = pairs.join(new, same("n", "file_id")).join(old, same("o", "before"))
    both = both.select("file_id", "before", "install_id", "store", "old", "new")
    if known.where(F.exists("fields", lambda f: F.size(f["sketch"]) >= SKETCH)).isEmpty():
        counted = both.select("file_id", "old", "new", F.expr("cast(null as array<struct<side string, field string, n bigint>>)").alias("sizes"), F.expr("cast(null as array<struct<old_field string, new_field string, n bigint>>)").alias("shared"))
    else:
        both = cut(both.withColumn("pair", F.to_json(F.struct("install_id", "store", "file_id"))))
        counted = both.join(exact_counts(lines, both), "pair", "left")
    return counted.select("file_id", "old", "new", "sizes", "shared").mapInPandas(_compare_rows, CHANGES)


def names(lines: DataFrame, found: DataFrame, profiles: DataFrame) -> DataFrame:
    """``store, field, name``: for each field of a store the one name of its class of renamed fields.

    The name is the most frequent one of the class over all files, the smallest of those that tie. Classes come
    from spreading the smallest name along renames until nothing changes; the table has one row per field
    name and store.
    """
    used = cut(profiles.select("store", "file_id", F.explode("fields").alias("f")).groupBy("store", F.col("f.field").alias("field")).agg(F.count("*").alias("files")))
    where = profiles.select(F.col("file_id").alias("pf"), "store").distinct()
    edges = found.where("change = 'renamed'").join(where, F.col("file_id") == F.col("pf")).select("store", "old_field", "new_field").distinct()
    edges = cut(edges.unionByName(edges.select("store", F.col("new_field").alias("old_field"), F.col("old_field").alias("new_field"))).distinct())
    label = used.select("store", "field", F.col("field").alias("label"))
    while True:
        near = edges.join(label.withColumnRenamed("store", "s"), (F.col("store") == F.col("s")) & (F.col("old_field") == F.col("field"))).groupBy("store", "new_field").agg(F.min("label").alias("via"))
        nxt = cut(label.join(near.withColumnRenamed("store", "s"), (F.col("store") == F.col("s")) & (F.col("field") == F.col("new_field")), "left").select(
            "store", "field", F.least("label", F.coalesce("via", "label")).alias("label"), (F.col("via") < F.col("label")).alias("moved")))
        label = nxt.select("store", "field", "label")
        if nxt.where("moved").isEmpty():
            break
    named = label.join(used, ["store", "field"])
    best = named.groupBy("store", "label").agg(F.min_by("field", F.struct(-F.col("files"), F.col("field"))).alias("name"))
    return named.join(best, ["store", "label"]).select("store", "field", "name")


def _field_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for line_id, file, store, raw in zip(pdf["line_id"], pdf["file_id"], pdf["store"], pdf["raw"], strict=True):
            for field, kind, value in fields_of(read_object(raw) or {}):
                if kind != "object":
                    rows.append((line_id, file, store, field, value if kind == "string" else json.dumps(value, ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=["line_id", "file_id", "store", "field", "value"])


def _renaming(known: dict[tuple[str, str], str]) -> Callable:
    """A function over Arrow batches that gives each line's leaf values under the names of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for store, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                best: dict[str, tuple[bool, str, str]] = {}
                for field, kind, value in fields_of(read_object(raw) or {}):
                    name = known.get((store, field)) if kind != "object" else None
                    if name is not None:
                        mine = (field == name, field, value if kind == "string" else json.dumps(value, ensure_ascii=False))
                        best[name] = max(best[name], mine, key=lambda x: x[:2]) if name in best else mine
                maps.append([(name, best[name][2]) for name in sorted(best)] or None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["line_id", "file_id", "store", "digest", "fields"])

    return run


def unify(lines: DataFrame, most: int = NAMES) -> DataFrame:
    """``line_id, file_id, store, fields``: every valid line with its leaf values under consistent names.

    ``fields`` is a map from name to value, values that are no string as JSON text. Repeated lines count once.
    Where one line has two fields of one class the value under the class's own name wins. Up to ``most`` names are
    shipped to where the lines are read, so that no leaf is shuffled; more are joined.
    """
    profiles = cut(profile(lines))
    named = cut(names(lines, changes(lines, profiles), profiles))
    picked = lines.select("line_id", "file_id", "store", "raw")
    if named.count() <= most:
        known = {(r["store"], r["field"]): r["name"] for r in named.collect()}
        shape = picked.select("line_id", "file_id", "store", F.xxhash64("raw").alias("digest")).schema.add("fields", MapType(StringType(), StringType()))
        mapped = picked.withColumn("digest", F.xxhash64("raw")).mapInArrow(_renaming(known), shape).where("fields is not null")
        return mapped.dropDuplicates(["line_id", "file_id", "store", "digest"]).drop("digest")
    rows = picked.distinct().mapInPandas(_field_rows, FIELDS)
    joined = rows.join(named.withColumnRenamed("store", "s").withColumnRenamed("field", "f"), (F.col("store") == F.col("s")) & (F.col("field") == F.col("f")))
    leaf = joined.groupBy("line_id", "file_id", "store", "name").agg(F.max_by("value", F.struct((F.col("field") == F.col("name")), F.col("field"))).alias("value"))
    return leaf.groupBy("line_id", "file_id", "store").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
