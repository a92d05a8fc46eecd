from __future__ import annotations

import itertools
import json
from datetime import datetime

from skeinlog.operators import drift as D


def profile(**fields):
    return [(k, D.kind_of(v[0]), [D.value_hash(D.kind_of(x), x) for x in v]) for k, v in fields.items()]


def test_matching_is_best():
    import random

    r = random.Random(1)
    for n, m in [(1, 1), (3, 3), (2, 4), (4, 2), (5, 5)]:
        score = [[r.random() for _ in range(m)] for _ in range(n)]
        got = sum(score[i][j] for i, j in D.best_matching(score))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(score[a][b] if n <= m else score[b][a] for a, b in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert abs(got - best) < 1e-9
    assert D.best_matching([]) == [] and D.best_matching([[]]) == []


def test_compare():
    old = profile(cwd=["/a"], version=["1.2"], sessionId=["s"], flag=[True], n=[3], obj=[{"a": 1}]) + [("obj.a", "number", [1])]
    new = profile(workspace=["/a"], version=[5], sessionId=["s"], isMeta=[True], tags=[["x"]], seq=[99], box=[{"b": 1}]) + [("box.b", "number", [2])]
    assert sorted(D.compare(old, new)) == sorted([
        ("renamed", "cwd", "workspace"), ("retyped", "version", "version"), ("removed", "flag", ""), ("added", "", "isMeta"), ("added", "", "tags"), ("removed", "n", ""), ("added", "", "seq"), ("removed", "obj", ""), ("added", "", "box")])
    assert D.compare(old, old) == [] and D.compare([], []) == []
    ids_old, ids_new = profile(userId=["a", "b", "c"]), profile(user_id=["d", "e", "f"])
    assert D.compare(ids_old, ids_new) == [("renamed", "userId", "user_id")]


def test_changes_and_unified(spark):
    t = datetime(2025, 1, 1)
    line = lambda **k: json.dumps(k)
    rows = [
        (1, "i", "s", "f1", t, 1, line(cwd="/a", v="1", o={"x": 1})), (1, "i", "s", "f1", t, 1, line(cwd="/a", v="1", o={"x": 1})), (2, "i", "s", "f1", t, 2, "{cut"), (3, "i", "s", "f1", t, 3, None), (4, "i", "s", "f1", t, 4, "[]"),
        (5, "i", "s", "f2", t.replace(day=2), 1, line(workspace="/a", v=1, late=None)), (6, "i", "s", "f2", t.replace(day=2), 2, line(workspace="/a", late=True)),
        (7, "i", "s", "f3", t.replace(day=3), 1, "nothing"), (8, "j", "s", "g1", t, 1, line(z=1)),
    ]
    df = spark.createDataFrame(rows, "line_id long, install_id string, store string, file_id string, written_at timestamp, line_no int, raw string").withColumnRenamed("line_no", "before")
    got = sorted(tuple(r) for r in D.changes(df).collect())
    assert got == sorted([
        ("f2", "renamed", "cwd", "workspace"), ("f2", "retyped", "v", "v"), ("f2", "removed", "o", ""), ("f2", "added", "", "late"),
        ("f3", "removed", "workspace", ""), ("f3", "removed", "v", ""), ("f3", "removed", "late", "")])
    unified = {r["line_id"]: r["fields"] for r in D.unify(df).collect()}
    assert unified[1] == {"cwd": "/a", "v": "1", "o.x": "1"} and unified[5] == {"cwd": "/a", "v": "1"} and set(unified) == {1, 5, 6, 8}
    assert D.changes(df.limit(0)).count() == 0


def test_many_values_are_compared_whole(spark):
    t = datetime(2025, 1, 1)
    rows = []

    def file(install, day, values):
        for k in range(max(map(len, values.values()))):
            raw = json.dumps({f: v[k % len(v)] for f, v in values.items()})
            rows.append((len(rows), install, "s", f"{install}{day}", t.replace(day=day), k, raw))

    some = [f"/w/{k}" for k in range(1000)]
    for install, n, m in [("a", 100, 400), ("b", 200, 1000), ("c", 60, 400), (None, 300, 300)]:
        file(install, 1, {"cwd": some[:n], "flag": ["x", "y"]})
        file(install, 2, {"place": some[:m], "other": [f"o{k}" for k in range(90)]})
    file("d", 1, {"cwd": some[:100]})
    file("d", 2, {"place": some[90:500]})
    file("e", 1, {"n": list(range(100))})
    file("e", 2, {"k": list(range(100)), "z": [5_000 + k for k in range(100)]})
    file("e", 3, {"k2": list(range(90, 500))})
    df = spark.createDataFrame(rows, "line_id long, install_id string, store string, file_id string, written_at timestamp, line_no int, raw string")
    got = sorted(tuple(r) for r in D.changes(df).collect())
    want = [("d2", "removed", "cwd", ""), ("d2", "added", "", "place"), ("e2", "renamed", "n", "k"), ("e2", "added", "", "z"),
            ("e3", "removed", "k", ""), ("e3", "removed", "z", ""), ("e3", "added", "", "k2")]
    for file_id in ("a2", "b2", "c2", "None2"):
        want += [(file_id, "renamed", "cwd", "place"), (file_id, "removed", "flag", ""), (file_id, "added", "", "other")]
    assert got == sorted(want)
    assert {frozenset(r["fields"]) & {"cwd", "place"} for r in D.unify(df.where("install_id = 'a'")).collect()} in ({frozenset({"cwd"})}, {frozenset({"place"})})


def test_sketches_are_compared_in_their_common_range():
    values = {n: sorted(D.value_hash("string", f"/w/{k}") for k in range(n))[: D.SKETCH] for n in (50, 100, 400)}
    common, old, new = D.overlap_counts(values[100], values[400])
    assert common == old < new == D.SKETCH
    assert D.overlap_counts(values[50], values[50]) == (50, 50, 50)


def test_both_ways_of_unifying(spark, data):
    from skeinlog.operators.drift import unify

    lines = spark.read.parquet(f"{data}/raw_lines.parquet")
    ways = [sorted((r["line_id"], r["file_id"], sorted(r["fields"].items())) for r in unify(lines, most).collect()) for most in (200_000, 0)]
    assert ways[0] == ways[1] and ways[0]
