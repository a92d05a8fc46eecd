from __future__ import annotations

import random

import pytest

from skeinlog.operators import hierarchy as H
from skeinlog.operators.ordered import previous, running


def brute(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = min((x for x in (parent.get(n), p) if x is not None), default=None)
    out = {}
    for n in parent:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            ring = seen[seen.index(at):]
            out[n] = (min(ring), -1 if n in ring else -2)
        else:
            out[n] = (seen[-1], len(seen) - 1)
    return out


def graph(seed, n=160):
    r = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(n)]
    links = []
    for k, x in enumerate(ids):
        form = r.random()
        links.append((x, None if form < 0.06 else "gone" if form < 0.1 else r.choice(ids) if form < 0.16 else ids[r.randrange(max(0, k - 6), k)] if k else None))
    return links + r.sample(links, 20)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("options", [{}, {"one_task": 0}, {"slot_rows": 5}])
def test_against_walking(spark, seed, options):
    links = graph(seed)
    df = spark.createDataFrame([(n, p, "s" + n[1:3]) for n, p in links], "node string, parent string, locality string")
    got = {r["node"]: (r["root"], r["depth"]) for r in H.resolve(df, **options).collect()}
    assert got == brute(links)


def test_without_locality_rings_and_empty(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("self", "self"), ("x", None), ("x", None), (None, "q"), ("lost", "nowhere")]
    df = spark.createDataFrame(rows, "node string, parent string")
    got = {r["node"]: (r["root"], r["depth"]) for r in H.resolve(df).collect()}
    assert got == {"a": ("a", -1), "b": ("a", -1), "c": ("a", -1), "d": ("a", -2), "e": ("a", -2), "self": ("self", -1), "x": ("x", 0), "lost": ("lost", 0)}
    assert H.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("slot_rows", [1000, 3])
def test_paths_and_descendants(spark, slot_rows):
    links = graph(9)
    df = spark.createDataFrame([(n, p, "all") for n, p in links], "node string, parent string, locality string")
    known = brute(links)
    paths = H.paths(df, H.resolve(df), slot_rows)
    rows = {r["node"]: r["path"] for r in paths.collect()}
    parent = {n: p for n, p in links}
    for n, (root, depth) in known.items():
        want, at = [n], n
        for _ in range(max(0, depth)):
            at = parent[at]
            want.insert(0, at)
        assert rows[n] == want and (depth < 0 or want[0] == root)
    assert H.descendants(paths).count() == sum(d + 1 for _, d in known.values() if d >= 0)


def above(links):
    """Of each node all that is met on the way up, each once, farthest first, with the node itself at the end."""
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = min((x for x in (parent.get(n), p) if x is not None), default=None)
    out = {}
    for n in parent:
        met, at = [], n
        while at in parent and at not in met:
            met.append(at)
            at = parent[at]
        out[n] = met[::-1]
    return out


def whole(links, known):
    """Paths and descendants with rings, by walking."""
    met = above(links)
    on = {n for n, (_, depth) in known.items() if depth == -1}
    paths = {n: walk[max(k for k, x in enumerate(walk) if x in on):] if known[n][1] == -2 else walk for n, walk in met.items()}
    return paths, sorted((a, n, len(walk) - 1 - k) for n, walk in met.items() for k, a in enumerate(walk))


@pytest.mark.parametrize("slot_rows", [1000, 3])
def test_whole_paths_and_descendants(spark, slot_rows):
    links = graph(9) + [("r1", "r3"), ("r2", "r1"), ("r3", "r2"), ("t1", "r2"), ("t2", "t1"), ("t3", "t2"), ("t3", "t2"), ("u1", "t1"), ("self", "self"), ("below", "self")]
    df = spark.createDataFrame([(n, p, "all") for n, p in links], "node string, parent string, locality string")
    known = brute(links)
    rows = H.whole_paths(df, H.resolve(df), slot_rows)
    want_paths, want_below = whole(links, known)
    got = rows.collect()
    assert len(got) == len(known) and {r["node"]: r["path"] for r in got} == want_paths
    assert {r["node"]: (r["root"], r["depth"]) for r in got} == known
    assert want_paths["t3"] == ["r2", "t1", "t2", "t3"] and want_paths["r2"] == ["r3", "r1", "r2"] and want_paths["self"] == ["self"]
    assert sorted(tuple(r) for r in H.descendants(rows).collect()) == want_below
    assert H.whole_paths(df.limit(0), H.resolve(df.limit(0))).count() == 0


def test_queries_have_rings(spark, data):
    from skeinlog.queries import data_problems as Q

    for tree, links in (("message", Q.message_links(spark, data)), ("session", Q.session_links(spark, data))):
        pairs = [(r["node"], r["parent"]) for r in links.collect()]
        want_paths, want_below = whole(pairs, brute(pairs))
        assert {r["node"]: r["path"] for r in Q.p1_paths(spark, data).where(f"tree = '{tree}'").collect()} == want_paths
        assert sorted((r["ancestor"], r["node"], r["distance"]) for r in Q.p1_descendants(spark, data).where(f"tree = '{tree}'").collect()) == want_below


def test_order_over_hot_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), k * 3 % 1000, k, r.choice([1, 2, None])) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, w int").repartition(7)
    got = {x["id"]: (x["prev"], x["n"], x["total"]) for x in running(running(previous(df, ["g"], ["o"], "id", "prev"), ["g"], ["o", "id"], "n"), ["g"], ["o", "id"], "total", "w").collect()}
    for g in {x[0] for x in rows}:
        before, n, total = None, 0, 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            n, total = n + 1, total + (x[3] or 0)
            assert got[x[2]] == (before, n, total)
            before = x[2]
    assert previous(df.limit(0), ["g"], ["o"], "id", "prev").count() == 0
