from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skeinlog.llm import conversations as C

SCHEMA = "session_id string, uuid string, parent string, role string, at long, has_text boolean"
GOOD = [("s", "u1", None, "user", 5, True), ("s", "a1", "u1", "assistant", 6, True), ("s", "a2", "u1", "assistant", 3, False), ("s", "u2", "a1", "user", 7, True), ("s", "b2", "u2", "assistant", None, True), ("s", "b1", "u2", "assistant", 9, True), ("s", "z", None, "system", 1, False)]


@pytest.mark.parametrize("session_rows", [1000, 1])
def test_order(spark, session_rows):
    more = [("t", "tu", "b1", "user", 4, True), ("t", "ta", "tu", "assistant", 2, True)]
    df = spark.createDataFrame([*GOOD, *GOOD[:2], *more], SCHEMA)
    got = {(r["session_id"], r["turn"]): (r["uuid"], r["role"]) for r in C.conversations(df, session_rows).collect()}
    order = ["z", "u1", "a2", "a1", "u2", "b1", "b2"]
    assert {k: v[0] for k, v in got.items()} == {("s", k + 1): u for k, u in enumerate(order)} | {("t", 1): "tu", ("t", 2): "ta"}


def test_dropped(spark):
    rows = [*GOOD]
    for name, broken in {
        "ring": [("", "r1", "r2", "user", 1, True), ("", "r2", "r1", "assistant", 2, True)], "tail": [("", "w", "r1", "assistant", 1, True)], "lost": [("", "l1", "nowhere", "user", 1, True), ("", "l2", "l1", "assistant", 2, True)],
        "noask": [("", "n1", None, "assistant", 1, True)], "mute": [("", "m1", None, "user", 1, False), ("", "m2", "m1", "assistant", 2, False)], "open": [("", "o1", None, "user", 1, True)], "hushed": [("", "h1", None, "user", 1, True), ("", "h2", "h1", "assistant", 2, False)],
    }.items():
        rows += [(name, *r[1:]) for r in broken]
    rows += [(None, "q", None, "user", 1, True), ("x", None, None, "user", 1, True)]
    got = {r["session_id"] for r in C.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"s"}
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_sessions_agree(spark):
    import random

    r = random.Random(4)
    rows = []
    for k in range(250):
        parent = None if k == 0 or r.random() < 0.03 else f"n{r.randrange(max(0, k - 9), k):03d}"
        rows.append(("s", f"n{k:03d}", parent, "system" if k else "user", r.randrange(100), True))
    rows.append(("s", "reply", "n000", "assistant", 1, True))
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = ({(x["turn"], x["uuid"]) for x in C.conversations(df, n).collect()} for n in (1000, 1))
    assert a == b and len(a) == 251


def test_roles_and_gaps(spark):
    df = spark.createDataFrame([("AI", "assistant"), (" Human ", "x"), (None, "assistant"), (None, "summary"), ("odd", "user")], "r string, t string")
    assert [x["v"] for x in df.select(C.infer_role(F.col("r"), F.col("t")).alias("v")).collect()] == ["assistant", "user", "assistant", "system", "user"]
    minute = 60_000_000
    stamps = [d * 1440 * minute + k * minute for d in range(5) for k in range(20)]
    rows = spark.createDataFrame([("c", t, f"k{n}") for n, t in enumerate(stamps)] + [("c", None, "none"), ("e", 5, "e")], "channel string, at long, key string")
    got = {x["key"]: x["part"] for x in C.split_by_gaps(rows, "channel", "at", "key").collect()}
    assert got["k0"] == 1 and got["k19"] == 1 and got["k20"] == 2 and got["k99"] == 5 and got["none"] is None and got["e"] == 1
    assert math.isinf(C.calibrated_gap(spark.createDataFrame([(None,)], "g long"), "g"))


def test_messages_without_session_are_sessionized(spark):
    rows = [("u1", None, "user", 0), ("a1", "u1", "assistant", 1_000_000), ("u2", None, "user", 90_000_000_000), ("a2", "u2", "assistant", 90_001_000_000), ("u3", None, "user", 400_000_000_000)]
    df = spark.createDataFrame([(None, u, p, r, at, True, "c") for u, p, r, at in rows] + [(None, "x", None, "user", 5, True, None)], "session_id string, uuid string, parent string, role string, at long, has_text boolean, channel string")
    got = [(r["session_id"], r["turn"], r["uuid"]) for r in C.conversations(df).orderBy("session_id", "turn").collect()]
    assert got == [("c#1", 1, "u1"), ("c#1", 2, "a1"), ("c#2", 1, "u2"), ("c#2", 2, "a2")]


def test_reciprocal(spark):
    df = spark.createDataFrame([("a", 1, "user"), ("a", 1, "assistant"), ("a", 2, "user"), (None, 1, "assistant"), (None, 1, "user"), ("b", None, "user")], "channel string, part int, role string")
    assert sorted((r["channel"] or "", r["part"]) for r in C.reciprocal(df, ["channel", "part"]).collect()) == [("", 1), ("", 1), ("a", 1), ("a", 1)]
    assert C.reciprocal(df.limit(0), ["channel", "part"]).count() == 0
