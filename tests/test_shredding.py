from __future__ import annotations

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlog.operators import shredding as S

KIND = pa.list_(pa.struct([("id", pa.string()), ("a", pa.list_(pa.struct([("x", pa.int64()), ("b", pa.list_(pa.string()))])))]))
element = st.one_of(st.none(), st.fixed_dictionaries({"x": st.one_of(st.none(), st.integers(0, 9)), "b": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=2)), max_size=3))}))
record = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"id": st.one_of(st.none(), st.text(max_size=2)), "a": st.one_of(st.none(), st.lists(element, max_size=3))})), max_size=3))


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=6))
def test_links_against_nesting(rows):
    found = {b: list(zip(o.to_pylist(), places[-1].tolist() if places else [-1] * len(pos), pos.tolist(), strict=True)) for b, o, places, pos in S.branch_rows(pa.array(rows, KIND), [("a", 2), ("a.b", 3)], "id", 1)}
    want_a = [(r["id"], -1, k) for row in rows for r in (row or []) if r and r["id"] is not None for k, e in enumerate(r["a"] or []) if e is not None]
    want_b = [(r["id"], k, j) for row in rows for r in (row or []) if r and r["id"] is not None for k, e in enumerate(r["a"] or []) if e is not None for j, v in enumerate(e["b"] or []) if v is not None]
    assert found["a"] == want_a and found["a.b"] == want_b


def test_sliced_arrays():
    arr = pa.array([[{"id": "q", "a": [{"x": 1, "b": ["z"]}]}], None, [{"id": "r", "a": [None, {"x": 2, "b": None}]}]], KIND).slice(2)
    assert [(o.to_pylist(), pos.tolist()) for _, o, _, pos in S.branch_rows(arr, [("a", 2)], "id", 1)] == [(["r"], [1])]


def test_flat_tables(spark):
    df = spark.createDataFrame([("k", [{"id": "q", "a": [{"x": 1, "b": ["z", None]}, None, {"x": None, "b": []}]}]), ("n", None)], "k string, col array<struct<id:string,a:array<struct<x:int,b:array<string>>>>>")
    out = {p: sorted(map(tuple, t.collect()), key=str) for p, t in S.flat_tables(df, "col", "k").items()}
    assert out[""] == [("k", [], 0, "q")]
    assert out["a"] == [("k", [0], 0, 1), ("k", [0], 2, None)]
    assert out["a.b"] == [("k", [0, 0], 0, "z")]
    assert all(t.count() == 0 for t in S.flat_tables(df.limit(0), "col", "k").values())


def test_content_shapes(spark):
    e = {"type": "text", "text": "a"}
    cases = [
        ({"message": {"content": [e, None, "b"]}}, [0, 2]), ({"message": {"content": e}}, [0]), ({"message": {"content": "plain"}}, [0]), ({"message": {"content": json.dumps([e, None, e])}}, [0, 2]), ({"message": {"content": "[not json"}}, [0]),
        ({"message": {"content": 5}}, [0]), ({"message": {"content": []}}, []), ({"message": {"content": None}}, []), ({"message": None}, []), ({}, []), ([], []), (None, []), ({"message": {"content": "x" * 200_000}}, [0]),
    ]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(98, "{cut"), (99, None)]
    df = S.parse_content(spark.createDataFrame(rows, "line_id long, raw string"), "raw", "line_id").selectExpr("array(struct(key, content as message)) as record")
    got = {}
    for r in S.nested_links(df, "record", {"c": ("message", 2)}, "key").collect():
        got.setdefault(int(r["parent_key"]), []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, w) in enumerate(cases) if w}


def test_queries_have_all_flat_tables(spark, data):
    from skeinlog.queries import data_problems as Q
    from skeinlog.runtime import table

    want = {name: set() for name in ("p6_requests", "p6_parts", "p6_responses", "p6_rounds", "p6_calls", "p6_content")}
    for row in table(spark, data, "vscode_chats").select("source_file", "requests").collect():
        f = row["source_file"]
        for i, r in enumerate(row["requests"] or []):
            if r is None:
                continue
            want["p6_requests"].add((f, (), i, r["requestId"], r["timestamp"], r["modelId"], (r["message"] or {"text": None})["text"], r["isCanceled"]))
            for j, e in enumerate((r["message"] and r["message"]["parts"]) or []):
                if e is not None:
                    want["p6_parts"].add((f, (i,), j, e["kind"], e["text"]))
            for j, e in enumerate(r["response"] or []):
                if e is not None:
                    want["p6_responses"].add((f, (i,), j, e["kind"], e["value"], e["content"] and e["content"]["value"], e["toolId"]))
            for j, e in enumerate((r["result"] and r["result"]["metadata"] and r["result"]["metadata"]["toolCallRounds"]) or []):
                if e is None:
                    continue
                want["p6_rounds"].add((f, (i,), j))
                for k, c in enumerate(e["toolCalls"] or []):
                    if c is not None:
                        want["p6_calls"].add((f, (i, j), k, c["name"]))
    for row in table(spark, data, "cursor_lines").select("line_id", "raw").collect():
        for j, e in enumerate(S.content_elements(row["raw"]) or []):
            if e is not None:
                want["p6_content"].add((str(row["line_id"]), (), j, *(e.get(k) for k in ("type", "text", "name", "input", "bubbleId"))))
    for name, rows in want.items():
        got = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in Q.QUERIES[name](spark, data).collect()]
        assert rows and len(got) == len(rows) and set(got) == rows, name


def test_keys_at_depth_four(spark):
    df = spark.sql("""select array(named_struct('k', 'q', 'a', array(
        named_struct('b', array(named_struct('c', array(named_struct('v', 1))))), named_struct('b', array(named_struct('c', array(named_struct('v', 2)))))))) as r""")
    rows = sorted((x["parent_key"], x["pos"]) for x in S.nested_links(df, "r", {"c": ("a.b.c", 4)}, "k").collect())
    assert rows == [("q#0#0", 0), ("q#1#0", 0)]
