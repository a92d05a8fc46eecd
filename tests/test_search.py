from __future__ import annotations

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from skeinlog.functions.text import fold_text, glob_regex, java_regex
from skeinlog.operators import search as S
from skeinlog.operators.relevance import partial_ratio, ratio, weighted_ratio
from skeinlog.plans import lower
from skeinlog.plans import query as Q

SCHEMA = """doc_id int, _ord long, kind string, agent string, store string, adapter_id string, path string, text string, title string, role string, timestamp string, model string, session_id string,
 conversation_id string, origin struct<cwd:string,repo:string,worktree:string,branch:string,remote:string,cwd_hash:string>, store_role string"""


def record(k, text="", **o):
    base = dict(kind="prompt", agent="codex", store="codex.history", adapter_id="codex.history.v1", path=f"/home/u/.codex/{k}.jsonl", title=None, role="user", timestamp=None, model=None, session_id=None, conversation_id=None, origin=None, store_role="prompt_history") | o
    return (k, k, base["kind"], base["agent"], base["store"], base["adapter_id"], base["path"], text, base["title"], base["role"], base["timestamp"], base["model"], base["session_id"], base["conversation_id"], base["origin"], base["store_role"])


@pytest.fixture(scope="module")
def rows(spark):
    origin = ("/work/app/src", "/work/app", None, "Main", None, None)
    return spark.createDataFrame([
        record(1, "Deploy the STRASSE now", timestamp="2026-01-05T10:00:00Z", origin=origin), record(2, "deploy later", agent="claude", model="gpt-4", timestamp="2026-02-01T00:00:00Z", store_role="primary_chat", kind="history", role="assistant"),
        record(3, "nothing", title="Deploy plan", timestamp="bad"), record(4, "line one\nfoo bar\nfoo\n", model="o4-mini", session_id="s"), record(5, "foo", session_id="s", timestamp="2026-01-05T11:00:00+02:00"), record(6, "foo", session_id="s", timestamp="2026-01-05T12:00:00+02:00"),
        record(7, "", role=None),
    ], SCHEMA)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(("query", "want"), [
    ("deploy", [1, 2, 3]), ("NOT deploy", [4, 5, 6, 7]), ("deploy AND NOT agent:claude", [1, 3]), ('"the   straße"', [1]), ("agent:claude OR foo", [2, 4, 5, 6]), ("-timestamp:>2026-01-06", [1, 3, 4, 5, 6, 7]),
    ("timestamp:2026-01-05", [1, 5, 6]), ("timestamp:2026-01", [1, 5, 6]), ("timestamp:>=2026-02-01", [2]), ("timestamp:[2026-01-05T09:00:00Z TO 2026-01-05T10:00:00Z]", [1, 5, 6]), ("timestamp:{2026-01-05T09:00:00Z TO 2026-01-05T10:00:00Z}", []),
    ("timestamp:[* TO 2026-01]", []), ("model:gpt*", [2]), ("model:mini", [4]), ("model:*", [2, 4]), ("cwd:/work/app", [1]), ("cwd:/work/ap", []), ("branch:main", [1]), ("project:app", [1]), ("kind:history", [2]), ("scope:conversations", [2]),
    ("role:user -foo", [1, 3]), ("path:/home/*/4.jsonl", [4]), ("path:.codex/2", [2]), ("mtime:>2020 OR agent:claude", [2]), ("(deploy OR foo) kind:prompt", [1, 3, 4, 5, 6]), ("depth:exhaustive agent:claude", [2]), ("title:x", None),
])
def test_predicates(rows, query, want):
    if want is None:
        with pytest.raises(Q.QueryError):
            Q.parse(query)
    else:
        assert ids(rows.where(lower.records(Q.parse(query)))) == want


@pytest.mark.parametrize("bad", ["agent:nobody", "timestamp:soon", "model:>4", "agent:[a TO b]", "NOT depth:deep", "depth:prompt OR x", '"open', "(a", "timestamp:[a", "cache AND", "typ:x", ""])
def test_errors(bad):
    with pytest.raises(Q.QueryError):
        Q.parse(bad)


def test_gate_and_requests():
    assert Q.engages("agent:codex x") and Q.engages('"a b"') and Q.engages("a OR b") and not Q.engages("a or b") and not Q.engages("https://x.y z")
    assert isinstance(Q.parse("agent:codex a or b"), Q.Any_)
    assert Q.unknown_fields("agnt:codex http://x") == [("agnt", "agent")]
    assert Q.Request("agent:codex depth:deep").resolved().effort == "targeted" and Q.Request("x", scope="prompts").resolved().effort == "prompt"
    with pytest.raises(Q.QueryError):
        Q.Request("x", effort="prompt", scope="all").resolved()
    with pytest.raises(Q.QueryError):
        Q.Request("x", order="odd").resolved()
    with pytest.raises(ValueError):
        Q.Registry().add(Q.Field("date", "record", "text"))


def test_dates():
    Q.set_now(lambda: datetime(2026, 3, 10, 12, tzinfo=UTC))
    try:
        assert Q.window("2w")[0] == datetime(2026, 2, 24, 12, tzinfo=UTC) and Q.window("1d from now")[0].day == 11
        assert Q.window("yesterday") == (datetime(2026, 3, 9, tzinfo=UTC), datetime(2026, 3, 10, tzinfo=UTC)) and Q.window("2024")[1].year == 2025 and Q.window("2025-12")[1] == datetime(2026, 1, 1, tzinfo=UTC)
        assert Q.window("2026-01-01T00:00:00+02:00")[0] == datetime(2025, 12, 31, 22, tzinfo=UTC)
    finally:
        Q.set_now(None)


def test_dedupe_order_and_limit(rows):
    foo = rows.where("text = 'foo'")
    assert ids(S.deduplicated(foo)) == [6] and ids(S.deduplicated(foo, "scan")) == [5]
    assert [r["doc_id"] for r in S.search(rows, Q.Request("foo")).collect()] == [6, 4]
    assert [r["doc_id"] for r in S.search(rows, Q.Request("foo", order="scan", limit=1)).collect()] == [4]
    assert S.search(rows, Q.Request("foo", order="relevance")).first()["score"] == 100.0
    assert ids(S.matched(rows, Q.Request("one foo"))) == [4] and ids(S.matched(rows, Q.Request("one later", any_term=True))) == [2, 4]
    assert S.search(rows.limit(0), Q.Request("foo")).count() == 0


def test_lines(rows):
    one = rows.where("doc_id = 4")
    pattern = S.grep_pattern(["foo"], word=True)
    assert [(r["line_number"], r["line"]) for r in S.lines_of(one, pattern, ["doc_id"]).collect()] == [(2, "foo bar"), (3, "foo")]
    assert S.line_counts(one, pattern, ["doc_id"]).first()["n_lines"] == 2 and S.only_matching(one, pattern, ["doc_id"]).count() == 2
    assert [(r["first"], r["last"]) for r in S.spans(one, ["foo", "o b"], ["doc_id"]).collect()] == [(9, 14), (17, 20)]
    assert ids(rows.where(F.col("text").rlike(S.grep_pattern(["straße"], case="ignore")))) == []


def test_ratios():
    assert ratio("abc", "abc") == 100 and ratio("", "") == 100 and weighted_ratio("", "x") == 0 and abs(ratio("kitten", "sitting") - 61.538) < 0.01
    assert partial_ratio("abc", "xxabcxx") == 100 and weighted_ratio("retry loop", "loop retry") == 95 and ratio("ab", "ba") == ratio("ba", "ab") == 50


def test_text_helpers(spark):
    import re

    assert fold_text("Straße ΣΑΣ") == "strasse σασ" and java_regex("(?P<a>x)(?P=a)", True) == r"(?U)(?<a>x)\k<a>"
    with pytest.raises(re.error):
        java_regex("(")
    df = spark.createDataFrame([("a/b.c",), ("[x]",), ("é\n",)], "x string")
    assert [r["x"] for r in df.where(F.col("x").rlike(glob_regex("a*.?"))).collect()] == ["a/b.c"] and [r["x"] for r in df.where(F.col("x").rlike(glob_regex("[é]*"))).collect()] == ["é\n"]



def test_streaming(spark, tmp_path):
    from skeinlog import streaming

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id":"1","text":"x"}\n{"id":"1","text":"x"}\n{"id":"2","text":"y"}\n')
    rows = streaming.once_each(streaming.follow(spark, str(source), "id string, text string"), ["id", "text"])
    streaming.drain(rows, str(tmp_path / "sink"), str(tmp_path / "check"))
    (source / "b.json").write_text('{"id":"2","text":"y"}\n{"id":"3","text":"z"}\n')
    streaming.drain(streaming.once_each(streaming.follow(spark, str(source), "id string, text string"), ["id", "text"]), str(tmp_path / "sink"), str(tmp_path / "check"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["1", "2", "3"]


def test_queries_run(spark, data):
    import duckdb

    from skeinlog.queries import collect

    queries, sql = collect()
    db = duckdb.connect()
    for name in os.listdir(data):
        db.execute(f"create view {name[:-8]} as select * from '{data}/{name}'")
    for name in ("q_newest_topk", "q_nested", "q_time_range", "q_authority", "q_snippet", "p6_responses"):
        df = queries[name](spark, data)
        columns = sorted(df.columns)
        got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
        found = db.sql(sql[name])
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall()), name
