from __future__ import annotations

import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from skeinlog import cli
from skeinlog.operators import display as D
from skeinlog.operators import search as S
from skeinlog.operators.ordered import carried
from skeinlog.plans import planning as P
from skeinlog.plans.query import QueryError, Request, parse


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    for path, rows in {
        ".codex/history.jsonl": [{"session_id": "a", "ts": 1_600_000_000 + k, "text": t} for k, t in enumerate(["Bake the bread\nthen cool it", "bread again", "soup"])],
        ".codex/sessions/2020/rollout-x.jsonl": [{"type": "session_meta", "payload": {"id": "a"}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "bread needs salt"}]}}],
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(root)


def ran(spark, home, *argv):
    out = io.StringIO()
    code = cli.main(["--home", home, *argv], spark, out)
    return code, out.getvalue()


def test_commands(spark, home):
    assert ran(spark, home, "grep", "-n", "bread") == (0, "~/.codex/history.jsonl:1:Bake the bread\n~/.codex/history.jsonl:1:bread again\n")
    assert ran(spark, home, "grep", "-c", "--scope", "all", "Bread")[0] == 1 and ran(spark, home, "grep", "-l", "bread") == (0, "~/.codex/history.jsonl\n")
    assert ran(spark, home, "grep", "--column", "bread")[1].startswith("~/.codex/history.jsonl:1:10:Bake")
    assert [json.loads(x)["type"] for x in ran(spark, home, "grep", "--ndjson", "soup")[1].splitlines()] == ["begin", "match", "end"]
    body = json.loads(ran(spark, home, "search", "--json", "--limit", "2", "bread")[1])
    assert len(body["results"]) == 2 and body["summary"]["state"] == "bounded" and body["summary"]["reason"] == "result_limit"
    assert ran(spark, home, "search", "nothing-like-it") == (1, "") and ran(spark, home, "search", "--effort", "prompt", "x")[0] == 2 and ran(spark, home + "/none", "search", "x")[0] == 1
    assert "bread needs salt" in ran(spark, home, "search", "--ndjson", "salt")[1]
    assert ran(spark, home, "find", "rollout") == (0, "~/.codex/sessions/2020/rollout-x.jsonl\n") and ran(spark, home, "find", "-0", "--type", "history_file")[1] == "~/.codex/history.jsonl\0"


def test_admission_by_effort_and_scope(spark):
    rows = [(r, c, s) for r, s in (("prompt_history", "x.h"), ("primary_chat", "x.c"), ("supplementary_chat", "x.s"), ("plan", "x.p"), ("app_state", "pi.context_mode_db")) for c in ("default_search", "inspectable", "catalog_only", "private")]
    df = spark.createDataFrame(rows, "role string, coverage string, store string")
    searchable = {(r, c, s) for r, c, s in rows if c in P.SEARCHABLE}
    role = lambda *names: {x for x in searchable if x[0] in names}
    listed = {x for x in searchable if x[2] in P.CONVERSATION_STORES}
    want = {
        ("prompts", "prompt"): {x for x in role("prompt_history") if x[1] == "default_search"}, ("prompts", "exhaustive"): role("prompt_history", "primary_chat", "supplementary_chat"),
        ("conversations", "targeted"): role("prompt_history", "primary_chat", "supplementary_chat") | listed, ("all", "targeted"): role("prompt_history", "primary_chat", "supplementary_chat") | listed,
        ("conversations", "exhaustive"): role("primary_chat", "supplementary_chat") | listed, ("all", "exhaustive"): searchable,
    }
    for scope, effort in itertools.product(("prompts", "conversations", "all"), ("prompt", "targeted", "exhaustive", None)):
        known = want.get((scope, effort or ("prompt" if scope == "prompts" else "exhaustive")))
        if known is None:
            with pytest.raises(QueryError):
                P.opened(scope, effort)
        else:
            assert {tuple(r) for r in df.where(P.opened(scope, effort)).collect()} == known, (scope, effort)


def test_summary_precedence():
    full = P.Coverage(4, 3, 3, 3, records=9, matches=2)
    say = lambda request=None, coverage=full, n=2, **how: P.summary(request or Request("x"), coverage, n, **how)
    assert (say().state, say().outcome, say().completed, say().next_efforts) == ("complete", "matches", "exhaustive", ())
    assert say(n=0).outcome == "no_exhaustive_match" and say(Request("x", scope="prompts"), n=0).outcome == "no_prompt_match"
    assert say(Request("x", scope="prompts")).next_efforts == ("targeted", "exhaustive") and say(Request("x", effort="targeted")).next_efforts == ("exhaustive",)
    targeted = say(Request("x", effort="targeted"), n=0)
    assert (targeted.state, targeted.reason, targeted.outcome) == ("approximate", "heuristic_candidate_selection", "no_candidate_conversation")
    assert say(Request("x", effort="targeted"), P.Coverage(conversations=3), 0).outcome == "no_selected_conversation_match"
    everything = dict(failed=True, cancelled=True, truncated=True, approximate=True, answered_early=True, limit_reached=True)
    order = []
    for drop in ("failed", "cancelled", "truncated", "approximate", "answered_early", "limit_reached"):
        order.append((say(**everything).state, say(**everything).reason))
        everything[drop] = False
    assert order == [("failed", "engine_failure"), ("cancelled", "cancelled"), ("truncated", "response_truncated"), ("approximate", "approximate_execution"), ("bounded", "answer_now"), ("bounded", "result_limit")]
    assert say(failed=True).completed is None and say(failed=True).outcome == "undetermined" and say(coverage=P.Coverage(failed=1)).reason == "source_failure"
    assert say(coverage=P.Coverage(bounded=1, stops=("time_budget",))).reason == "time_budget" and say(Request("x", scope="prompts"), scope_given=True).confirm
    with pytest.raises(ValueError):
        P.Coverage(1, 2)
    with pytest.raises(ValueError):
        P.Coverage(records=1, matches=2)


def test_query_analysis():
    assert P.possible_kinds(parse("kind:prompt x")) == {"prompt"} and P.possible_kinds(parse("kind:prompt OR y")) == {"prompt", "history"} and P.possible_kinds(parse("kind:prompt kind:history")) == set()
    assert P.only_terms(parse("a b")) and not P.only_terms(parse("a OR b")) and not P.only_terms(parse("agent:codex a"))
    fields = {"agent", "store", "path"}
    assert P.unsupported_for_sources(parse("agent:codex x"), fields) is None and "text" in P.unsupported_for_sources(parse("agent:codex OR x"), fields) and "role" in P.unsupported_for_sources(parse("role:user"), fields)
    assert P.without_depth("a depth:targeted b EFFORT:prompt") == "a b" and P.joined([], []) == (None, None)


def test_authority_and_targeted_search(spark):
    rows = [("prompt", "prompt_history", "h", "s1", "ask bread", 1, True), ("history", "primary_chat", "c1", "s1", "bread here", 2, False), ("history", "primary_chat", "c2", "s2", "bread there", 3, False), ("history", "primary_chat", "c1", "s1", "ask bread", 4, False)]
    df = spark.createDataFrame(rows, "kind string, store_role string, path string, session_id string, text string, _ord long, is_authority boolean")
    for c in ("title", "role", "timestamp", "model", "conversation_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("agent", F.lit("codex")).withColumn("store", F.col("store_role")).withColumn("adapter_id", F.lit("x"))
    got = lambda request, n=None: sorted(r["_ord"] for r in S.search(df, request, n).collect())
    assert got(Request("bread")) == [1, 2, 3] and got(Request("bread", order="scan")) == [1, 2, 3, 4] and got(Request("bread", effort="targeted")) == [1, 2] and got(Request("bread", scope="prompts")) == [1]
    with pytest.raises(QueryError):
        got(Request("bread"), 3)
    seen, observation = P.observed(df)
    seen.count()
    assert observation.get["records"] == 4


def test_display(spark):
    texts = {"json": ['{"a": 1}', " [1]"], "text": ["", None, "- one", "{a", "2 ** 3", "#tag", "a > b", "[x] (y)", "-a\n-b", "|a|\nb"], "markdown": ["## Title", "```\nx", "so **bold** it", "> said", "see [a](b)", "- a\n- b", "  - a\n  - b", "1. a\n2. b", "| a | b |\n|---|:-:|", "x\n\n* a\n+ b"]}
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "want string, t string")
    wrong = [(r["want"], r["f"], r["t"]) for r in df.select("want", "t", D.content_format(F.col("t")).alias("f")).collect() if r["f"] != r["want"]]
    assert not wrong, wrong
    code = spark.createDataFrame([("import os", True), ("  def f(x):", True), ("x = {", True), ("a;", True), ("#include <x>", True), ("const a = 1", True), ("we import goods", False), ("class", False), (None, False)], "t string, want boolean")
    assert all(r["want"] == r["f"] for r in code.select("want", D.looks_like_code(F.col("t")).alias("f")).collect())
    assert D.looks_like_markup("<a x='1'>b</a>") and D.looks_like_markup("<br/><hr />") and not D.looks_like_markup("List<int> a < b") and not D.looks_like_markup("</a>") and not D.looks_like_markup(None)
    assert [D.elapsed(s) for s in (-1, 59.9, 60, 452, 3725)] == ["0s", "59s", "1m 0s", "7m 32s", "1h 02m"]
    assert D.compact_path("~/.codex/a/b/c/name.jsonl", 24) == "~/.codex/…/c/name.jsonl" and D.compact_path("~/.codex/a/b/c/name.jsonl", 16) == "…/c/name.jsonl" and D.compact_path("/a/b/verylongname", 8) == "verylon…" and D.compact_path("/a", 9) == "/a"
    now = F.to_timestamp(F.lit("2026-01-10T00:00:00Z"))
    times = spark.createDataFrame([("2026-01-09T23:59:30Z", "now"), ("2026-01-09T23:00:00Z", "1h ago"), ("2026-01-01T00:00:00Z", "1w ago"), ("2025-11-01T00:00:00Z", "2mo ago"), ("2023-01-01T00:00:00Z", "3y ago"), ("2027-01-01T00:00:00Z", "2027-01-01T00:00:00Z"), ("soon", "soon")], "w string, want string")
    assert all(r["want"] == r["f"] for r in times.select("want", D.relative_time(F.try_to_timestamp("w"), now, F.col("w")).alias("f")).collect())
    assert S.grep_pattern(["("]) == "(?!)" and D.usable(["a", "("]) == ["a"]


def test_carried_over_pieces(spark):
    rows = [("g" if k % 3 else None, k, k if k % 10 == 0 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    want, last = {}, {}
    for g, at, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[at] = last[g]
    assert {r["at"]: r["out"] for r in carried(df, ["g"], ["at"], "v", "out").collect()} == want and carried(df.limit(0), ["g"], ["at"], "v", "out").count() == 0
