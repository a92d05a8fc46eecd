"""Readers: the files of each store to records.

Lines are read as text and taken apart as variants inside the JVM; a file whose records depend on an earlier
line (a header, the model of a turn) is filled forward by a window over the file. Files that are one JSON value
are read whole. ``_ord`` is the place of a record in its file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.sources.extract import binary_texts, found_messages, unix_time
from skeinlog.sources.stores import BY_NAME, Store

ORIGIN = "struct<cwd:string,repo:string,worktree:string,branch:string,remote:string,cwd_hash:string>"
RECORD = ["kind", "agent", "store", "adapter_id", "path", "text", "title", "role", "timestamp", "model", "session_id", "conversation_id", "metadata", "origin", "_ord"]
USERS = ("user", "human")


def _get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{path}" if path else "$", kind)


def plain_path() -> Column:
    """The path of the row's file as it is on disk; Spark gives it as an address with its signs escaped."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Files as text, with the hidden columns of files; ``**`` in a path is any depth."""
    reader = spark.read
    root, deep, rest = path.partition("/**/") if isinstance(path, str) else (path, "", "")
    if deep:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", rest)
    return reader.text(root, wholetext=whole)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, _ord, v``: the lines of files as variants, null for what is no JSON; ``_ord`` grows along each file.

    Large files are split between tasks. The place of a line is that of its split in the file (in steps of 64 KB,
    and splits are larger) and its number in the task that reads it.
    """
    each = _text(spark, path).select(
        plain_path().alias("path"), (F.shiftleft(F.floor(F.col("_metadata.file_block_start") / 65_536).cast("bigint"), 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_ord"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    return each.where(F.trim("line") != "").select("path", "_ord", F.try_parse_json("line").alias("v"))


def values(spark: SparkSession, path: str) -> DataFrame:
    """``path, v``: files that are one JSON value."""
    return _text(spark, path, True).select(plain_path().alias("path"), F.try_parse_json("value").alias("v"))


def content_text(v: Column) -> Column:
    """The text of a content: itself where it is one, else its text parts (thinking included) joined by newlines."""
    parts = F.from_json(v.cast("string"), "array<struct<text:string,thinking:string,content:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], p["thinking"])), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    plain = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), joined).when(F.schema_of_variant(v) == "STRING", plain).otherwise(F.try_variant_get(v, "$.text", "string"))


def millis(ms: Column) -> Column:
    """Milliseconds as ISO text in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def origin(cwd: Column | None = None, branch: Column | None = None, remote: Column | None = None) -> Column:
    """An origin; null where nothing of it is known. A remote with credentials in it is left out."""
    null = F.lit(None).cast("string")
    safe = null if remote is None else F.when(~remote.rlike(r"://[^/\s]*@"), remote)
    cwd, branch = null if cwd is None else cwd, null if branch is None else branch
    return F.when(F.coalesce(cwd, branch, safe).isNotNull(), F.struct(cwd.alias("cwd"), null.alias("repo"), null.alias("worktree"), branch.alias("branch"), safe.alias("remote"), null.alias("cwd_hash"))).cast(ORIGIN)


def shaped(df: DataFrame, store: Store, **given: Column) -> DataFrame:
    """Records with all columns; rows without text are dropped, a user's are prompts."""
    null = F.lit(None).cast("string")
    role = given.get("role", null)
    columns = {
        "kind": F.when(F.lower(role).isin(*USERS) | F.lit(store.role == "prompt_history"), "prompt").otherwise("history"), "agent": F.lit(store.agent), "store": F.lit(store.store),
        "adapter_id": F.lit(store.adapter_id), "path": F.col("path"), "text": null, "title": null, "role": role, "timestamp": null, "model": null, "session_id": null,
        "conversation_id": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "metadata": F.lit(None).cast("map<string,string>"), "origin": F.lit(None).cast(ORIGIN), "_ord": F.col("_ord"),
    } | given
    return df.select(*[columns[c].alias(c) for c in RECORD]).where(F.coalesce(F.trim("text"), F.lit("")) != "")


def _forward(column: Column) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy("path").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0))


def codex_history(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = lines(spark, path)
    return shaped(rows, store, text=_get("v", "text"), role=F.lit("user"), session_id=_get("v", "session_id"), timestamp=F.date_format(F.timestamp_seconds(_get("v", "ts", "bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def codex_sessions(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = lines(spark, path).withColumn("type", _get("v", "type"))
    head = F.when(F.col("type") == "session_meta", F.struct(*[_get("v", f"payload.{p}").alias(n) for n, p in (("id", "id"), ("cwd", "cwd"), ("branch", "git.branch"), ("remote", "git.repository_url"))]))
    rows = rows.withColumn("head", _forward(head)).withColumn("turn_model", _forward(F.when(F.col("type") == "turn_context", _get("v", "payload.model"))))
    said = rows.where("type = 'response_item'").withColumn("payload", F.try_variant_get("v", "$.payload", "variant")).where(_get("payload", "role").isNotNull())
    return shaped(said, store, text=content_text(F.try_variant_get("payload", "$.content", "variant")), role=_get("payload", "role"), timestamp=F.coalesce(_get("payload", "timestamp"), _get("v", "timestamp")),
                  model=F.col("turn_model"), session_id=F.col("head.id"), origin=origin(F.col("head.cwd"), F.col("head.branch"), F.col("head.remote")))


def claude_history(spark: SparkSession, path: str, store: Store) -> DataFrame:
    @F.pandas_udf("string")
    def with_pastes(display: pd.Series, pasted: pd.Series) -> pd.Series:
        out = []
        for text, raw in zip(display, pasted, strict=True):
            for key, paste in (json.loads(raw) if raw else {}).items():
                if isinstance(paste, dict) and isinstance(paste.get("content"), str) and text:
                    import re

                    text = re.sub(rf"\[Pasted text #{re.escape(str(key))}(?: \+\d+ lines)?\]", lambda _m, p=paste: p["content"], text)
            out.append(text)
        return pd.Series(out, dtype="object")

    rows = lines(spark, path)
    return shaped(rows, store, text=with_pastes(_get("v", "display"), F.try_variant_get("v", "$.pastedContents", "variant").cast("string")), role=F.lit("user"), session_id=_get("v", "sessionId"),
                  timestamp=millis(_get("v", "timestamp", "bigint")), origin=origin(_get("v", "project")))


def claude_session(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = lines(spark, path).withColumn("m", F.try_variant_get("v", "$.message", "variant"))
    rows = rows.withColumn("first_origin", F.first(F.when(_get("v", "cwd").isNotNull(), F.struct(_get("v", "cwd").alias("cwd"), _get("v", "gitBranch").alias("branch"))), ignorenulls=True).over(
        Window.partitionBy("path").orderBy("_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # The facts of a message are those of its inner object, so its time and session stay unknown.
    return shaped(rows.where(_get("m", "role").isNotNull()), store, text=content_text(F.try_variant_get("m", "$.content", "variant")), role=_get("m", "role"), model=_get("m", "model"), timestamp=_get("m", "timestamp"),
                  origin=origin(F.col("first_origin.cwd"), F.col("first_origin.branch")))


def cursor_transcripts(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return shaped(lines(spark, path), store, text=content_text(F.try_variant_get("v", "$.message.content", "variant")), role=_get("v", "role"))


def string_list(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = values(spark, path).select("path", F.posexplode(F.from_json(F.col("v").cast("string"), "array<string>")).alias("_ord", "said"))
    return shaped(rows.withColumn("_ord", F.col("_ord").cast("bigint")), store, text=F.col("said"), role=F.lit("user")).dropDuplicates(["path", "text"])


def gemini_chats(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = lines(spark, path)
    rows = rows.withColumn("sid", _forward(_get("v", "sessionId")))
    thoughts = F.from_json(F.try_variant_get("v", "$.thoughts", "variant").cast("string"), "array<struct<subject:string,description:string>>")
    thought = F.array_join(F.transform(thoughts, lambda t: F.concat_ws(": ", t["subject"], t["description"])), "\n")
    text = F.concat_ws("\n", F.when(content_text(F.try_variant_get("v", "$.content", "variant")) != "", content_text(F.try_variant_get("v", "$.content", "variant"))), F.when(thought != "", thought))
    said = rows.where(_get("v", "type").isNotNull())
    return shaped(said, store, text=text, role=F.when(_get("v", "type") == "gemini", "assistant").otherwise(_get("v", "type")), timestamp=_get("v", "timestamp"), model=_get("v", "model"), session_id=F.col("sid"))


def gemini_logs(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = values(spark, path).select("path", F.posexplode(F.from_json(F.col("v").cast("string"), "array<struct<sessionId:string,messageId:int,timestamp:string,type:string,message:string>>")).alias("_ord", "e"))
    return shaped(rows.withColumn("_ord", F.col("_ord").cast("bigint")).where("e.type = 'user'"), store, text=F.col("e.message"), role=F.col("e.type"), timestamp=F.col("e.timestamp"), session_id=F.col("e.sessionId"))


def _decoded_directory(levels: int) -> Column:
    return F.try_url_decode(F.element_at(F.split("path", "/"), -1 - levels))


def grok_prompts(spark: SparkSession, path: str, store: Store) -> DataFrame:
    cwd = _decoded_directory(1)
    return shaped(lines(spark, path), store, text=_get("v", "prompt"), role=F.lit("user"), timestamp=_get("v", "timestamp"), session_id=_get("v", "session_id"), origin=origin(F.when(cwd.startswith("/"), cwd)))


def grok_sessions(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return shaped(lines(spark, path), store, text=content_text(F.try_variant_get("v", "$.content", "variant")), role=_get("v", "type"), timestamp=_get("v", "timestamp"), session_id=F.element_at(F.split("path", "/"), -2))


def grok_subagents(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = values(spark, path).withColumn("_ord", F.lit(0).cast("bigint"))
    return shaped(rows, store, text=_get("v", "prompt"), kind=F.lit("prompt"), role=F.lit("user"), title=_get("v", "description"), timestamp=_get("v", "started_at"), model=_get("v", "effective_model_id"),
                  session_id=_get("v", "child_session_id"), origin=origin(_get("v", "child_cwd")))


def antigravity_history(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return shaped(lines(spark, path), store, text=_get("v", "display"), role=F.lit("user"), timestamp=millis(_get("v", "timestamp", "bigint")), session_id=_get("v", "conversationId"), origin=origin(_get("v", "workspace")))


def pi_sessions(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = lines(spark, path).withColumn("type", _get("v", "type"))
    head = F.when(F.col("type") == "session", F.struct(_get("v", "id").alias("id"), _get("v", "cwd").alias("cwd")))
    rows = rows.withColumn("head", _forward(head)).where("type in ('message', 'compaction', 'branch_summary', 'session_info')")
    text = F.when(F.col("type") == "message", content_text(F.try_variant_get("v", "$.message.content", "variant"))).when(F.col("type") == "session_info", _get("v", "name")).otherwise(_get("v", "summary"))
    role = F.when(F.col("type") == "message", _get("v", "message.role")).otherwise(F.col("type"))
    return shaped(rows, store, text=text, role=role, timestamp=_get("v", "timestamp"), model=_get("v", "message.model"), session_id=F.col("head.id"), origin=origin(F.col("head.cwd")))


CHAT = "struct<sessionId:string,requests:array<struct<requestId:string,timestamp:bigint,modelId:string,message:struct<text:string>,response:array<struct<kind:string,value:string,content:struct<value:string>>>,result:struct<metadata:struct<toolCallRounds:array<struct<toolCalls:array<struct<name:string>>>>>>>>>"


def _chat_records(rows: DataFrame, store: Store) -> DataFrame:
    title = F.element_at(F.filter(F.transform("chat.requests", lambda r: r["message"]["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1)
    each = rows.select("path", title.alias("title"), F.col("chat.sessionId").alias("sid"), F.posexplode("chat.requests").alias("at", "r"))
    tools = F.flatten(F.transform(F.coalesce("r.result.metadata.toolCallRounds", F.array()), lambda x: F.transform(F.coalesce(x["toolCalls"], F.array()), lambda c: c["name"])))
    reply = F.concat_ws("", F.transform("r.response", lambda e: F.when(e["kind"].isNull(), e["value"]).when(e["kind"] == "markdownContent", e["content"]["value"])))
    sides = F.array(
        F.struct(F.lit("user").alias("role"), F.col("r.message.text").alias("said"), F.array().cast("array<string>").alias("tools"), F.lit(0).alias("side")),
        F.struct(F.lit("assistant").alias("role"), reply.alias("said"), tools.alias("tools"), F.lit(1).alias("side")))
    both = each.select("path", "title", "sid", "at", "r", F.explode(sides).alias("s")).withColumn("_ord", (F.col("at") * 2 + F.col("s.side")).cast("bigint"))
    return shaped(both, store, text=F.col("s.said"), role=F.col("s.role"), title=F.col("title"), timestamp=millis(F.col("r.timestamp")), model=F.col("r.modelId"), session_id=F.col("sid"),
                  metadata=F.when(F.size("s.tools") > 0, F.create_map(F.lit("tools"), F.to_json("s.tools"))))


def vscode_chats(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return _chat_records(values(spark, path).select("path", F.from_json(F.col("v").cast("string"), CHAT).alias("chat")), store)


def replay(changes: list[dict]) -> object:
    """The value that a log of changes builds: kind 0 sets the whole, 1 sets at a path, 2 puts into a list from an index on."""
    state: object = None
    for change in changes:
        kind, keys, value = change.get("kind"), change.get("k") or [], change.get("v")
        if kind == 0:
            state = value
            continue
        at = state
        try:
            for key in keys[:-1]:
                at = at[key]
            last = keys[-1]
            if kind == 1:
                if isinstance(at, list) and last == len(at):
                    at.append(value)
                else:
                    at[last] = value
            elif kind == 2:
                target = at.setdefault(last, []) if isinstance(at, dict) else at[last]
                start = change.get("i", len(target))
                target[start:] = value if isinstance(value, list) else [value]
        except (KeyError, IndexError, TypeError):
            continue
    return state


def vscode_log(spark: SparkSession, path: str, store: Store) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                changes = []
                for line in text.splitlines():
                    try:
                        change = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(change, dict):
                        changes.append(change)
                out.append(json.dumps(replay(changes)))
            yield pd.DataFrame({"path": pdf["path"], "chat": out})

    whole = _text(spark, path, True).select(plain_path().alias("path"), "value")
    return _chat_records(whole.mapInPandas(run, "path string, chat string").select("path", F.from_json("chat", CHAT).alias("chat")), store)


def codex_state(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = spark.read.format("skeinlog_sqlite").option("table", "threads").option("columns", "id,rollout_path,first_user_message,title,updated_at_ms,model,cwd,git_branch,git_origin_url").load(path)
    rows = rows.withColumn("_ord", F.col("row"))
    return shaped(rows, store, text=F.col("first_user_message"), title=F.col("title"), role=F.lit("user"), timestamp=millis(F.col("updated_at_ms").try_cast("bigint")), model=F.col("model"), session_id=F.col("id"),
                  origin=origin(F.col("cwd"), F.col("git_branch"), F.col("git_origin_url")), path=F.coalesce("rollout_path", "path"))


def opencode(spark: SparkSession, path: str, store: Store) -> DataFrame:
    read = lambda t, c: spark.read.format("skeinlog_sqlite").option("table", t).option("columns", c).load(path)
    part = read("part", "id,message_id,session_id,data").select(F.col("path"), F.col("row").alias("_ord"), "message_id", "session_id", F.try_parse_json("data").alias("v"))
    message = read("message", "id,data").select(F.col("path").alias("mp"), F.col("id").alias("mid"), F.try_parse_json("data").alias("m"))
    session = read("session", "id,title,directory").select(F.col("path").alias("sp"), F.col("id").alias("sid"), "title", "directory")
    rows = part.join(message, (F.col("message_id") == F.col("mid")) & (F.col("path") == F.col("mp"))).join(session, (F.col("session_id") == F.col("sid")) & (F.col("path") == F.col("sp")))
    text = F.when(_get("v", "type").isin("text", "reasoning"), _get("v", "text")).when(_get("v", "type") == "subtask", F.coalesce(_get("v", "prompt"), _get("v", "description")))
    return shaped(rows, store, text=text, role=_get("m", "role"), title=F.col("title"), timestamp=millis(_get("m", "time.created", "bigint")), model=_get("m", "modelID"), session_id=F.col("session_id"), origin=origin(F.col("directory")))


def _walked(rows: DataFrame, store: Store) -> DataFrame:
    """Records of ``path, _ord, raw``: every message inside the JSON texts, wherever it is."""
    found = found_messages(rows, "raw", ["path", "_ord"])
    placed = found.withColumn("__n", F.col("nth").cast("bigint"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    at = F.when(F.col("_ord") == 0, F.col("__n")).otherwise(F.col("_ord") * 1024 + F.least("__n", F.lit(1023)))
    return shaped(placed.withColumn("_ord", at), store, **{c: F.col(c) for c in ("text", "role", "title", "timestamp", "model", "session_id")}, conversation_id=F.coalesce("conversation_id", stem), origin=F.col("origin").cast(ORIGIN))


def walked_values(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return _walked(_text(spark, path, True).select(plain_path().alias("path"), F.lit(0).cast("bigint").alias("_ord"), F.col("value").alias("raw")), store)


def walked_lines(spark: SparkSession, path: str, store: Store) -> DataFrame:
    return _walked(lines(spark, path).where("v is not null").select("path", "_ord", F.to_json("v").alias("raw")), store)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, True).select(plain_path().alias("path"), "value", F.lit(0).cast("bigint").alias("_ord"), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written"))


def whole_text(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """One record per file: its whole text, timed by the file."""
    return shaped(_files(spark, path), store, text=F.col("value"), timestamp=F.col("written"), title=F.regexp_extract("path", r"([^/]+)$", 1))


def summaries(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """One record per JSON file: its names with the shape of each value, never the values, which may be secret."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json("value")), r"^OBJECT<|>$", "")
    return shaped(_files(spark, path).where(F.try_parse_json("value").isNotNull()), store, text=F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(": "), shape), timestamp=F.col("written"))


def toml_summaries(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """One record per TOML file: its tables and names, without values."""
    line = F.transform(F.split("value", "\r?\n"), lambda x: F.regexp_extract(x, r"^\s*(\[[^\]]+\]|[\w.\"'-]+(?=\s*=))", 1))
    return shaped(_files(spark, path), store, text=F.array_join(F.filter(line, lambda x: x != ""), "\n"), timestamp=F.col("written"))


def file_facts(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """One record per file: its name, size and number of lines, nothing of its content."""
    rows = _files(spark, path)
    said = F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(": "), F.length(F.encode("value", "UTF-8")).cast("string"), F.lit(" bytes, "), F.size(F.split("value", "\n")).cast("string"), F.lit(" lines"))
    return shaped(rows, store, text=said, timestamp=F.col("written"))


def titles(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Names of sessions from an index of one per line."""
    return shaped(lines(spark, path), store, text=F.coalesce(_get("v", "thread_name"), _get("v", "title"), _get("v", "name")), session_id=F.coalesce(_get("v", "id"), _get("v", "session_id")), timestamp=F.coalesce(_get("v", "updated_at"), _get("v", "timestamp")))


def todos(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Tasks: one object a file, a list of them, or one under ``todos`` or ``tasks``."""
    v = F.col("v")
    listed = F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("string")), F.to_json(F.try_variant_get(v, "$.todos", "variant")), F.to_json(F.try_variant_get(v, "$.tasks", "variant")), F.concat(F.lit("["), v.cast("string"), F.lit("]")))
    each = values(spark, path).where("v is not null").select("path", F.posexplode(F.from_json(listed, "array<struct<content:string,subject:string,title:string,description:string,status:string,id:string>>")).alias("at", "t"))
    said = F.concat_ws("\n", F.coalesce("t.content", "t.subject", "t.title"), "t.description")
    return shaped(each.withColumn("_ord", F.col("at").cast("bigint")), store, text=said, metadata=F.when(F.col("t.status").isNotNull(), F.create_map(F.lit("status"), F.col("t.status"))))


def store_messages(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Messages of a relational store: a base table, left-joined with those of the two sides."""
    read = lambda t, c: spark.read.format("skeinlog_sqlite").option("table", t).option("columns", c).load(path)
    base = read("base_messages", "uuid,session_id,timestamp,cwd").withColumn("_ord", F.col("row"))
    user = read("user_messages", "uuid,message").select(F.col("uuid").alias("u"), F.col("path").alias("up"), F.col("message").alias("asked"))
    reply = read("assistant_messages", "uuid,message,model").select(F.col("uuid").alias("a"), F.col("path").alias("ap"), F.col("message").alias("said"), "model")
    rows = base.join(user, (F.col("uuid") == F.col("u")) & (F.col("path") == F.col("up")), "left").join(reply, (F.col("uuid") == F.col("a")) & (F.col("path") == F.col("ap")), "left")
    raw = F.try_parse_json(F.coalesce("asked", "said"))
    text = F.coalesce(content_text(F.try_variant_get(raw, "$.content", "variant")), F.coalesce("asked", "said"))
    stamp = F.col("timestamp").try_cast("bigint")
    return shaped(rows, store, text=text, role=F.when(F.col("asked").isNotNull(), "user").when(F.col("said").isNotNull(), "assistant"), model=F.col("model"), session_id=F.col("session_id"),
                  timestamp=F.coalesce(F.when(stamp > 10_000_000_000, millis(stamp)).otherwise(unix_time(stamp)), F.col("timestamp")), origin=origin(F.col("cwd")))


def _rows(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.format("skeinlog_sqlite").option("table", name).option("columns", columns).load(path).withColumn("_ord", F.col("row"))


def grok_search(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """The documents of a search index of sessions."""
    rows = _rows(spark, path, "session_docs", "session_id,cwd,title,content,updated_at")
    return shaped(rows, store, text=F.col("content"), title=F.col("title"), session_id=F.col("session_id"), timestamp=F.col("updated_at"), origin=origin(F.col("cwd")))


def summarized_talks(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Summaries of conversations: short form, overview and points."""
    rows = _rows(spark, path, "conversation_summaries", "conversationId,title,tldr,overview,summaryBullets,model,mode,updatedAt")
    points = F.from_json("summaryBullets", "array<string>")
    listed = F.when(points.isNull(), F.col("summaryBullets")).otherwise(F.array_join(F.transform(F.filter(points, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), x)), "\n"))
    text = F.concat_ws("\n", F.when(F.col("tldr") != "", F.col("tldr")), F.when(F.col("overview") != "", F.col("overview")), F.when(listed != "", listed))
    return shaped(rows, store, text=text, title=F.col("title"), model=F.col("model"), conversation_id=F.col("conversationId"), timestamp=millis(F.col("updatedAt").try_cast("bigint")))


def codex_goals(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = _rows(spark, path, "thread_goals", "thread_id,goal_id,objective,status")
    return shaped(rows, store, text=F.col("objective"), session_id=F.col("thread_id"), metadata=F.when(F.col("status").isNotNull(), F.create_map(F.lit("status"), F.col("status"))))


def codex_memories(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = _rows(spark, path, "stage1_outputs", "thread_id,raw_memory")
    return shaped(rows, store, text=F.col("raw_memory"), session_id=F.col("thread_id"))


def codex_logs(spark: SparkSession, path: str, store: Store) -> DataFrame:
    rows = _rows(spark, path, "logs", "id,ts,level,target,feedback_log_body,thread_id")
    return shaped(rows, store, text=F.col("feedback_log_body"), title=F.col("target"), session_id=F.col("thread_id"), timestamp=unix_time(F.col("ts").try_cast("double")))


#: Keys of key-value tables that hold chats, by their beginnings; fixed values.
CHAT_KEYS = ("composerData:", "bubbleId:", "aiService.prompts", "aiService.generations", "workbench.panel.aichat", "interactive.", "inline-chat-history", "memento/interactive")


def key_values(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Messages in the values of a key-value table, and lists of texts under its prompt keys."""
    parts = []
    for name in ("ItemTable", "cursorDiskKV"):
        rows = spark.read.format("skeinlog_sqlite").option("table", name).option("columns", "key,value").load(path)
        wanted = F.lit(False)
        for begin in CHAT_KEYS:
            wanted = wanted | F.col("key").startswith(begin)
        parts.append(rows.where(wanted).select("path", F.col("row").alias("_ord"), "key", F.col("value").cast("string").alias("raw")))
    rows = parts[0].unionByName(parts[1])
    texts = F.from_json("raw", "array<struct<text:string>>")
    alone = rows.where(F.contains("key", F.lit("prompts")) | F.contains("key", F.lit("history"))).select("path", F.col("_ord").alias("at"), F.posexplode(F.coalesce(F.filter(F.transform(texts, lambda x: x["text"]), lambda x: x.isNotNull()), F.from_json("raw", "array<string>"))).alias("n", "said"))
    prompts = shaped(alone.withColumn("_ord", F.col("at") * 1_000_000 + F.col("n")), store, text=F.col("said"), role=F.lit("user"))
    bubbles = rows.where(F.col("key").startswith("bubbleId:")).withColumn("v", F.try_parse_json("raw"))
    spoken = shaped(bubbles, store, text=_get("v", "text"), role=F.when(_get("v", "type", "int") == 1, "user").otherwise("assistant"), model=F.coalesce(_get("v", "modelInfo.modelName"), _get("v", "model")), conversation_id=F.element_at(F.split("key", ":"), 2))
    return prompts.unionByName(spoken).unionByName(_walked(rows.where(~F.col("key").startswith("bubbleId:")).select("path", "_ord", "raw"), store))


def binary_blobs(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Readable texts inside the binary values of a database whose layout is not known; JSON inside them is walked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, o * 10_000 + n, t) for p, o, v in zip(pdf["path"], pdf["_ord"], pdf["value"], strict=True) for n, t in enumerate(binary_texts(bytes.fromhex(v) if isinstance(v, str) else bytes(v or b"")))]
            yield pd.DataFrame(rows, columns=["path", "_ord", "raw"])

    rows = spark.read.format("skeinlog_sqlite").option("table", "blobs,steps,trajectories").option("columns", "data,step_payload,content").option("binary", "true").load(path)
    texts = rows.select("path", F.col("row").alias("_ord"), F.coalesce("data", "step_payload", "content").alias("value")).where("value is not null").mapInPandas(run, "path string, _ord bigint, raw string")
    plain = texts.where(~F.ltrim("raw").rlike(r"^[\[{]"))
    return shaped(plain, store, text=F.col("raw")).unionByName(_walked(texts.where(F.ltrim("raw").rlike(r"^[\[{]")), store))


READERS: dict[str, Callable[[SparkSession, str, Store], DataFrame]] = {
    f.__name__: f for f in (
        codex_history, codex_sessions, codex_state, claude_history, claude_session, cursor_transcripts, string_list, gemini_chats, gemini_logs, grok_prompts, grok_sessions, grok_subagents, antigravity_history,
        pi_sessions, vscode_chats, vscode_log, opencode, walked_values, walked_lines, whole_text, summaries, toml_summaries, file_facts, titles, todos, store_messages, key_values, binary_blobs, grok_search, summarized_talks, codex_goals, codex_memories, codex_logs)
}


def read(spark: SparkSession, store: str, path: str) -> DataFrame:
    """The records of the files at ``path`` (a file, a glob or a directory), read as those of ``store``."""
    from skeinlog.sources.sqlite import register

    register(spark)
    known = BY_NAME[store]
    return READERS[known.reader](spark, path, known)


def read_home(spark: SparkSession, home: str, agents: list[str] | None = None, default_only: bool = True) -> DataFrame:
    """All records below a home directory, with the role and coverage of their store; stores without files add nothing.

    Only whether a store has files is asked of the file system beforehand; paths are listed by the scans themselves.
    ``default_only`` leaves out stores that are searched on demand only.
    """
    from skeinlog.sources.sqlite import register
    from skeinlog.sources.stores import STORES, files

    register(spark)
    out = None
    for s in STORES:
        if (agents and s.agent not in agents) or (default_only and s.coverage != "default_search") or files(spark, s.below(home)) is None:
            continue
        rows = READERS[s.reader](spark, s.below(home), s).withColumn("store_role", F.lit(s.role)).withColumn("coverage", F.lit(s.coverage))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"no store below {home}")
    return out
