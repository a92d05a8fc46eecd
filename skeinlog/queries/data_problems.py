"""Queries of the general data problems (1, 2, 6, 7) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.ids import clean_id
from skeinlog.operators.drift import changes, unify
from skeinlog.operators.hierarchy import descendants, resolve, whole_paths
from skeinlog.operators.instants import normalize_instants
from skeinlog.operators.shredding import flat_tables, nested_links, parse_content
from skeinlog.runtime import cut, table

#: Table, key and field of each written time; fixed values.
WRITTEN_TIMES = [
    ("codex_history", "row_id", "ts"),
    ("claude_messages", "uuid", "timestamp"),
    ("grok_prompts", "row_id", "timestamp"),
    ("gemini_sessions", "sessionId", "startTime"),
    ("grok_subagents", "subagent_id", "started_at"),
]


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, row_key, value, tz, date_order`` of the five time fields."""
    parts = []
    for name, key, field in WRITTEN_TIMES:
        column = F.col(key).cast("string") if key == "row_id" else clean_id(F.col(key))
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), column.alias("row_key"), F.col(field).alias("value"), "machine"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    machines = table(spark, sf_dir, "machines").select("machine", "tz", "date_order")
    return rows.where("row_key is not null and value is not null").join(machines, "machine", "left").drop("machine")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: one row per value that denotes an existing date and time."""
    found = normalize_instants(written_times(spark, sf_dir), "value")
    return found.where("utc_us is not null").select("tbl", "row_key", "utc_us").distinct()


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: of each written time whether its local time was ambiguous (2 offsets), skipped (0) or plain (1)."""
    found = normalize_instants(written_times(spark, sf_dir), "value", matches="n_offsets")
    return found.select("tbl", "row_key", "value", "utc_us", "n_offsets").distinct()


def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, parent, locality`` of claude_messages."""
    return table(spark, sf_dir, "claude_messages").select(
        clean_id(F.col("uuid")).alias("node"), clean_id(F.col("parentUuid")).alias("parent"), clean_id(F.col("sessionId")).alias("locality")
    ).where("node is not null")


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, parent`` of grok_subagents: each id in either field is a node."""
    pairs = table(spark, sf_dir, "grok_subagents").select(clean_id(F.col("child_session_id")).alias("node"), clean_id(F.col("parent_session_id")).alias("parent"))
    tops = pairs.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return pairs.unionByName(tops).where("node is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: root and depth of every message and session."""
    messages = resolve(message_links(spark, sf_dir)).select(F.lit("message").alias("tree"), "node", "root", "depth")
    sessions = resolve(session_links(spark, sf_dir)).select(F.lit("session").alias("tree"), "node", "root", "depth")
    return messages.unionByName(sessions)


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: the path of every message and session from its root, as an array of ids; rings as in ``ring_walks``."""
    parts = []
    for tree, links in (("message", message_links(spark, sf_dir)), ("session", session_links(spark, sf_dir))):
        parts.append(whole_paths(links, cut(resolve(links))).select(F.lit(tree).alias("tree"), "node", "root", "depth", "path"))
    return parts[0].unionByName(parts[1])


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: every ancestor and descendant of the trees and rings, with their distance."""
    parts = []
    for tree, links in (("message", message_links(spark, sf_dir)), ("session", session_links(spark, sf_dir))):
        parts.append(descendants(whole_paths(links, cut(resolve(links)))).select(F.lit(tree).alias("tree"), "*"))
    return parts[0].unionByName(parts[1])


#: Branch, path and depth of the lists of a request; fixed values.
REQUEST_BRANCHES = {
    "message.parts": ("message.parts", 2),
    "response": ("response", 2),
    "toolCallRounds": ("result.metadata.toolCallRounds", 2),
    "toolCalls": ("result.metadata.toolCallRounds.toolCalls", 3),
}


def transcript_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record`` of cursor_lines: an array of one struct with the line's key and content, for shredding."""
    lines = table(spark, sf_dir, "cursor_lines").select("line_id", "raw")
    return parse_content(lines, "raw", "line_id").select(F.array(F.struct("key", F.col("content").alias("message"))).alias("record"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: one row per non-null element of the nested arrays, with its parent's key and its place."""
    chats = nested_links(table(spark, sf_dir, "vscode_chats"), "requests", REQUEST_BRANCHES, "requestId")
    lines = nested_links(transcript_content(spark, sf_dir), "record", {"message.content": ("message", 2)}, "key")
    return chats.select(F.lit("vscode_chats").alias("tbl"), "parent_key", "branch", "pos").unionByName(
        lines.select(F.lit("cursor_lines").alias("tbl"), "parent_key", "branch", "pos")
    ).distinct()


def request_table(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The flat table of one list of the requests, keyed by saved file and places."""
    return flat_tables(table(spark, sf_dir, "vscode_chats"), "requests", "source_file")[path].distinct()


def p6_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of response elements, keyed by saved file and places."""
    return request_table(spark, sf_dir, "response")


def p6_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of requests, keyed by saved file."""
    return request_table(spark, sf_dir, "")


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of message parts, keyed by saved file and places."""
    return request_table(spark, sf_dir, "message.parts")


def p6_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of rounds of tool calls, keyed by saved file and places."""
    return request_table(spark, sf_dir, "result.metadata.toolCallRounds")


def p6_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of tool calls, keyed by saved file and places."""
    return request_table(spark, sf_dir, "result.metadata.toolCallRounds.toolCalls")


def p6_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the flat table of content elements of transcript lines, keyed by line."""
    lines = parse_content(table(spark, sf_dir, "cursor_lines").select("line_id", "raw"), "raw", "line_id")
    return flat_tables(lines, "content", "key")[""].withColumnRenamed("key", "line_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: every change of fields between a file and the one before it."""
    return changes(table(spark, sf_dir, "raw_lines"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: all lines in one table with consistent names of fields."""
    return unify(table(spark, sf_dir, "raw_lines"))


def _forest_sql(rest: str) -> str:
    """SQL over both kinds of links: ``l`` has one link per node, ``tree`` the trees, ``rest`` what is on or leads into a ring."""
    clean = lambda c: f"lower(regexp_replace(trim({c}), '^[{{]+|[}}]+$', '', 'g'))"
    blank = lambda c: f"nullif({clean(c)}, '')"
    return f"""
        WITH RECURSIVE pairs AS (
            SELECT 'message' AS tree, {blank("uuid")} AS node, {blank('"parentUuid"')} AS parent FROM claude_messages
            UNION ALL SELECT 'session', {blank("child_session_id")}, {blank("parent_session_id")} FROM grok_subagents
            UNION ALL SELECT 'session', {blank("parent_session_id")}, NULL FROM grok_subagents),
        l AS (SELECT tree, node, min(parent) AS parent FROM pairs WHERE node IS NOT NULL GROUP BY ALL),
        trees AS (
            SELECT tree, node, node AS root, 0 AS depth, [node] AS path FROM l WHERE parent IS NULL OR (tree, parent) NOT IN (SELECT (tree, node) FROM l)
            UNION ALL SELECT l.tree, l.node, t.root, t.depth + 1, list_append(t.path, l.node) FROM trees t JOIN l ON l.tree = t.tree AND l.parent = t.node),
        ringed AS (SELECT * FROM l WHERE (tree, node) NOT IN (SELECT (tree, node) FROM trees)),
        reach AS (SELECT tree, node, parent AS anc FROM ringed UNION SELECT r.tree, r.node, k.parent FROM reach r JOIN ringed k ON k.tree = r.tree AND k.node = r.anc),
        ring AS (SELECT tree, node FROM reach WHERE node = anc),
        named AS (SELECT r.tree, r.node, min(r.anc) AS root, CASE WHEN (r.tree, r.node) IN (SELECT (tree, node) FROM ring) THEN -1 ELSE -2 END AS depth
                  FROM reach r WHERE (r.tree, r.anc) IN (SELECT (tree, node) FROM ring) GROUP BY r.tree, r.node),
        walks AS (
            SELECT tree, node, node AS at, [node] AS path FROM ringed
            UNION ALL SELECT w.tree, w.node, k.parent, list_prepend(k.parent, w.path) FROM walks w JOIN ringed k ON k.tree = w.tree AND k.node = w.at WHERE NOT list_contains(w.path, k.parent)),
        walked AS (SELECT tree, node, arg_max(path, len(path)) AS walk FROM walks GROUP BY tree, node),
        first_ring AS (SELECT w.tree, w.node, arg_min(w.path, len(w.path)) AS path FROM walks w WHERE (w.tree, w.at) IN (SELECT (tree, node) FROM ring) GROUP BY w.tree, w.node)
        {rest}
    """


#: The requests of each saved file once, with their places.
FILES = "WITH files AS (SELECT DISTINCT source_file, requests FROM vscode_chats), reqs AS (SELECT source_file, unnest(range(len(requests))) AS i, requests FROM files), r AS (SELECT source_file, CAST(i AS INTEGER) AS i, requests[i + 1] AS q FROM reqs)"

QUERIES = {
    "p2_found": p2_found,
    "p2_unified": p2_unified,
    "p6_found": p6_found,
    "p6_responses": p6_responses,
    "p6_requests": p6_requests,
    "p6_parts": p6_parts,
    "p6_rounds": p6_rounds,
    "p6_calls": p6_calls,
    "p6_content": p6_content,
    "p1_found": p1_found,
    "p1_paths": p1_paths,
    "p1_descendants": p1_descendants,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
}
SQL: dict[str, str] = {
    "p1_found": _forest_sql("SELECT tree, node, root, CAST(depth AS INTEGER) AS depth FROM trees UNION ALL SELECT tree, node, root, CAST(depth AS INTEGER) FROM named"),
    "p1_paths": _forest_sql("""SELECT tree, node, root, CAST(depth AS INTEGER) AS depth, path FROM trees
        UNION ALL SELECT n.tree, n.node, n.root, CAST(n.depth AS INTEGER), CASE WHEN n.depth = -1 THEN w.walk ELSE f.path END
        FROM named n JOIN walked w ON w.tree = n.tree AND w.node = n.node JOIN first_ring f ON f.tree = n.tree AND f.node = n.node"""),
    "p1_descendants": _forest_sql("""SELECT tree, unnest(path) AS ancestor, node, CAST(len(path) - unnest(range(1, len(path) + 1)) AS INTEGER) AS distance FROM trees
        UNION ALL SELECT tree, unnest(walk), node, CAST(len(walk) - unnest(range(1, len(walk) + 1)) AS INTEGER) FROM walked"""),
    "p6_found": """
        WITH asked AS (SELECT unnest(requests) AS r FROM vscode_chats),
        reqs AS (SELECT r."requestId" AS id, r.message.parts AS parts, r.response AS response, r.result.metadata."toolCallRounds" AS rounds FROM asked WHERE r."requestId" IS NOT NULL),
        called AS (SELECT id, rounds, unnest(range(len(rounds))) AS i FROM reqs),
        lines AS (SELECT line_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM cursor_lines),
        said AS (SELECT line_id, j->'$.message.content' AS c FROM lines WHERE json_type(j) = 'OBJECT' AND json_type(j->'$.message') = 'OBJECT'),
        text AS (SELECT line_id, c, CASE WHEN json_type(c) = 'VARCHAR' AND json_valid(c->>'$') AND json_type(CASE WHEN json_valid(c->>'$') THEN CAST(c->>'$' AS JSON) END) = 'ARRAY' THEN CAST(c->>'$' AS JSON) ELSE c END AS body FROM said),
        content AS (SELECT line_id, CASE WHEN json_type(body) = 'ARRAY' THEN CAST(body AS JSON[]) ELSE [body] END AS e FROM text WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
        rows AS (
            SELECT 'vscode_chats' AS tbl, id AS parent_key, 'message.parts' AS branch, unnest(range(len(parts))) AS pos, unnest(list_transform(parts, lambda x: x IS NOT NULL)) AS there FROM reqs
            UNION ALL SELECT 'vscode_chats', id, 'response', unnest(range(len(response))), unnest(list_transform(response, lambda x: x IS NOT NULL)) FROM reqs
            UNION ALL SELECT 'vscode_chats', id, 'toolCallRounds', unnest(range(len(rounds))), unnest(list_transform(rounds, lambda x: x IS NOT NULL)) FROM reqs
            UNION ALL SELECT 'vscode_chats', id || '#' || i, 'toolCalls', unnest(range(len(rounds[i + 1]."toolCalls"))), unnest(list_transform(rounds[i + 1]."toolCalls", lambda x: x IS NOT NULL)) FROM called
            UNION ALL SELECT 'cursor_lines', CAST(line_id AS VARCHAR), 'message.content', unnest(range(len(e))), unnest(list_transform(e, lambda x: x IS NOT NULL AND json_type(x) <> 'NULL')) FROM content)
        SELECT DISTINCT tbl, parent_key, branch, CAST(pos AS INTEGER) AS pos FROM rows WHERE there
    """,
    "p6_requests": FILES + """
        SELECT DISTINCT source_file, CAST([] AS INTEGER[]) AS places, i AS pos, q."requestId" AS "requestId", q.timestamp AS timestamp, q."modelId" AS "modelId",
               q.message.text AS message_text, q."isCanceled" AS "isCanceled" FROM r WHERE q IS NOT NULL
    """,
    "p6_parts": FILES + """, e AS (SELECT source_file, i, unnest(range(len(q.message.parts))) AS j, q.message.parts AS parts FROM r)
        SELECT DISTINCT source_file, [i] AS places, CAST(j AS INTEGER) AS pos, parts[j + 1].kind AS kind, parts[j + 1].text AS text FROM e WHERE parts[j + 1] IS NOT NULL
    """,
    "p6_rounds": FILES + """, e AS (SELECT source_file, i, unnest(range(len(q.result.metadata."toolCallRounds"))) AS j, q.result.metadata."toolCallRounds" AS rounds FROM r)
        SELECT DISTINCT source_file, [i] AS places, CAST(j AS INTEGER) AS pos FROM e WHERE rounds[j + 1] IS NOT NULL
    """,
    "p6_calls": FILES + """, e AS (SELECT source_file, i, unnest(range(len(q.result.metadata."toolCallRounds"))) AS j, q.result.metadata."toolCallRounds" AS rounds FROM r),
        c AS (SELECT source_file, i, CAST(j AS INTEGER) AS j, unnest(range(len(rounds[j + 1]."toolCalls"))) AS k, rounds[j + 1]."toolCalls" AS calls FROM e)
        SELECT DISTINCT source_file, [i, j] AS places, CAST(k AS INTEGER) AS pos, calls[k + 1].name AS name FROM c WHERE calls[k + 1] IS NOT NULL
    """,
    "p6_responses": """
        WITH files AS (SELECT DISTINCT source_file, requests FROM vscode_chats),
        reqs AS (SELECT source_file, unnest(range(len(requests))) AS i, requests FROM files),
        elements AS (SELECT source_file, i, requests[i + 1].response AS response, unnest(range(len(requests[i + 1].response))) AS j FROM reqs)
        SELECT DISTINCT source_file, [CAST(i AS INTEGER)] AS places, CAST(j AS INTEGER) AS pos, response[j + 1].kind AS kind,
               response[j + 1].value AS value, response[j + 1].content.value AS content_value, response[j + 1].toolId AS "toolId"
        FROM elements WHERE response[j + 1] IS NOT NULL
    """,
}
