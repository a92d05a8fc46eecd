"""Search queries over records made from the whole documents table, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators import display as D
from skeinlog.operators import search as S
from skeinlog.plans import lower, planning
from skeinlog.plans.query import Request, parse
from skeinlog.runtime import table

KEY = ["doc_id"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a text as a record."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    agent = F.split("source", r"\.")[0]
    number = F.col("doc_id")
    stamp = F.when(F.col("role").isNotNull(), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return d.select(
        "doc_id", number.alias("_ord"), F.when(F.col("role") == "user", "prompt").otherwise("history").alias("kind"), agent.alias("agent"), F.col("source").alias("store"),
        F.concat("source", F.lit(".v1")).alias("adapter_id"), F.concat(F.lit("/home/u/."), agent, F.lit("/"), F.coalesce("conversation_id", F.lit("none")), F.lit(".jsonl")).alias("path"),
        "text", F.lit(None).cast("string").alias("title"), "role", stamp.alias("timestamp"), F.when(F.col("role") == "assistant", F.concat(F.lit("gpt-"), (number % 4).cast("string"))).alias("model"),
        F.col("conversation_id").alias("session_id"), "conversation_id",
        F.struct(
            F.concat(F.lit("/work/proj"), (number % 7).cast("string"), F.when(number % 3 == 0, "/src").otherwise("")).alias("cwd"), F.concat(F.lit("/work/proj"), (number % 7).cast("string")).alias("repo"),
            F.lit(None).cast("string").alias("worktree"), F.when(number % 3 == 0, "main").when(number % 3 == 1, "dev").alias("branch"), F.lit(None).cast("string").alias("cwd_hash")).alias("origin"),
        F.when(F.col("source").like("%history%"), "prompt_history").otherwise("primary_chat").alias("store_role"),
    )


#: The same records for SQL; ``f_`` columns are folded.
VIEW = """
WITH r AS (
  SELECT doc_id, CASE WHEN role = 'user' THEN 'prompt' ELSE 'history' END AS kind, split_part(source, '.', 1) AS agent, source AS store, source || '.v1' AS adapter_id,
    '/home/u/.' || split_part(source, '.', 1) || '/' || coalesce(conversation_id, 'none') || '.jsonl' AS path, text, role,
    CASE WHEN role IS NOT NULL THEN strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%dT%H:%M:%SZ') END AS ts,
    CASE WHEN role = 'assistant' THEN 'gpt-' || (doc_id % 4) END AS model, conversation_id AS session_id,
    '/work/proj' || (doc_id % 7) || CASE WHEN doc_id % 3 = 0 THEN '/src' ELSE '' END AS cwd, '/work/proj' || (doc_id % 7) AS repo,
    CASE doc_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' END AS branch,
    CASE WHEN source LIKE '%history%' THEN 'prompt_history' ELSE 'primary_chat' END AS store_role
  FROM documents WHERE text IS NOT NULL),
v AS (SELECT *, concat_ws(chr(1), fold(text), coalesce(fold(role), ''), coalesce(fold(model), ''), fold(path)) AS surface FROM r)
""".replace("fold(text)", "replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')").replace("fold(role)", "lower(role)").replace("fold(model)", "lower(model)").replace("fold(path)", "lower(path)")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _filter(name: str, query: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).where(lower.records(parse(query))).select("doc_id", "agent", "kind")

    QUERIES[name] = run
    SQL[name] = f"{VIEW} SELECT doc_id, agent, kind FROM v WHERE {where}"


def _t(word: str) -> str:
    return f"contains(surface, '{word}')"


_STAMP = "try_cast(ts AS TIMESTAMP)"
for _name, _query, _where in [
    ("q_term", "cache", _t("cache")), ("q_terms_and", "cache retry", f"{_t('cache')} AND {_t('retry')}"), ("q_or", "cache OR tokenizer", f"{_t('cache')} OR {_t('tokenizer')}"),
    ("q_phrase", '"ignore   list matches"', _t("ignore list matches")), ("q_not", "NOT cache", f"NOT {_t('cache')}"), ("q_folded", "STRASSE OR Schlüssel", f"{_t('strasse')} OR {_t('schlüssel')}"),
    ("q_nested", "(cache OR parser) -(docker AND role:user)", f"({_t('cache')} OR {_t('parser')}) AND NOT ({_t('docker')} AND coalesce(role LIKE '%user%', false))"),
    ("q_not_missing_time", "NOT timestamp:>2025-06-01", f"NOT coalesce({_STAMP} > TIMESTAMP '2025-06-01', false)"), ("q_agent", "agent:codex", "agent = 'codex'"),
    ("q_store_part", "store:sessions", "contains(store, 'sessions')"), ("q_adapter_glob", "adapter:*.sessions.v?", "regexp_matches(adapter_id, '^.*\\.sessions\\.v.$')"),
    ("q_path_part", "path:/.codex/", "contains(path, '/.codex/')"), ("q_path_glob", "path:/home/*/.gem*", "regexp_matches(path, '^/home/.*/\\.gem.*$')"), ("q_kind", "kind:prompt", "kind = 'prompt'"),
    ("q_scope_prompts", "scope:prompts", "kind = 'prompt'"), ("q_scope_conversations", "scope:conversations", "store_role IN ('primary_chat', 'supplementary_chat')"),
    ("q_role", "role:assist", "coalesce(contains(role, 'assist'), false)"), ("q_model_glob", "model:gpt*", "coalesce(regexp_matches(model, '^gpt.*$'), false)"),
    ("q_model_exists", "model:*", "coalesce(length(model) > 0, false)"), ("q_model_absent", "-model:*", "NOT coalesce(length(model) > 0, false)"),
    ("q_time_after", "timestamp:>2025-06-01", f"{_STAMP} > TIMESTAMP '2025-06-01'"), ("q_time_until", "timestamp:<=2025-06-01T12:00:00Z", f"{_STAMP} <= TIMESTAMP '2025-06-01 12:00:00'"),
    ("q_time_day", "timestamp:2025-06-03", f"{_STAMP} >= TIMESTAMP '2025-06-03' AND {_STAMP} < TIMESTAMP '2025-06-04'"), ("q_time_month", "date:2025-12", f"{_STAMP} >= TIMESTAMP '2025-12-01' AND {_STAMP} < TIMESTAMP '2026-01-01'"),
    ("q_time_year", "timestamp:2025", f"{_STAMP} >= TIMESTAMP '2025-01-01' AND {_STAMP} < TIMESTAMP '2026-01-01'"), ("q_time_range", "timestamp:[2025-03 TO 2025-04-15]", f"{_STAMP} >= TIMESTAMP '2025-03-01' AND {_STAMP} <= TIMESTAMP '2025-04-15'"),
    ("q_time_open", "timestamp:{2025-11-01 TO *}", f"{_STAMP} > TIMESTAMP '2025-11-01'"), ("q_cwd", "cwd:/work/proj3", "(cwd = '/work/proj3' OR starts_with(cwd, '/work/proj3/'))"),
    ("q_cwd_glob", "cwd:*proj2*src", "regexp_matches(cwd, '^.*proj2.*src$')"), ("q_repo", "repo:/work", "starts_with(repo, '/work/')"), ("q_branch", "branch:MAIN", "coalesce(branch = 'main', false)"),
    ("q_project", "project:proj5", "regexp_extract(repo, '([^/]+)/*$', 1) = 'proj5' OR regexp_extract(cwd, '([^/]+)/*$', 1) = 'proj5'"), ("q_mtime_record", "mtime:>2025-01-01 OR agent:grok", "agent = 'grok'"),
]:
    _filter(_name, _query, _where)


def _add(name: str, sql: str | None = None):  # noqa: ANN202
    def put(run):  # noqa: ANN001, ANN202
        QUERIES[name] = run
        if sql:
            SQL[name] = VIEW + sql
        return run

    return put


@_add("q_any_term", f"SELECT doc_id FROM v WHERE {_t('docker')} OR {_t('gradle')}")
def q_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matched(records(spark, sf_dir), Request("docker gradle", any_term=True)).select("doc_id")


@_add("q_case_sensitive", "SELECT doc_id FROM v WHERE contains(text, 'The')")
def q_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matched(records(spark, sf_dir), Request("The", case_sensitive=True, text_only=True)).select("doc_id")


@_add("q_grep_regex", "SELECT doc_id FROM v WHERE regexp_matches(text, 'line [0-9]+: [a-z_]+')")
def q_grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matched(records(spark, sf_dir), Request("line [0-9]+: [a-z_]+", regex=True, case_sensitive=True, text_only=True)).select("doc_id")


@_add("q_grep_word", "SELECT doc_id FROM v WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}\\p{M}_])cache($|[^\\p{L}\\p{N}\\p{M}_])', 'i')")
def q_grep_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(F.col("text").rlike(S.grep_pattern(["cache"], word=True))).select("doc_id")


@_add("q_grep_fixed", "SELECT doc_id FROM v WHERE contains(text, 'src/loader.py')")
def q_grep_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(F.col("text").rlike(S.grep_pattern(["src/loader.py"], fixed=True, case="respect"))).select("doc_id")


@_add("q_match_lines", """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM v)
SELECT doc_id, CAST(n AS INTEGER) AS line_number, line FROM l WHERE contains(line, 'retry')""")
def q_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines_of(records(spark, sf_dir), S.grep_pattern(["retry"], case="respect"), KEY)


@_add("q_line_counts", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))) AS BIGINT) AS n_lines FROM v WHERE contains(text, 'the')")
def q_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_counts(records(spark, sf_dir), S.grep_pattern(["the"], case="respect"), KEY)


@_add("q_only_matching", """, m AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+/[a-z]+\\.py') AS f FROM v)
SELECT doc_id, CAST(unnest(range(1, len(f) + 1)) AS INTEGER) AS nth, unnest(f) AS found FROM m""")
def q_only_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only_matching(records(spark, sf_dir), r"[a-z]+/[a-z]+\.py", KEY)


@_add("q_files_with_matches", "SELECT DISTINCT path FROM v WHERE contains(text, 'segfault')")
def q_files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files_with_matches(records(spark, sf_dir), S.grep_pattern(["segfault"], case="respect"))


@_add("q_spans", """, h AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM v WHERE regexp_matches(text, 'lock file|file lo|cache')),
m AS (SELECT doc_id, p AS first, p + CASE WHEN substr(text, p, 9) = 'lock file' THEN 9 WHEN substr(text, p, 7) = 'file lo' THEN 7 ELSE 5 END AS last FROM h
  WHERE substr(text, p, 9) = 'lock file' OR substr(text, p, 7) = 'file lo' OR substr(text, p, 5) = 'cache'),
g AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, CAST(min(first) - 1 AS INTEGER) AS first, CAST(max(last) - 1 AS INTEGER) AS last FROM n GROUP BY doc_id, k""")
def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spans(records(spark, sf_dir), ["lock file", "file lo", "cache"], KEY)


@_add("q_snippet", """, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM v WHERE contains(text, 'docker')),
p AS (SELECT *, len(x) AS n, list_position(list_transform(x, lambda y: contains(y, 'docker')), true) AS hit FROM l)
SELECT doc_id, CASE WHEN n <= 5 THEN text ELSE array_to_string(x[greatest(1, least(hit - 1, n - 4)):greatest(1, least(hit - 1, n - 4)) + 4], chr(10)) END AS snippet,
CAST(CASE WHEN n <= 5 THEN 0 ELSE n - 5 END AS INTEGER) AS remaining FROM p""")
def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where(F.contains("text", F.lit("docker")))
    return rows.select("doc_id", S.snippet(F.col("text"), "docker").alias("s")).select("doc_id", "s.snippet", "s.remaining")


_KEPT = "PARTITION BY kind, agent, store, coalesce(nullif(session_id, ''), path), text ORDER BY"
_NEW = "coalesce(ts, '') DESC, agent DESC, path DESC, doc_id"


@_add("q_dedupe_newest", f", d AS (SELECT *, row_number() OVER ({_KEPT} {_NEW}) AS k FROM v) SELECT doc_id, ts FROM d WHERE k = 1")
def q_dedupe_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicated(records(spark, sf_dir)).select("doc_id", F.col("timestamp").alias("ts"))


@_add("q_dedupe_first", f", d AS (SELECT *, row_number() OVER ({_KEPT} doc_id) AS k FROM v) SELECT doc_id FROM d WHERE k = 1")
def q_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicated(records(spark, sf_dir), "scan").select("doc_id")


@_add("q_newest_topk", f", d AS (SELECT *, row_number() OVER ({_KEPT} {_NEW}) AS k FROM v WHERE {_t('cache')} AND agent = 'codex') SELECT doc_id, ts FROM d WHERE k = 1 ORDER BY {_NEW} LIMIT 20")
def q_newest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twenty newest matches of a query, each once."""
    return S.search(records(spark, sf_dir), Request("agent:codex cache", limit=20)).select("doc_id", F.col("timestamp").alias("ts"))


@_add("q_scan_topk", f", d AS (SELECT *, row_number() OVER ({_KEPT} doc_id) AS k FROM v WHERE {_t('parser')}) SELECT doc_id FROM d WHERE k = 1 ORDER BY doc_id LIMIT 50")
def q_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(records(spark, sf_dir), Request("parser", order="scan", limit=50)).select("doc_id")


@_add("q_page", f"SELECT doc_id, true AS has_more FROM v WHERE {_t('cache')} ORDER BY doc_id LIMIT 20 OFFSET 20")
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(S.matched(records(spark, sf_dir), Request("cache")).select("doc_id"), [F.col("doc_id")], 20, 20)


@_add("q_relevance_topk")
def q_relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(records(spark, sf_dir), Request("retry loop", order="relevance", limit=50)).select("doc_id", "score")


@_add("q_group_sessions", f", d AS (SELECT session_id, row_number() OVER (ORDER BY {_NEW}) AS rank FROM v WHERE {_t('tokenizer')}) SELECT session_id, CAST(min(rank) AS BIGINT) AS first_rank, count(*) AS n_records FROM d GROUP BY session_id")
def q_group_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.operators.ordered import running

    rows = S.matched(records(spark, sf_dir), Request("tokenizer")).select("session_id", F.coalesce("timestamp", F.lit("")).alias("t"), "agent", "path", "doc_id")
    # Descending text order is ascending order of the reversed rank, so rank from the end.
    n = rows.count()
    up = running(rows.withColumn("back", -F.col("doc_id")), [], ["t", "agent", "path", "back"], "up")
    return S.sessions(up.withColumn("rank", F.lit(n).cast("bigint") + 1 - F.col("up")))


@_add("q_agent_counts", "SELECT agent, count(*) AS n FROM v GROUP BY agent")
def q_agent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.agent_counts(records(spark, sf_dir))


@_add("q_authority", ", a AS (SELECT * FROM v WHERE agent = 'codex'), b AS (SELECT * FROM v WHERE agent <> 'codex') SELECT doc_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.text = b.text AND (a.path = b.path OR a.session_id = b.session_id))")
def q_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return S.without_authority(rows.where("agent <> 'codex'"), rows.where("agent = 'codex'")).select("doc_id")


@_add("q_routed", f", e AS (SELECT session_id, max(coalesce(ts, '')) AS newest FROM v WHERE kind = 'prompt' AND session_id IS NOT NULL AND {_t('cache')} GROUP BY 1 ORDER BY newest DESC, session_id DESC LIMIT 25) SELECT doc_id FROM v WHERE session_id IN (SELECT session_id FROM e)")
def q_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return S.routed(S.matched(rows, Request("cache", scope="prompts")), rows).select("doc_id")


@_add("q_header_fill", "SELECT doc_id, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS last_model FROM v")
def q_header_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filled_from_header(records(spark, sf_dir), "session_id", "doc_id", "model", "last_model").select("doc_id", "last_model")


@_add("q_set_union", f"SELECT path FROM v WHERE {_t('deadlock')} UNION SELECT path FROM v WHERE {_t('segfault')}")
def q_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return S.matched(rows, Request("deadlock")).select("path").union(S.matched(rows, Request("segfault")).select("path")).distinct()


@_add("q_set_intersect", f"SELECT path FROM v WHERE {_t('deadlock')} INTERSECT SELECT path FROM v WHERE {_t('segfault')}")
def q_set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return S.matched(rows, Request("deadlock")).select("path").intersect(S.matched(rows, Request("segfault")).select("path"))


@_add("q_content_format", """, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM v),
t AS (SELECT *, list_filter(list_zip(x[:-2], x[2:]), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL) AS pairs,
  CASE WHEN regexp_matches(text, '^\\s*[\\[{]') AND json_valid(text) THEN 1 ELSE 0 END AS braced FROM l)
SELECT doc_id, CASE WHEN text = '' THEN 'text' WHEN braced = 1 THEN 'json' WHEN
  len(list_filter(x, lambda y: regexp_matches(y, '^#{1,6} \\S') OR starts_with(y, '```') OR regexp_matches(y, '\\*\\*[^\\s*][^*]*\\*\\*') OR regexp_matches(y, '^ *>[\\t ]\\S') OR regexp_matches(y, '\\[[^\\]]+\\]\\([^)]+\\)'))) > 0
  OR len(list_filter(pairs, lambda p: (regexp_matches(p[1], '^[\\t ]*[*+-] \\S') AND regexp_matches(p[2], '^[\\t ]*[*+-] \\S')) OR (regexp_matches(p[1], '^[\\t ]*[0-9]+\\. \\S') AND regexp_matches(p[2], '^[\\t ]*[0-9]+\\. \\S'))
    OR (regexp_matches(p[1], '^ *\\|.+\\|') AND regexp_matches(p[2], '^ *\\|?[\\s|:-]*--')))) > 0
  THEN 'markdown' ELSE 'text' END AS format FROM t""")
def q_content_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", D.content_format(F.col("text")).alias("format"))


@_add("q_code", """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS y FROM v)
SELECT doc_id, bool_or(regexp_matches(y, '[{};] *$') OR regexp_matches(y, '^\\s*#(include|define|pragma)\\b') OR regexp_matches(y, '^[\\t ]*(import|from) [\\w.]+')
  OR regexp_matches(y, '^[\\t ]*(def|class|func|fn|struct|enum|trait|impl|public|private|protected|static) +\\w') OR regexp_matches(y, '^[\\t ]*(function|const|let|var) +\\w+\\s*[=(]')
  OR regexp_matches(y, '^[\\t ]*(package|namespace|module|use) +[\\w:.]+')) AS code FROM l GROUP BY doc_id""")
def q_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", D.looks_like_code(F.col("text")).alias("code"))


@_add("q_first_match_line", """, l AS (SELECT doc_id, list_position(list_transform(string_split(text, chr(10)), lambda y: contains(y, 'cache') OR contains(y, 'retry')), true) AS n FROM v)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS at FROM l WHERE n > 0""")
def q_first_match_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", D.first_match_line(F.col("text"), ["cache", "retry"]).alias("at")).where("at is not null")


@_add("q_bounded_lines", """, l AS (SELECT doc_id, text, string_split(substr(text, 1, 200), chr(10)) AS x FROM v)
SELECT doc_id, CASE WHEN length(text) > 200 THEN array_to_string(x[:3], chr(10)) || chr(10) || '… (more content)' WHEN len(x) > 3 THEN array_to_string(x[:3], chr(10)) || chr(10) || '… (+' || (len(x) - 3) || ' more lines)' ELSE text END AS shown FROM l""")
def q_bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", D.bounded_lines(F.col("text"), 3, 200).alias("shown"))


@_add("q_highlight", "SELECT doc_id, regexp_replace(text, '(cache|retry)', '<<\\1>>', 'g') AS shown FROM v WHERE regexp_matches(text, 'cache|retry')")
def q_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where(F.col("text").rlike("cache|retry"))
    return rows.select("doc_id", D.highlighted(F.col("text"), ["cache", "retry"]).alias("shown"))


@_add("q_log_time", "SELECT doc_id, CASE WHEN ts IS NULL THEN '' ELSE replace(substr(ts, 1, 16), 'T', ' ') || ' +0000' END AS shown FROM v")
def q_log_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", D.log_time(F.col("timestamp")).alias("shown"))


@_add("q_no_dedupe", f"SELECT doc_id FROM v WHERE {_t('tokenizer')}")
def q_no_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(records(spark, sf_dir), Request("tokenizer", dedupe=False)).select("doc_id")


@_add("q_grep_smartcase", "SELECT doc_id, 'lower' AS pattern FROM v WHERE contains(lower(text), 'error') UNION ALL SELECT doc_id, 'upper' FROM v WHERE contains(text, 'Error')")
def q_grep_smartcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    hit = lambda word, name: rows.where(F.col("text").rlike(S.grep_pattern([word]))).select("doc_id", F.lit(name).alias("pattern"))
    return hit("error", "lower").unionAll(hit("Error", "upper"))


@_add("q_effort_prompt", f", d AS (SELECT *, row_number() OVER ({_KEPT} {_NEW}) AS k FROM v WHERE {_t('cache')} AND kind = 'prompt' AND store_role = 'prompt_history') SELECT doc_id FROM d WHERE k = 1")
def q_effort_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(records(spark, sf_dir), Request("cache", scope="prompts")).select("doc_id")


@_add("q_targeted", f""", e AS (SELECT session_id, max(coalesce(ts, '')) AS newest FROM v WHERE (store_role = 'prompt_history' OR kind = 'prompt') AND session_id IS NOT NULL AND {_t('cache')} GROUP BY session_id),
c AS (SELECT session_id FROM e ORDER BY newest DESC, session_id DESC LIMIT 25),
o AS (SELECT * FROM v WHERE store_role = 'prompt_history' OR session_id IN (SELECT session_id FROM c)),
d AS (SELECT *, row_number() OVER ({_KEPT} {_NEW}) AS k FROM o WHERE {_t('cache')}) SELECT doc_id FROM d WHERE k = 1""")
def q_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(records(spark, sf_dir), Request("cache", effort="targeted")).select("doc_id")


@_add("q_submatches", """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM v),
h AS (SELECT doc_id, n, line, unnest(range(1, length(line) + 1)) AS p FROM l WHERE contains(line, 'retry'))
SELECT doc_id, CAST(n AS INTEGER) AS line_number, CAST(p - 1 AS INTEGER) AS first, CAST(p + 4 AS INTEGER) AS last FROM h WHERE substr(line, p, 5) = 'retry'""")
def q_submatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.sources.sinks import submatches

    pattern = S.grep_pattern(["retry"], case="respect")
    lines = S.lines_of(records(spark, sf_dir), pattern, KEY)
    return lines.select("doc_id", "line_number", F.explode(submatches(F.col("line"), pattern)).alias("m")).select("doc_id", "line_number", F.col("m.start").alias("first"), F.col("m.end").alias("last"))


@_add("q_fingerprint", """SELECT doc_id, sha256('{"adapter_id":' || to_json(adapter_id) || ',"agent":' || to_json(agent) || ',"conversation_id":' || coalesce(to_json(session_id), 'null') || ',"kind":"search","path":'
  || to_json('~' || substr(path, 8)) || ',"record_kind":"' || kind || '","role":' || coalesce(to_json(role), 'null') || ',"session_id":' || coalesce(to_json(session_id), 'null') || ',"store":' || to_json(store)
  || ',"text_sha256":"' || sha256(text) || '","timestamp":' || coalesce(to_json(ts), 'null') || '}') AS fingerprint FROM v""")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fingerprint(records(spark, sf_dir)).select("doc_id", "fingerprint")


@_add("q_text_digest", "SELECT doc_id, sha256(text) AS digest FROM v")
def q_text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per saved file of vscode_chats and transcript file of cursor_lines."""
    chats = table(spark, sf_dir, "vscode_chats").where("source_file is not null").groupBy(F.col("source_file").alias("path")).agg((F.max("lastMessageDate") * 1_000_000).alias("mtime_ns"))
    lines = table(spark, sf_dir, "cursor_lines").where("source_file is not null").groupBy(F.col("source_file").alias("path")).agg(F.lit(0).cast("bigint").alias("mtime_ns"))
    named = lambda df, agent, store, kind: df.select(F.lit(agent).alias("agent"), F.lit(store).alias("store"), F.lit(f"{store}.v1").alias("adapter_id"), "path", F.lit("session_file").alias("path_kind"), F.lit(kind).alias("source_kind"), "mtime_ns")
    return named(chats, "vscode", "vscode.chat_sessions", "json").unionByName(named(lines, "cursor-cli", "cursor-cli.transcripts", "jsonl"))


SOURCES = """
WITH s AS (
  SELECT 'vscode' AS agent, 'vscode.chat_sessions' AS store, 'vscode.chat_sessions.v1' AS adapter_id, source_file AS path, 'session_file' AS path_kind, 'json' AS source_kind, max(lastMessageDate) * 1000000 AS mtime_ns FROM vscode_chats WHERE source_file IS NOT NULL GROUP BY source_file
  UNION ALL SELECT 'cursor-cli', 'cursor-cli.transcripts', 'cursor-cli.transcripts.v1', source_file, 'session_file', 'jsonl', 0 FROM cursor_lines WHERE source_file IS NOT NULL GROUP BY source_file)
"""


def _source(name: str, keep, sql: str) -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, sf_dir: keep(sources(spark, sf_dir)).select("agent", "path")
    SQL[name] = f"{SOURCES} SELECT agent, path FROM s WHERE {sql}"


_source("q_find_fixed", lambda s: S.found_sources(s, "ab"), "contains(lower(path), 'ab')")
_source("q_find_glob", lambda s: S.found_sources(s, "a*.json*", "glob"), "regexp_matches(path, '^a.*\\.json.*$') OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^a.*\\.json.*$')")
_source("q_find_regex", lambda s: S.found_sources(s, r"/[0-9a-f]{8}-0", "regex"), "regexp_matches(path, '/[0-9a-f]{8}-0')")
_source("q_find_bad_regex", lambda s: S.found_sources(s, "(", "regex"), "false")
_source("q_find_exact", lambda s: S.found_sources(s, "vscode.chat_sessions.v1", "exact"), "adapter_id = 'vscode.chat_sessions.v1'")
_source("q_find_type", lambda s: S.found_sources(s, kind="session_file"), "path_kind = 'session_file'")
_source("q_find_extension", lambda s: S.found_sources(s, extensions=["JSONL"]), "path LIKE '%.jsonl'")
_source("q_find_text", lambda s: S.enumerated(s, " Cursor "), "contains(lower(concat_ws(' ', agent, store, adapter_id, path, path_kind)), 'cursor')")
_source("q_source_mtime", lambda s: s.where(lower.may_hold(parse("mtime:>2025-06-01 cache"))), "coalesce(mtime_ns > 0 AND make_timestamp(mtime_ns // 1000) > TIMESTAMP '2025-06-01', false)")
_source("q_source_prune", lambda s: s.where(lower.may_hold(parse("agent:vscode (model:x OR path:zz)"))), "agent = 'vscode'")


def q_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.discovery_summary(sources(spark, sf_dir))


QUERIES["q_discovery"] = q_discovery
SQL["q_discovery"] = SOURCES + """SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM s UNION ALL SELECT 'agent', agent, count(*) FROM s GROUP BY agent
UNION ALL SELECT 'source_kind', source_kind, count(*) FROM s GROUP BY source_kind UNION ALL SELECT 'path_kind', path_kind, count(*) FROM s GROUP BY path_kind"""


def q_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest sources; the limit is the report's."""
    return S.recent(sources(spark, sf_dir), 1, 50).select("path", "mtime_ns")


QUERIES["q_recent"] = q_recent
SQL["q_recent"] = SOURCES + "SELECT path, mtime_ns FROM s WHERE mtime_ns > 0 ORDER BY mtime_ns DESC, path LIMIT 50"


def q_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their message and session, the shape of relational stores: lineitem, orders and customer."""
    item, order, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    joined = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey)
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n"))


QUERIES["q_three_way_join"] = q_three_way_join
SQL["q_three_way_join"] = "SELECT c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value inside JSON text."""
    return table(spark, sf_dir, "cursor_lines").select("line_id", F.variant_get(F.try_parse_json("raw"), "$.role", "string").alias("role")).where("role is not null").distinct()


QUERIES["q_json_props"] = q_json_props
SQL["q_json_props"] = "SELECT DISTINCT line_id, json_extract_string(raw, '$.role') AS role FROM cursor_lines WHERE json_valid(raw) AND json_extract_string(raw, '$.role') IS NOT NULL"


def q_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day of the event table."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


QUERIES["q_day_window"] = q_day_window
SQL["q_day_window"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources of each agent a search for prompts leaves at each step."""
    found = sources(spark, sf_dir).withColumn("coverage", F.when(F.col("path").like("%a%"), "default_search").otherwise("catalog_only")).withColumn("role", F.when(F.col("agent") == "vscode", "primary_chat").otherwise("prompt_history"))
    return planning.coverage_of(found, Request("cache", scope="prompts", effort="exhaustive"))


QUERIES["q_coverage"] = q_coverage
SQL["q_coverage"] = SOURCES + "SELECT agent, count(*) AS discovered, count(*) FILTER (path LIKE '%a%') AS searchable, count(*) FILTER (path LIKE '%a%') AS opened FROM s GROUP BY agent"


def q_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message anywhere inside the transcript lines."""
    from skeinlog.sources.extract import found_messages

    return found_messages(table(spark, sf_dir, "cursor_lines").where("line_id is not null").select("line_id", "raw").distinct(), "raw", ["line_id"]).drop("origin")


QUERIES["q_json_walk"] = q_json_walk


def q_left_join_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with the header of their session, where there is one: messages of a session per header."""
    header = table(spark, sf_dir, "grok_subagents").where("child_session_id is not null").groupBy(F.col("child_session_id").alias("sid")).agg(F.min("subagent_type").alias("kind"))
    prompts = table(spark, sf_dir, "grok_prompts").where("row_id is not null").select("row_id", "session_id").distinct()
    return prompts.join(header, F.col("session_id") == F.col("sid"), "left").groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES["q_left_join_summary"] = q_left_join_summary
SQL["q_left_join_summary"] = """WITH h AS (SELECT child_session_id AS sid, min(subagent_type) AS kind FROM grok_subagents WHERE child_session_id IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT row_id, session_id FROM grok_prompts WHERE row_id IS NOT NULL) SELECT coalesce(kind, 'none') AS kind, count(*) AS n FROM p LEFT JOIN h ON session_id = sid GROUP BY 1"""


@_add("q_same_project", "SELECT doc_id FROM v WHERE branch = 'main' AND (repo = '/work/proj3' OR starts_with(repo, '/work/proj3/') OR cwd = '/work/proj3' OR starts_with(cwd, '/work/proj3/'))")
def q_same_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skeinlog.plans.origins import same_project

    return records(spark, sf_dir).where(same_project({"repo": "/work/proj3", "branch": "MAIN"})).select("doc_id")


def q_source_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each session file tells of its writer."""
    from skeinlog.sources.projects import versions

    return versions(table(spark, sf_dir, "raw_lines"), "file_id", "line_no", "raw")


QUERIES["q_source_version"] = q_source_version
SQL["q_source_version"] = """WITH j AS (SELECT file_id AS path, line_no, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM raw_lines WHERE file_id IS NOT NULL),
h AS (SELECT path, line_no, coalesce(v->>'$.payload.cli_version', v->>'$.version', v->>'$.cli_version', v->>'$.appVersion') AS version,
  CASE WHEN (v->>'$.payload') IS NOT NULL THEN 'envelope' WHEN (v->>'$.message') IS NOT NULL THEN 'message' WHEN (v->>'$.role') IS NOT NULL THEN 'role' WHEN v IS NOT NULL THEN 'object' END AS shape FROM j),
f AS (SELECT path, arg_min(version, (line_no, version)) FILTER (version IS NOT NULL) AS version, arg_min(shape, (line_no, shape)) FILTER (shape IS NOT NULL) AS shape FROM h GROUP BY path)
SELECT path, coalesce(version, shape) AS version, CASE WHEN version IS NOT NULL THEN 'embedded_metadata' WHEN shape IS NOT NULL THEN 'shape_inference' ELSE 'unknown' END AS method,
  CASE WHEN version IS NOT NULL THEN 'high' WHEN shape IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM f"""
