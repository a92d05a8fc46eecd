"""Search over normalized records: match, deduplicate, order, rank, group, and work line by line.

Records have ``kind, agent, store, adapter_id, path, text, title, role, timestamp, model, session_id,
conversation_id, origin, store_role``; ``_ord`` is their place in scan order. All of it are plain DataFrame
operations; only relevance runs in Python, over Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions.text import java_regex, literal_regex, smart_case
from skeinlog.operators.display import usable
from skeinlog.operators.ordered import carried
from skeinlog.operators.relevance import weighted_ratio
from skeinlog.plans import lower, planning
from skeinlog.plans.query import Request, terms

IDENTITY = ("kind", "agent", "store")


def newest_first() -> list[Column]:
    """Order by written time as text, agent and path, each descending; missing times last, then scan order."""
    return [F.coalesce("timestamp", F.lit("")).desc(), F.col("agent").desc(), F.col("path").desc(), F.col("_ord").asc()]


def _terms(request: Request) -> list[str]:
    return request.text.split()


def matched(records: DataFrame, request: Request) -> DataFrame:
    """Records in scope that satisfy the request: a compiled query decides alone; else all (or any) terms.

    Terms are folded substrings over five fields, or only the text where ``text_only``; regular expressions are
    searched in the joined surface. A request without terms keeps every record in scope.
    """
    ready = request.resolved() if request.tree is None else request
    kept = records.where(lower.in_scope(ready.scope))
    if ready.tree is not None:
        return kept.where(lower.records(ready.tree, ready.case_sensitive))
    words = [ready.text] if ready.regex and ready.text else _terms(ready)
    if not words:
        return kept
    if ready.regex:
        surface = F.col("text") if ready.text_only else F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "text", "model", "role", "path")])
        tests = [F.coalesce(surface.rlike(java_regex(w, ready.case_sensitive)), F.lit(False)) for w in words]
    else:
        tests = [lower.term(w, ready.case_sensitive, ("text",) if ready.text_only else lower.SURFACE) for w in words]
    keep = tests[0]
    for t in tests[1:]:
        keep = (keep | t) if ready.any_term else (keep & t)
    return kept.where(keep)


def deduplicated(records: DataFrame, order: str = "newest") -> DataFrame:
    """One record per kind, agent, store, session (or conversation, or path) and text.

    The newest copy survives, in scan order the first one. Texts are compared by their digest, so that they
    are not sorted; a text held by very many rows is reduced map-side before its rows meet.
    """
    session = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("session_id", "conversation_id")], F.col("path"))
    keyed = records.withColumn("__session", session).withColumn("__digest", F.sha2("text", 256))
    by = [F.col("_ord").asc()] if order == "scan" else newest_first()
    rank = F.row_number().over(Window.partitionBy(*IDENTITY, "__session", "__digest").orderBy(*by))
    return keyed.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__session", "__digest")


def relevance(records: DataFrame, query: str, threshold: float = 0.0, boost: Column | None = None) -> DataFrame:
    """Records with ``score``: weighted ratio of query and text (0 to 100), those under ``threshold`` dropped.

    ``boost`` adds 10 where it holds, after the threshold. An empty query scores 0.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: weighted_ratio(query, t or ""))

    out = records.withColumn("score", score("text") if query else F.lit(0.0))
    if threshold > 0:
        out = out.where(F.col("score") >= threshold)
    return out if boost is None else out.withColumn("score", F.col("score") + F.when(boost, 10.0).otherwise(0.0))


def search(records: DataFrame, request: Request, conversations: int | None = None) -> DataFrame:
    """The whole search: open what the effort asks for, match, deduplicate, order, limit. A limit is the feature asked for: a top-k report.

    With a column ``is_authority``, rows of other stores that repeat a text of an authority's session or path are
    left out, except in scan order. Effort needs ``store_role``; without it every record is open.
    """
    opened = planning.planned(records, request, matched, routed, conversations) if "store_role" in records.columns else records
    found = matched(opened, request)
    if "is_authority" in records.columns and request.order != "scan":
        sure = F.coalesce("is_authority", F.lit(False))
        found = found.where(sure).unionByName(without_authority(found.where(~sure), found.where(sure)))
    if request.dedupe:
        found = deduplicated(found, request.order)
    if request.order == "relevance":
        ready = request.resolved()
        words = terms(ready.tree) if ready.tree is not None else _terms(ready)
        found = relevance(found, " ".join(words))
        ordered = found.orderBy(F.col("score").desc(), *newest_first())
    elif request.order == "scan":
        ordered = found.orderBy("_ord")
    else:
        ordered = found.orderBy(*newest_first())
    return ordered if request.limit is None else ordered.limit(request.limit)


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page with ``has_more``: whether another row follows it."""
    ahead = rows.orderBy(*order).offset(offset).limit(size + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    return ahead.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > size).where(F.col("__n") <= size).drop("__n")


def sessions(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """``session_id, first_rank, n_records`` of ranked rows; rows without session are one group."""
    return ranked.groupBy("session_id").agg(F.min(rank).alias("first_rank"), F.count("*").alias("n_records"))


def grep_pattern(patterns: list[str], fixed: bool = False, word: bool = False, case: str = "smart") -> str:
    """One pattern of the JVM for grep: escaped where fixed, bounded where word, case by the patterns where smart.

    What is no pattern is left out; without any the result matches nothing.
    """
    parts = [literal_regex(p) for p in patterns] if fixed else usable(patterns)
    if not parts:
        return "(?!)"
    parts = [rf"\b(?:{p})\b" if word else f"(?:{p})" for p in parts]
    return java_regex("|".join(parts), case == "respect" or (case == "smart" and smart_case(patterns)))


def lines_of(records: DataFrame, pattern: str, key: list[str], invert: bool = False) -> DataFrame:
    """``key, line_number, line`` of each line that the pattern matches (or does not), numbered from 1."""
    lines = records.select(*key, F.posexplode(F.split("text", "\n")).alias("__at", "line"))
    test = F.col("line").rlike(pattern)
    return lines.where(~test if invert else test).select(*key, (F.col("__at") + 1).alias("line_number"), "line")


def line_counts(records: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """``key, n_lines``: how many lines of each record match, records without any left out."""
    n = F.size(F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern)))
    return records.select(*key, n.cast("bigint").alias("n_lines")).where("n_lines > 0")


def only_matching(records: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """``key, nth, found``: each piece of text that matches, in order, without empty ones."""
    rows = records.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("__at", "found"))
    return rows.where("found <> ''").select(*key, (F.col("__at") + 1).alias("nth"), "found")


SPANS = "array<struct<first:int,last:int>>"


def spans(records: DataFrame, patterns: list[str], key: list[str], text: str = "text") -> DataFrame:
    """``key, first, last``: merged stretches (last is past the end) that any pattern matches; empty ones do not count."""
    compiled = [re.compile(p) for p in patterns]

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = sorted((m.start(), m.end()) for p in compiled for m in p.finditer(t or "") if m.end() > m.start())
            merged: list[list[int]] = []
            for a, b in raw:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append([{"first": a, "last": b} for a, b in merged])
        return pd.Series(out)

    return records.select(*key, F.explode(find(text)).alias("s")).select(*key, "s.first", "s.last")


def snippet(text: Column, pattern: str, most: int = 5) -> Column:
    """``struct(snippet, remaining)``: up to ``most`` lines from the one before the first match on."""
    lines = F.split(text, "\n")
    total = F.size(lines)
    at = F.array_position(F.transform(lines, lambda line: line.rlike(pattern)), True)
    start = F.when(at == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(at - 1, total - most + 1)))
    cut = F.array_join(F.slice(lines, start.cast("int"), most), "\n")
    return F.when(total <= most, F.struct(text.alias("snippet"), F.lit(0).alias("remaining"))).otherwise(F.struct(cut.alias("snippet"), (total - most).alias("remaining")))


def fingerprint(records: DataFrame, out: str = "fingerprint", home: str = "/home/u") -> DataFrame:
    """Records with a SHA-256 over their canonical JSON: keys sorted, text by its own digest, home as ``~``."""
    shown = F.when(F.col("path") == home, F.lit("~")).when(F.col("path").startswith(home + "/"), F.concat(F.lit("~"), F.expr(f"substring(path, {len(home) + 1})"))).otherwise(F.col("path"))
    parts = {
        "adapter_id": F.col("adapter_id"), "agent": F.col("agent"), "conversation_id": F.col("conversation_id"), "kind": F.lit("search"), "path": shown, "record_kind": F.col("kind"),
        "role": F.col("role"), "session_id": F.col("session_id"), "store": F.col("store"), "text_sha256": F.sha2("text", 256), "timestamp": F.col("timestamp"),
    }
    return records.withColumn(out, F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(parts.items())]), {"ignoreNullFields": "false"}), 256))


def without_authority(rows: DataFrame, authority: DataFrame) -> DataFrame:
    """Rows whose text the authority does not hold under the same path or the same session (an anti-join on either key)."""
    def keys(df: DataFrame) -> Column:
        return F.array(
            F.struct(F.lit("p").alias("k"), F.col("path").alias("v")), F.struct(F.lit("s").alias("k"), F.coalesce("session_id", F.concat(F.lit("\0"), F.col("path"))).alias("v")))

    have = authority.select(F.explode(keys(authority)).alias("x"), F.sha2("text", 256).alias("d")).select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), "d").distinct()
    marked = rows.withColumn("__row", F.struct("_ord", "path")).withColumn("__d", F.sha2("text", 256))
    hit = marked.select("__row", F.explode(keys(marked)).alias("x"), "__d").join(have, (F.col("x.k") == F.col("k")) & (F.col("x.v") == F.col("v")) & (F.col("__d") == F.col("d"))).select(F.col("__row").alias("__hit"))
    return marked.join(hit, F.col("__row") == F.col("__hit"), "left_anti").drop("__row", "__d")


def routed(evidence: DataFrame, records: DataFrame, most: int = 25) -> DataFrame:
    """Records of the ``most`` conversations with the newest evidence (a semi-join behind a top-k of keys)."""
    keys = evidence.where("session_id is not null").groupBy("session_id").agg(F.max(F.coalesce("timestamp", F.lit(""))).alias("at")).orderBy(F.col("at").desc(), F.col("session_id").desc()).limit(most)
    # At most ``most`` keys are broadcast.
    return records.join(F.broadcast(keys.select("session_id")), "session_id", "left_semi")


def filled_from_header(rows: DataFrame, group: str, order: str, column: str, out: str) -> DataFrame:
    """Rows with the last value of ``column`` that is not null at or before them within their file."""
    return carried(rows, [group], [order], column, out)


def found_sources(sources: DataFrame, pattern: str | None = None, how: str = "fixed", case: str = "smart", kind: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Sources whose path (or, where exact, adapter id) fits: fixed substring, glob over name or path, or regular expression.

    A pattern that is no regular expression fits nothing.
    """
    from skeinlog.functions.text import glob_regex

    out = sources
    if pattern:
        sensitive = case == "respect" or (case == "smart" and smart_case([pattern]))
        path = F.col("path") if sensitive else F.lower("path")
        needle = pattern if sensitive else pattern.lower()
        if how == "exact":
            keep = F.col("adapter_id") == pattern
        elif how == "fixed":
            keep = F.contains(path, F.lit(needle))
        elif how == "glob":
            keep = path.rlike(glob_regex(needle)) | F.regexp_extract(path, r"([^/]*)$", 1).rlike(glob_regex(needle))
        else:
            try:
                keep = F.col("path").rlike(java_regex(pattern, sensitive))
            except re.error:
                keep = F.lit(False)
        out = out.where(keep)
    if kind:
        out = out.where(F.col("path_kind") == kind)
    if extensions:
        out = out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return out


def enumerated(sources: DataFrame, text: str | None) -> DataFrame:
    """Sources whose agent, store, adapter, path or kind of path contains a text, case aside; blank keeps all."""
    if not text or not text.strip():
        return sources
    return sources.where(F.contains(F.lower(F.concat_ws(" ", "agent", "store", "adapter_id", "path", "path_kind")), F.lit(text.strip().lower())))


def agent_counts(records: DataFrame) -> DataFrame:
    """``agent, n``: records of each agent."""
    return records.groupBy("agent").agg(F.count("*").alias("n"))


def files_with_matches(records: DataFrame, pattern: str) -> DataFrame:
    """``path`` of each file in which some line matches, once."""
    return records.where(F.exists(F.split("text", "\n"), lambda line: line.rlike(pattern))).select("path").distinct()


def recent(sources: DataFrame, since_ns: int, most: int) -> DataFrame:
    """The newest sources since a time, at most so many: the limit is the report's. Ties go by path."""
    return sources.where(F.col("mtime_ns") >= since_ns).orderBy(F.col("mtime_ns").desc(), "path").limit(most)


def discovery_summary(sources: DataFrame) -> DataFrame:
    """``dimension, value, n``: number of sources in all, by agent, kind of source and kind of path, in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.lit("") if c is None else F.col(c)).alias("value")) for d, c in (("total", None), ("agent", "agent"), ("source_kind", "source_kind"), ("path_kind", "path_kind"))])
    return sources.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
