"""Sinks: records as lines of JSON, and grep results as events."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators.ordered import running


def shown_path(path: Column, home: str) -> Column:
    """The path with the home directory as ``~``."""
    return F.when(path == home, F.lit("~")).when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substr(path, F.lit(len(home.rstrip("/")) + 1)))).otherwise(path)


def payload(records: DataFrame, home: str) -> DataFrame:
    """``value``: each record as one JSON object, without engine columns and nulls, with the home directory hidden."""
    names = [c for c in records.columns if not c.startswith("_") and c != "store_role"]
    return records.select(F.to_json(F.struct(*[(shown_path(F.col(c), home) if c == "path" else F.col(c)).alias(c) for c in names])).alias("value"))


def write_lines(records: DataFrame, path: str, home: str) -> None:
    """Writes records as lines of JSON."""
    payload(records, home).write.text(path)


def grep_events(lines: DataFrame, key: list[str], pattern: str | None = None) -> DataFrame:
    """``key, place, event``: begin, match and end events of each record's matching lines, in order of ``key`` and ``place``.

    With the ``pattern`` of the JVM, matches list the pieces of the line that it matches, with their first and last place.
    """
    pieces = submatches(F.col("line"), pattern) if pattern else F.array().cast("array<struct<match:string,start:int,end:int>>")
    found = lines.select(*key, F.col("line_number").cast("bigint").alias("place"), "line_number", "line", pieces.alias("submatches"))
    match = found.select(*key, "place", F.to_json(F.struct(F.lit("match").alias("type"), "line_number", "line", "submatches")).alias("event"))
    each = found.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.size("submatches")).alias("pieces"))
    begin = each.select(*key, F.lit(0).cast("bigint").alias("place"), F.to_json(F.struct(F.lit("begin").alias("type"), *key)).alias("event"))
    end = each.select(*key, F.lit(1 << 62).cast("bigint").alias("place"), F.to_json(F.struct(F.lit("end").alias("type"), F.col("n").alias("matched_lines"), F.col("pieces").alias("matches"))).alias("event"))
    return begin.unionByName(match).unionByName(end)


def submatches(line: Column, pattern: str) -> Column:
    """The pieces of a line that a pattern of the JVM matches, without empty ones, with first place and the one behind the last.

    Each piece is looked for behind the one before it, so the places are those of the matches in order.
    """
    found = F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda m: m != "")
    start = F.struct(F.array().cast("array<struct<match:string,start:int,end:int>>").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, m: Column) -> Column:
        first = F.call_function("locate", m, line, state["at"])
        piece = F.struct(m.alias("match"), (first - 1).alias("start"), (first - 1 + F.char_length(m)).alias("end"))
        return F.struct(F.concat(state["out"], F.array(piece)).alias("out"), (first + F.char_length(m)).alias("at"))

    return F.aggregate(found, start, step, lambda state: state["out"])


def envelope(command: str, asked: dict, records: DataFrame, home: str, summary: dict | None = None) -> str:
    """One JSON object with the command, the query and all results; for results of a bounded request, as all of them are in it."""
    body = {"schema_version": "1", "command": command, "query": asked, "results": [json.loads(r["value"]) for r in payload(records, home).toLocalIterator()]}
    return json.dumps(body if summary is None else body | {"summary": summary}, ensure_ascii=False)


def fitting(rows: DataFrame, order: list[str], most: int, value: str = "value") -> DataFrame:
    """The longest beginning of ``rows``, in ``order``, whose values together have at most so many bytes."""
    sized = running(rows.withColumn("__bytes", F.octet_length(value).cast("bigint")), [], [*order, value], "__sum", "__bytes")
    return sized.where(F.col("__sum") <= most).drop("__bytes", "__sum")
