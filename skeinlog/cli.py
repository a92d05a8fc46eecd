"""Command line: ``python -m skeinlog.cli search|grep|find ...`` over the stores of a home directory.

Answers in lines of text, lines of JSON or one JSON object; ends with 0 where something was found, 1 where nothing
was, 2 where the request makes no sense. Results stream from the cluster and are never gathered on the driver, but
for ``--json``, which is one object.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators import display
from skeinlog.operators import search as S
from skeinlog.plans import planning
from skeinlog.plans.query import QueryError, Request
from skeinlog.sources import sinks
from skeinlog.sources.readers import read_home
from skeinlog.sources.stores import STORES, discover

AGENTS = sorted({s.agent for s in STORES})


def parser() -> argparse.ArgumentParser:
    """The arguments of all verbs."""
    top = argparse.ArgumentParser(prog="skeinlog", description=__doc__.splitlines()[0])
    top.add_argument("--home", default=str(Path.home()))
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str) -> argparse.ArgumentParser:
        own = verbs.add_parser(name, help=about)
        own.add_argument("--agent", action="append", choices=AGENTS, help="only this agent; may be given several times")
        own.add_argument("--limit", type=_positive)
        form = own.add_mutually_exclusive_group()
        form.add_argument("--json", action="store_true", help="one JSON object")
        form.add_argument("--ndjson", action="store_true", help="one JSON object a line")
        return own

    for name in ("search", "grep"):
        own = verb(name, "records that satisfy a query" if name == "search" else "lines that match patterns")
        own.add_argument("words", nargs="+")
        own.add_argument("--scope", choices=["prompts", "conversations", "all"], default="prompts" if name == "grep" else "all")
        own.add_argument("--all-stores", action="store_true", help="also stores that are searched on demand only")
    search = verbs.choices["search"]
    search.add_argument("--effort", choices=planning.EFFORT_ORDER)
    search.add_argument("--conversations", type=_positive)
    search.add_argument("--order", choices=["newest", "relevance", "scan"], default="newest")
    search.add_argument("--any", action="store_true", help="any word is enough")
    search.add_argument("--no-dedupe", action="store_true")
    grep = verbs.choices["grep"]
    grep.add_argument("-F", "--fixed", action="store_true")
    grep.add_argument("-w", "--word", action="store_true")
    grep.add_argument("-v", "--invert", action="store_true")
    case = grep.add_mutually_exclusive_group()
    case.add_argument("-i", "--ignore-case", dest="case", action="store_const", const="ignore")
    case.add_argument("-s", "--case-sensitive", dest="case", action="store_const", const="respect")
    shown = grep.add_mutually_exclusive_group()
    shown.add_argument("-c", "--count", action="store_true")
    shown.add_argument("-l", "--files", action="store_true")
    shown.add_argument("-o", "--only-matching", action="store_true")
    grep.add_argument("-n", "--line-number", action="store_true")
    grep.add_argument("--column", action="store_true")
    find = verb("find", "files of stores")
    find.add_argument("pattern", nargs="?")
    how = find.add_mutually_exclusive_group()
    for flag in ("glob", "regex", "exact"):
        how.add_argument(f"--{flag}", dest="how", action="store_const", const=flag)
    find.add_argument("--type", choices=["history_file", "session_file", "sqlite_db"])
    find.add_argument("--extension", action="append")
    find.add_argument("-0", "--null", action="store_true", help="a zero byte behind each path")
    return top


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("at least 1")
    return value


def _texts(rows: DataFrame, column: str) -> Iterator[str]:
    for row in rows.select(column).toLocalIterator():
        yield row[0]


def run_search(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """Lines of a search's answer; a JSON object ends with the summary of the run."""
    request = Request(" ".join(args.words), scope=args.scope, effort=args.effort, any_term=args.any, order=args.order, limit=args.limit, dedupe=not args.no_dedupe).resolved()
    records = read_home(spark, args.home, args.agent, not args.all_stores)
    found = S.search(records, request, args.conversations)
    if args.json:
        asked = {"text": request.text, "scope": request.scope, "effort": request.effort, "order": request.order, "limit": request.limit}
        body = json.loads(sinks.envelope("search", asked, found, args.home))
        n = len(body["results"])
        end = planning.summary(request, planning.Coverage(records=n, matches=n), n, limit_reached=args.limit is not None and n == args.limit)
        yield json.dumps(body | {"summary": end.payload()}, ensure_ascii=False)
    elif args.ndjson:
        yield from _texts(sinks.payload(found, args.home), "value")
    else:
        head = display.heading(F.col("agent"), F.coalesce("timestamp", F.lit("")), sinks.shown_path(F.col("path"), args.home))
        yield from _texts(found.select(F.concat(head, F.lit("\n"), display.bounded_lines(F.col("text"), 5), F.lit("\n")).alias("shown")), "shown")


def run_grep(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """Lines of a grep's answer, file by file and record by record."""
    from skeinlog.plans.lower import in_scope

    records = read_home(spark, args.home, args.agent, not args.all_stores).where(in_scope(args.scope))
    pattern = S.grep_pattern(args.words, args.fixed, args.word, args.case or "smart")
    key, path = ["path", "_ord"], sinks.shown_path(F.col("path"), args.home)
    if args.files:
        answer = S.files_with_matches(records, pattern).orderBy("path").select(path.alias("shown"))
    elif args.count:
        answer = S.line_counts(records, pattern, key).groupBy("path").agg(F.sum("n_lines").alias("n")).orderBy("path").select(F.concat_ws(":", path, F.col("n").cast("string")).alias("shown"))
    elif args.only_matching:
        answer = S.only_matching(records, pattern, key).orderBy(*key, "nth").select(F.concat_ws(":", path, "found").alias("shown"))
    else:
        lines = S.lines_of(records, pattern, key, args.invert)
        if args.json or args.ndjson:
            answer = sinks.grep_events(lines, key, None if args.invert else pattern).orderBy(*key, "place").select(F.col("event").alias("shown"))
        else:
            column = F.get(sinks.submatches(F.col("line"), pattern), F.lit(0))["start"] + 1 if args.column else None
            answer = lines.orderBy(*key, "line_number").select(F.concat_ws(":", path, display.grep_line(F.col("line_number"), F.col("line"), column, args.line_number)).alias("shown"))
    answer = answer if args.limit is None else answer.limit(args.limit)
    if args.json:
        yield json.dumps({"schema_version": "1", "command": "grep", "query": {"patterns": args.words, "scope": args.scope}, "results": [json.loads(t) if t.startswith("{") else t for t in _texts(answer, "shown")]}, ensure_ascii=False)
    else:
        yield from _texts(answer, "shown")


def run_find(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """Lines of a find's answer, in order of agent, store and path."""
    found = S.found_sources(discover(spark, args.home, args.agent), args.pattern, args.how or "fixed", kind=args.type, extensions=args.extension).orderBy("agent", "store", "path")
    found = found if args.limit is None else found.limit(args.limit)
    if args.json:
        yield sinks.envelope("find", {"pattern": args.pattern}, found, args.home)
    elif args.ndjson:
        yield from _texts(sinks.payload(found, args.home), "value")
    else:
        yield from _texts(found.select(sinks.shown_path(F.col("path"), args.home).alias("shown")), "shown")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:  # noqa: ANN001
    """Runs one command and gives its exit code."""
    args = parser().parse_args(argv)
    out = out or sys.stdout
    if spark is None:
        from skeinlog.runtime import session

        spark = session()
    run = {"search": run_search, "grep": run_grep, "find": run_find}[args.verb]
    end, some = "\0" if getattr(args, "null", False) else "\n", False
    try:
        for line in run(spark, args):
            some = some or not args.json or bool(json.loads(line)["results"])
            out.write(line + end)
    except FileNotFoundError:
        return 1
    except QueryError as wrong:
        sys.stderr.write(f"skeinlog: {wrong}\n")
        return 2
    return 0 if some else 1


if __name__ == "__main__":
    sys.exit(main())
