from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from skeinlog.plans import origins as O
from skeinlog.sources import projects as P
from skeinlog.sources.extract import is_digest

ORIGIN = "struct<cwd:string,repo:string,worktree:string,branch:string,remote:string,cwd_hash:string>"


def test_same_project(spark):
    rows = [("a", ("/w/p/src", None, None, "Main", None, None)), ("b", ("/w/pp", None, None, "main", None, None)), ("c", (None, "/w/p", None, "dev", None, None)), ("d", (None, None, "/w/p/", "main", None, None)), ("e", None)]
    df = spark.createDataFrame(rows, f"k string, origin {ORIGIN}")
    got = lambda **o: "".join(sorted(r["k"] for r in df.where(O.same_project(o)).collect()))
    assert got(repo="/w/p") == "acd" and got(cwd="/w/p") == "a" and got(worktree="/w/p", branch="MAIN") == "ad" and got() == "" and got(branch="m*") == "abd"


def test_source_summaries(spark):
    rows = [("in", [("/w/p/x", None, None, None, None, "h1")], ["cwd_hash", "cwd"]), ("out", [("/q", None, None, None, None, "h2")], ["cwd_hash", "cwd"]), ("open", [], ["cwd_hash"])]
    df = spark.createDataFrame(rows, f"k string, origins array<{ORIGIN}>, complete_fields array<string>")
    got = lambda **o: {r["k"]: r["m"] for r in df.select("k", O.may_hold(o).alias("m")).collect()}
    assert got(cwd="/w/p") == {"in": True, "out": False, "open": None} and got(cwd_hash="h1") == {"in": True, "out": False, "open": False}
    assert got(repo="/w/p") == {"in": True, "out": None, "open": None} and got() == {"in": True, "out": True, "open": True}


def test_filters_and_paths():
    assert [(n.name, n.value) for n in O.filters(branch="x", cwd="/a", repo=" ")] == [("cwd", "/a"), ("branch", "x")]
    with pytest.raises(ValueError):
        O.filters(host="x")
    assert O.whole_path("a/../b", "/h") == "/h/b" and O.whole_path("~/x") == os.path.expanduser("~/x") and O.whole_path("  ") is None and O.whole_path("/a*") == "/a*"


def test_directories_in_names(spark):
    there = {"/a", "/a/b-c", "/a/b", "/x", "/x/y-z", "/x/y", "/x/y/z", "/q", "/q/-r"}
    assert P.from_dashes("-a-b-c", there.__contains__) == "/a/b-c" and P.from_dashes("-x-y-z", there.__contains__) is None and P.from_dashes("-no", there.__contains__) is None
    assert P.from_dashes("-q--r", there.__contains__) == "/q/-r" and P.from_dashes("-".join(["a"] * 40), there.__contains__) is None
    df = spark.createDataFrame([("%2Fa%2Fb", "file:///c%20d", "0" * 32), ("plain", "vscode-remote://wsl+u/e/f+g", "X" * 32), (None, "http://x/y", None)], "n string, u string, h string")
    assert [tuple(r) for r in df.select(P.from_address(F.col("n")), P.workspace_path(F.col("u")), is_digest(F.col("h"))).collect()] == [("/a/b", "/c d", True), (None, "/e/f+g", False), (None, None, False)]


def test_versions(spark):
    df = spark.createDataFrame([("f", 2, '{"version": "2"}'), ("f", 1, '{"payload": {"cli_version": "1"}}'), ("g", 1, '{"role": "user"}'), ("h", 1, "cut"), (None, 1, "{}")], "p string, n int, raw string")
    assert {r["path"]: (r["version"], r["method"]) for r in P.versions(df, "p", "n", "raw").collect()} == {"f": ("1", "embedded_metadata"), "g": ("role", "shape_inference"), "h": (None, "unknown")}
