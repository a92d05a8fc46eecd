"""Where a source comes from: directories written into names, addresses of workspaces, and versions of the writing program."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most parts of a name and most directories looked at for one name; fixed values.
PARTS, PROBES = 32, 512


def from_address(name: Column) -> Column:
    """The directory in a name in which an address is escaped; null for what is no path."""
    plain = F.trim(F.try_url_decode(name))
    return F.when(plain.contains("/") | plain.startswith("~"), plain)


def workspace_path(uri: Column) -> Column:
    """The path that ``file:`` and ``vscode-remote:`` addresses mean; null for others."""
    path = F.regexp_extract(uri, r"^(?:file|vscode-remote)://[^/]*(/.*)$", 1)
    return F.when(path != "", F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def from_dashes(name: str, exists: Callable[[str], bool] = os.path.isdir) -> str | None:
    """The one existing directory whose separators became the dashes of a name; None where there is none or more than one.

    Works from the root on: ``ways`` holds, for each part of the name, the existing directories that end before it.
    """
    parts = name.removeprefix("-").split("-")
    if len(parts) > PARTS:
        return None
    ways: list[list[str]] = [["/"], *([] for _ in parts)]
    probes = 0
    for begin in range(len(parts)):
        for end in range(begin + 1, len(parts) + 1):
            step = "-".join(parts[begin:end])
            for base in ways[begin] if step else ():
                probes += 1
                if probes > PROBES:
                    return None
                path = os.path.join(base, step)
                if exists(path):
                    ways[end].append(path)
    return ways[-1][0] if len(ways[-1]) == 1 else None


def versions(lines: DataFrame, path: str, order: str, raw: str) -> DataFrame:
    """``path, version, method, confidence``: the version of the program that wrote each file.

    Written into the first line that has one it is certain; else the shape of the lines tells the format only;
    else nothing does. One row per file; nothing but the lines' heads is shuffled.
    """
    v = F.try_parse_json(F.col(raw))
    at = lambda p: F.try_variant_get(v, p, "string")
    written = F.coalesce(at("$.payload.cli_version"), at("$.version"), at("$.cli_version"), at("$.appVersion"))
    shape = F.when(at("$.payload").isNotNull(), "envelope").when(at("$.message").isNotNull(), "message").when(at("$.role").isNotNull(), "role").when(v.isNotNull(), "object")
    heads = lines.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(order).alias("o"), written.alias("version"), shape.alias("shape"))
    first = heads.groupBy("path").agg(F.min_by("version", F.when(F.col("version").isNotNull(), F.struct("o", "version"))).alias("version"), F.min_by("shape", F.when(F.col("shape").isNotNull(), F.struct("o", "shape"))).alias("shape"))
    method = F.when(F.col("version").isNotNull(), "embedded_metadata").when(F.col("shape").isNotNull(), "shape_inference").otherwise("unknown")
    return first.select("path", F.coalesce("version", "shape").alias("version"), method.alias("method"), F.when(F.col("version").isNotNull(), "high").when(F.col("shape").isNotNull(), "medium").otherwise("low").alias("confidence"))
