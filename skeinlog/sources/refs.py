"""References to records and pages as opaque tokens: a prefix and JSON in URL-safe base 64."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.sources.sinks import shown_path

RECORD, PAGE = "rec1.", "page1."


class RefError(ValueError):
    """A token that is none."""


def _token(prefix: str, body: Column) -> Column:
    return F.concat(F.lit(prefix), F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\n\r", "-_"), F.lit("=")))


def _sorted_json(parts: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(parts.items())]), {"ignoreNullFields": "false"})


def source_fingerprint(home: str) -> Column:
    """SHA-256 over the canonical JSON of a source: its names, path as shown and kind of path."""
    return F.sha2(_sorted_json({"kind": F.lit("find"), "agent": F.col("agent"), "store": F.col("store"), "adapter_id": F.col("adapter_id"), "path": shown_path(F.col("path"), home), "path_kind": F.col("path_kind")}), 256)


def with_refs(rows: DataFrame, kind: str, fingerprint: Column, home: str, out: str = "ref") -> DataFrame:
    """``rows`` with an opaque reference (``kind`` is search or find); the home directory does not show in it."""
    body = _sorted_json({"v": F.lit(1), "kind": F.lit(kind), "adapter_id": F.col("adapter_id"), "path": shown_path(F.col("path"), home), "fingerprint": fingerprint})
    return rows.withColumn(out, _token(RECORD, body))


@dataclass(frozen=True)
class Ref:
    """What a reference says."""

    kind: str
    adapter_id: str
    path: str
    fingerprint: str


@dataclass(frozen=True)
class Page:
    """Where a listing goes on."""

    offset: int
    pattern: str | None
    agent: str
    limit: int


def _read(prefix: str, token: str) -> dict:
    if not isinstance(token, str) or not token.startswith(prefix):
        raise RefError("not such a token")
    body = token[len(prefix) :]
    try:
        said = json.loads(base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_", validate=True))
    except (ValueError, binascii.Error):
        raise RefError("the token is damaged") from None
    if not isinstance(said, dict) or said.get("v") != 1:
        raise RefError("the token is of another version")
    return said


def read_ref(token: str, home: str) -> Ref:
    """The reference in a token, its path below ``home``; raises RefError for anything else."""
    said = _read(RECORD, token)
    if said.get("kind") not in ("search", "find") or not all(isinstance(said.get(k), str) and said[k] for k in ("adapter_id", "path", "fingerprint")):
        raise RefError("the token lacks a part")
    path = said["path"]
    path = home.rstrip("/") + path[1:] if path == "~" or path.startswith("~/") else path
    if not path.startswith("/") or "/../" in f"{path}/":
        raise RefError("the token names no whole path")
    return Ref(said["kind"], said["adapter_id"], path, said["fingerprint"])


def resolve_ref(records: DataFrame, ref: Ref, fingerprint: Column) -> DataFrame:
    """The records that a reference means: by adapter and path first, which prune, then by fingerprint."""
    return records.where((F.col("adapter_id") == ref.adapter_id) & (F.col("path") == ref.path) & (fingerprint == ref.fingerprint))


def page_token(page: Page) -> str:
    """A token for the next page."""
    body = json.dumps({"v": 1, "tool": "find", "offset": page.offset, "pattern": page.pattern, "agent": page.agent, "limit": page.limit}, sort_keys=True).encode()
    return PAGE + base64.urlsafe_b64encode(body).decode().rstrip("=")


def read_page(token: str, agents: list[str]) -> Page:
    """The page in a token; raises RefError for anything else."""
    said = _read(PAGE, token)
    offset, pattern, agent, limit = (said.get(k) for k in ("offset", "pattern", "agent", "limit"))
    whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
    if said.get("tool") != "find" or not whole(offset, 0) or not whole(limit, 1) or not (pattern is None or isinstance(pattern, str)) or agent not in (*agents, "all"):
        raise RefError("the token lacks a part")
    return Page(offset, pattern, agent, limit)
