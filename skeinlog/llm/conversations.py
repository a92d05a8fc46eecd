"""Rebuilding conversations from message rows (problem 5).

Messages are sessionized by their session, those without one by their channel, parted at inactivity gaps whose
length is calibrated on all gaps (``split_by_gaps``). They are put in order along the tree of answers and given
roles; sessions that are broken, empty or unanswered are dropped. ``reciprocal`` drops parts of channels in which
nobody asks or nobody replies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators.hierarchy import SLOT_ROWS, gather_above, resolve
from skeinlog.operators.ordered import previous, running
from skeinlog.runtime import cut

#: Other names of roles; fixed values.
ROLES = {"ai": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "human": "user", "user": "user", "system": "system"}
TURNS = "session_id string, turn int, uuid string, role string"


def infer_role(role: Column, kind: Column) -> Column:
    """user, assistant or system: of the written role whatever its case, else of the line's type, else system."""
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(role))), F.element_at(names, F.lower(F.trim(kind))), F.lit("system"))


def _preorder(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of whole sessions: a node, then all below it, siblings by time and id."""
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).to_pydict()
    n = len(rows["uuid"])
    index = {u: k for k, u in enumerate(rows["uuid"])}
    late = 1 << 62
    order = sorted(range(n), key=lambda k: (rows["at"][k] if rows["at"][k] is not None else late, rows["uuid"][k]))
    below: dict[int, list[int]] = {}
    tops: dict[str, list[int]] = {}
    for k in order:
        parent = index.get(rows["parent"][k])
        if parent is None or rows["session_id"][parent] != rows["session_id"][k]:
            tops.setdefault(rows["session_id"][k], []).append(k)
        else:
            below.setdefault(parent, []).append(k)
    sequence, turns = [], []
    for heads in tops.values():
        stack, turn = heads[::-1], 0
        while stack:
            k = stack.pop()
            turn += 1
            sequence.append(k)
            turns.append(turn)
            stack.extend(reversed(below.get(k, ())))
    table = pa.table({
        "session_id": [rows["session_id"][k] for k in sequence], "turn": pa.array(turns, pa.int32()),
        "uuid": [rows["uuid"][k] for k in sequence], "role": [rows["role"][k] for k in sequence],
    })
    yield from table.cast(pa.schema([("session_id", pa.string()), ("turn", pa.int32()), ("uuid", pa.string()), ("role", pa.string())])).to_batches(max_chunksize=65_536)


def _large(rows: DataFrame) -> DataFrame:
    """The same order for sessions of any size, without a task that holds one.

    A row's place is the list of (-depth, rank) of its ancestors that are not the first of their siblings,
    followed by its depth; these lists compare as the order of the tree.
    """
    other = rows.select(F.col("uuid").alias("__up"), F.col("session_id").alias("__in"))
    linked = cut(rows.join(other, (F.col("parent") == F.col("__up")) & (F.col("session_id") == F.col("__in")), "left").select("session_id", "uuid", "role", "at", F.col("__up").alias("above")))
    ranked = running(linked.withColumn("__late", F.coalesce("at", F.lit(1 << 62))), ["session_id", "above"], ["__late", "uuid"], "rank")
    depth = resolve(linked.select(F.col("uuid").alias("node"), F.col("above").alias("parent"))).select("node", "depth")
    step = F.when(F.col("rank") > 1, F.array(F.struct((-F.col("depth")).alias("d"), F.col("rank").alias("r")))).otherwise(F.expr("cast(array() as array<struct<d:int,r:bigint>>)"))
    keyed = ranked.join(depth, F.col("uuid") == F.col("node")).withColumn("steps", step).select("node", "above", "depth", "session_id", "role", "steps")
    listed = gather_above(keyed, "steps")
    return running(listed, ["session_id"], ["steps", "depth", "node"], "turn").select("session_id", F.col("turn").cast("int").alias("turn"), F.col("node").alias("uuid"), "role")


def with_sessions(rows: DataFrame) -> DataFrame:
    """``rows`` with a session for messages that have none: the part of their channel between inactivity gaps.

    Messages without a session, a channel or an instant are left out. The new ids are the channel, ``#`` and
    the number of the part.
    """
    known = rows.where("session_id is not null")
    lost = rows.where("session_id is null and channel is not null and at is not null")
    if lost.isEmpty():
        return known
    parted = split_by_gaps(lost, "channel", "at", "uuid")
    return known.unionByName(parted.withColumn("session_id", F.concat("channel", F.lit("#"), F.col("part").cast("string"))).drop("part"))


def conversations(messages: DataFrame, session_rows: int = SLOT_ROWS) -> DataFrame:
    """``session_id, turn, uuid, role``: the messages of every kept conversation in order.

    ``messages`` has ``session_id, uuid, parent, role, at, has_text`` (``at`` in microseconds) and may have ``channel``:
    then messages without a session are sessionized by their channel's inactivity gaps. Rows without uuid, and
    without a session after that, are no messages; repeated rows count once, of different rows of one uuid the
    least as a whole. A session is dropped if a message is on or leads into a ring or names a parent that is
    nowhere in the table, if it has no user message or no text, or if some user message has no assistant message
    with text directly below it. Messages without an instant come last among their siblings. Sessions of over
    ``session_rows`` messages are put in order by a way that needs no task to hold one.
    """
    fields = ["session_id", "parent", "role", "at", "has_text", *(["channel"] if "channel" in messages.columns else [])]
    rows = cut(messages.where("uuid is not null").groupBy("uuid").agg(F.min(F.struct(*fields)).alias("said")).select("uuid", "said.*"))
    rows = cut(with_sessions(rows)) if "channel" in fields else rows.where("session_id is not null")
    placed = resolve(rows.select(F.col("uuid").alias("node"), "parent", F.col("session_id").alias("locality")))
    state = placed.select("node", "depth", (F.col("root") == F.col("node")).alias("is_root"))
    answered = rows.where("role = 'assistant' and has_text and parent is not null").select(F.col("parent").alias("asked")).distinct()
    judged = rows.join(state, F.col("uuid") == F.col("node")).join(answered, F.col("uuid") == F.col("asked"), "left")
    broken = (F.col("depth") < 0) | ((F.col("depth") == 0) & F.col("is_root") & F.col("parent").isNotNull()) | ((F.col("role") == "user") & F.col("asked").isNull())
    kept = judged.groupBy("session_id").agg(
        F.max(broken).alias("broken"), F.max(F.col("role") == "user").alias("asks"), F.max("has_text").alias("says"), F.count("*").alias("size")
    ).where("not broken and asks and says")
    good = cut(rows.join(kept.select("session_id", "size"), "session_id"))
    small = good.where(F.col("size") <= session_rows).repartition("session_id").select("session_id", "uuid", "parent", "role", "at").mapInArrow(_preorder, TURNS)
    large = good.where(F.col("size") > session_rows)
    return small if large.isEmpty() else small.unionByName(_large(large.drop("size")))


def calibrated_gap(gaps: DataFrame, gap: str, bins: int = 96) -> float:
    """The length in microseconds that best parts short from long gaps: Otsu's threshold on their logarithms.

    A histogram of ``bins`` bins over all gaps is all that reaches the driver. Without two filled bins nothing
    is parted (infinity).
    """
    place = F.least(F.floor(F.log2(F.greatest(F.col(gap), F.lit(1)).cast("double")) * 2), F.lit(bins - 1)).cast("int")
    found = gaps.where(F.col(gap).isNotNull()).groupBy(place.alias("b")).count().collect()
    weight = np.zeros(bins)
    for r in found:
        weight[r["b"]] = r["count"]
    if (weight > 0).sum() < 2:
        return math.inf
    total, at = weight.sum(), np.arange(bins)
    left = np.cumsum(weight)[:-1]
    mean = np.cumsum(weight * at)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        between = left * right * (mean[:-1] / left - (mean[-1] - mean[:-1]) / right) ** 2
    return float(2 ** ((int(np.nanargmax(between)) + 1) / 2))


def reciprocal(rows: DataFrame, keys: list[str], role: str = "role") -> DataFrame:
    """The rows of those groups in which both a user and an assistant speak; null keys form groups of their own."""
    heard = rows.groupBy(*keys).agg(F.max(F.col(role) == "user").alias("asks"), F.max(F.col(role) == "assistant").alias("replies")).where("asks and replies")
    other = heard.select(*[F.col(k).alias(f"__{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(other, cond, "left_semi")


def split_by_gaps(rows: DataFrame, channel: str, at: str, key: str, gap_us: float | None = None) -> DataFrame:
    """``rows`` with ``part``: the number of the conversation within its channel, from 1.

    A new one starts after an inactivity gap of ``gap_us`` or more, by default one calibrated on all gaps. Rows
    without an instant have no part. Channels may be of any size.
    """
    timed = rows.where(F.col(at).isNotNull())
    stamped = timed.withColumn("__stamp", F.struct(F.col(at).alias("t"), F.col(key).alias("k")))
    behind = cut(previous(stamped, [channel], [at, key], "__stamp", "__before").withColumn("__gap", F.col(at) - F.col("__before.t")).drop("__stamp", "__before"))
    limit = gap_us if gap_us is not None else calibrated_gap(behind, "__gap")
    starts = behind.withColumn("__new", (F.col("__gap").isNull() | (F.col("__gap") >= F.lit(limit))).cast("int"))
    out = running(starts, [channel], [at, key], "part", "__new").withColumn("part", F.col("part").cast("int")).drop("__gap", "__new")
    return out.unionByName(rows.where(F.col(at).isNull()).withColumn("part", F.lit(None).cast("int")))
