"""Mixing sources to target weights (problem 9).

Each source has a weight schedule over training progress from 0 to 1. Integrating it gives the source's
cumulative token demand; a document's place in its source's own token sequence, put through the inverse of
that demand, is its training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.tokens import VOCABULARY, count_tokens
from skeinlog.operators.ordered import running
from skeinlog.runtime import cut

Schedule = list[tuple[float, dict[str, float]]]


def demand(supply: dict[str, int], targets: dict[str, tuple[float, int]], schedule: Schedule | None = None, total: int | None = None) -> dict[str, list[tuple[int, int, float, float]]]:
    """Inverse cumulative demand of each source: pieces ``(from token, to token, progress there, progress per token)``.

    ``targets`` has weight and most repeats of each source; ``schedule`` has phases ``(end of the phase, weights)``
    and defaults to one phase of the target weights. Weights count relative to those of the sources that have
    documents. ``total`` is the size of the mix in tokens; by default the greatest at which no source has to be
    repeated more often than it may. With a greater ``total`` a source that runs out stops early.
    """
    have = [s for s in targets if supply.get(s, 0) > 0 and targets[s][1] > 0]
    phases = schedule or [(1.0, {s: targets[s][0] for s in have})]
    begin, shares = 0.0, []
    for end, weights in phases:
        whole = sum(max(0.0, weights.get(s, 0.0)) for s in have)
        shares.append((begin, end, {s: max(0.0, weights.get(s, 0.0)) / whole if whole else 0.0 for s in have}))
        begin = end
    integral = {s: sum((end - start) * q[s] for start, end, q in shares) for s in have}
    if total is None:
        total = int(min((targets[s][1] * supply[s] / integral[s] for s in have if integral[s] > 0), default=0))
    out = {}
    for s in have:
        most, at, pieces = targets[s][1] * supply[s], 0, []
        exact = 0.0
        for start, end, q in shares:
            exact += (end - start) * q[s] * total
            upto = min(round(exact), most)
            if upto > at:
                pieces.append((at, upto, start, (end - start) / (upto - at)))
            at = max(at, upto)
        if pieces:
            out[s] = pieces
    return out


def mix(documents: DataFrame, targets: DataFrame, schedule: Schedule | None = None, total: int | None = None, seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """``position, doc_id, source, copy, n_tokens, progress``: the mix in training order.

    ``documents`` needs ``doc_id, text, source``, ``targets`` ``source, weight, max_repeats`` (a small table, one
    row per source; weights that are null or not positive count as 0). Sizes are tokens. Documents of sources
    without a target, without a source and without tokens are not part of a mix; a doc_id that occurs
    twice counts once. A document is taken once more only when its whole source has been taken as often as it.
    Which part of a source is used, where not all is, follows a hash of doc_id and ``seed``. Empty tables
    give an empty mix.
    """
    counted = cut(
        count_tokens(documents.where("doc_id is not null and source is not null").select("doc_id", "source", "text"), path=path)
        .where("n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    )
    goal = {r["source"]: (max(0.0, float(r["weight"] or 0)), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where(F.col("source").isin(*goal)).collect() if goal else []
    supply = {r["source"]: int(r["tokens"]) for r in sums}
    pieces = demand(supply, goal, schedule, total)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(s, supply[s], p[-1][1], [{"lo": a, "hi": b, "at": u, "rate": r} for a, b, u, r in p]) for s, p in pieces.items()],
        "plan_source string, supply bigint, need bigint, pieces array<struct<lo:bigint,hi:bigint,at:double,rate:double>>",
    )
    used = counted.where(F.col("source").isin(*pieces)) if pieces else counted.limit(0)
    placed = running(used.withColumn("__order", F.xxhash64("doc_id", F.lit(seed))), ["source"], ["__order", "doc_id"], "__upto", "n_tokens")
    # One row per source with a target: as small as the table of targets.
    joined = placed.join(F.broadcast(plan), F.col("source") == F.col("plan_source"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.call_function("div", F.col("need"), F.col("supply")) + 1)))
    middle = (F.col("copy") - 1) * F.col("supply") + F.col("__upto") - F.col("n_tokens") / 2
    taken = copies.withColumn("__middle", middle).where("__middle < need")
    piece = F.filter("pieces", lambda p: (F.col("__middle") >= p["lo"]) & (F.col("__middle") < p["hi"]))[0]
    timed = taken.withColumn("__piece_at", piece).select(
        "doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens",
        (F.col("__piece_at.at") + (F.col("__middle") - F.col("__piece_at.lo")) * F.col("__piece_at.rate")).alias("progress"),
    )
    return running(timed, [], ["progress", "source", "doc_id", "copy"], "position").select("position", "doc_id", "source", "copy", "n_tokens", "progress")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_documents, most_copies`` of every target.

    ``target_share`` is the weight divided by the sum of all weights; a target without documents reaches 0.
    """
    reached = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"), F.max("copy").alias("most_copies"))
    whole = reached.agg(F.sum("n_tokens").alias("__whole"))
    weights = targets.agg(F.sum("weight").alias("__weights"))
    rows = targets.join(reached, "source", "left").join(F.broadcast(whole)).join(F.broadcast(weights))  # two tables of one row each
    return rows.select(
        "source", (F.col("weight") / F.col("__weights")).alias("target_share"),
        F.coalesce(F.col("n_tokens") / F.col("__whole"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def phase_shares(mixed: DataFrame, schedule: Schedule) -> DataFrame:
    """``phase, source, planned_share, actual_share, n_tokens`` of every phase (from 1) and source of the schedule.

    Planned shares are relative to the sources that have documents in the mix. A document belongs to the phase in
    which its middle lies.
    """
    spark = mixed.sparkSession
    ends = [end for end, _ in schedule]
    phase = F.lit(len(ends))
    for k in range(len(ends) - 2, -1, -1):
        phase = F.when(F.col("progress") < ends[k], F.lit(k + 1)).otherwise(phase)
    reached = cut(mixed.groupBy(phase.alias("phase"), "source").agg(F.sum("n_tokens").alias("n_tokens")))
    plan = spark.createDataFrame([(k + 1, s, float(w)) for k, (_, weights) in enumerate(schedule) for s, w in weights.items()], "phase int, source string, weight double")
    # Both sides have one row per phase and source.
    there = plan.join(F.broadcast(reached.select("source").distinct()), "source")
    whole = there.groupBy("phase").agg(F.sum("weight").alias("whole"))
    total = reached.groupBy("phase").agg(F.sum("n_tokens").alias("total"))
    rows = there.join(F.broadcast(reached), ["phase", "source"], "left").join(F.broadcast(whole), "phase").join(F.broadcast(total), "phase", "left")
    return rows.select("phase", "source", (F.col("weight") / F.col("whole")).alias("planned_share"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
