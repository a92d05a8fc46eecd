"""Order-dependent columns over groups of any size.

A window puts each group in one task. Here rows are range-partitioned by group and order, so that a group
holding a third of all rows is split over many tasks; only the ends or sums of the pieces are carried over,
at most one small row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.runtime import cut


def _pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned, with its partition number in ``__piece`` pinned by a lineage cut."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return cut(ranged.withColumn("__piece", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, keys: list[str]):  # noqa: ANN202
    cond = left["__piece"] == right["__at"]
    for c in keys:
        cond = cond & left[c].eqNullSafe(right[f"__{c}"])
    return cond


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before, in ``order``, within equal ``keys``; null for the first.

    Null keys form one group; ties are broken by ``value``. An empty table stays empty.
    """
    rows = _pieces(df, keys, [*order, value])
    near = rows.withColumn("__near", F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("__piece", *keys).orderBy(*order, value)))
    ends = rows.groupBy("__piece", *keys).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__end"))
    carried = ends.withColumn("__far", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__piece"))).where("__far is not null").select(
        F.col("__piece").alias("__at"), *[F.col(c).alias(f"__{c}") for c in keys], F.struct(F.col("__far.__v").alias("v")).alias("__far")
    )
    # At most one row per piece has something carried over to it.
    joined = near.join(F.broadcast(carried), _same(near, carried, keys), "left")
    return joined.withColumn(out, F.coalesce("__near", "__far")["v"]).drop("__near", "__far", "__at", "__piece", *[f"__{c}" for c in keys])


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last ``value`` that is not null at or before the row, in ``order``, within equal ``keys``.

    Null keys form one group; rows that tie in ``order`` are put in some order. An empty table stays empty.
    """
    rows = _pieces(df, keys, order)
    span = Window.partitionBy("__piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(span))
    ends = rows.groupBy("__piece", *keys).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__v")))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.withColumn("__far", F.last("__end", ignorenulls=True).over(before)).where("__far is not null").select(
        F.col("__piece").alias("__at"), *[F.col(c).alias(f"__{c}") for c in keys], F.struct(F.col("__far.__v").alias("v")).alias("__far"))
    # At most one row per piece has something carried over to it.
    joined = near.join(F.broadcast(far), _same(near, far, keys), "left")
    return joined.withColumn(out, F.coalesce("__near", "__far")["v"]).drop("__near", "__far", "__at", "__piece", *[f"__{c}" for c in keys])


def running(df: DataFrame, keys: list[str], order: list[str], out: str, value: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to and with the row, or without ``value`` its number from 1.

    Rows that tie in ``order`` are put in some order, so ``order`` should be unique within ``keys``. Null values
    count as 0.
    """
    amount = F.lit(1).cast("bigint") if value is None else F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    rows = _pieces(df.withColumn("__amount", amount), keys, order)
    span = Window.partitionBy("__piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.sum("__amount").over(span))
    sums = rows.groupBy("__piece", *keys).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__far", F.sum("__sum").over(before)).where("__far is not null").select(
        F.col("__piece").alias("__at"), *[F.col(c).alias(f"__{c}") for c in keys], "__far"
    )
    joined = near.join(F.broadcast(carried), _same(near, carried, keys), "left")
    return joined.withColumn(out, F.col("__near") + F.coalesce("__far", F.lit(0))).drop("__near", "__far", "__at", "__piece", "__amount", *[f"__{c}" for c in keys])
