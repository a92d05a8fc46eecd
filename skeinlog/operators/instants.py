"""Mixed timestamp formats and time zones (problem 7).

A written time becomes a local wall time in microseconds; an as-of join with the exploded zone-offset
intervals of its zone gives the offset: one matching interval gives it directly, two mean the local time
occurs twice (the first is taken), none means it was skipped (the offset before the change is taken).

The interval table has one row per zone and local year, so the as-of join is an equi-join on
``(zone, year)`` followed by a filter of at most a handful of intervals. It is made from the zone database alone,
never from the data: about 600 zones times 166 years, whatever the size of the data, which is why it is
broadcast. Years after the last one have the rules of a year of the same weekdays before it; those before the
first have its first offset.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from datetime import UTC, date, datetime
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.instants import DAY_US, MONTHS, NUMBER, days_from_civil, epoch_us, wall_parts

FIRST_YEAR, LAST_YEAR = 1900, 2065
FAR = 1 << 61
#: Where only the rule of a zone's end holds, offsets are compared at steps of so many seconds.
STEP_S = 20 * 86_400
INTERVALS = "tz string, year int, intervals array<struct<lo:bigint,hi:bigint,off:bigint,abbr:string>>"


def _zone_file(name: str) -> bytes:
    """A zone's compiled file (RFC 8536): of the system or of the tzdata package."""
    for folder in TZPATH:
        path = Path(folder) / name
        if path.is_file():
            return path.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _written_changes(data: bytes) -> tuple[list[tuple[int, int, str]], tuple[int, str], bool]:
    """The changes in a compiled file as ``(utc second, offset, letters)``, the offset before them, and whether a rule with two offsets follows."""
    head = struct.Struct(">4s c 15x 6l")
    _, version, *counts = head.unpack_from(data)
    at, size = head.size, 4
    if version >= b"2":
        isut, isstd, leap, times, types, chars = counts
        at += times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        _, _, *counts = head.unpack_from(data, at)
        at, size = at + head.size, 8
    isut, isstd, leap, times, types, chars = counts
    stamps = np.frombuffer(data, f">i{size}", times, at)
    kinds = np.frombuffer(data, np.uint8, times, at + times * size)
    at += times * (size + 1)
    infos = [struct.unpack_from(">lbB", data, at + 6 * k) for k in range(types)]
    letters = data[at + 6 * types : at + 6 * types + chars]
    named = [(off, letters[i : letters.index(b"\0", i)].decode()) for off, _, i in infos]
    footer = data[at + 6 * types + chars + leap * (size + 4) + isstd + isut :].strip(b"\n") if size == 8 else b""
    return [(int(t), *named[k]) for t, k in zip(stamps, kinds, strict=True)], named[0], b"," in footer


@functools.cache
def offset_intervals(name: str, last: int = LAST_YEAR) -> list[tuple[int, int, int, str]]:
    """``(utc start, utc end, offset, letters)`` in seconds of each stretch of one offset and letters.

    The first reaches back and the last forward without end.
    """
    changes, now, ruled = _written_changes(_zone_file(name))
    if ruled:
        zone = ZoneInfo(name)

        def at(second: int) -> tuple[int, str]:
            local = datetime.fromtimestamp(second, zone)
            return int(local.utcoffset().total_seconds()), local.tzname() or ""

        low = max(changes[-1][0] if changes else 0, 0)
        high = int(datetime(last + 1, 2, 1, tzinfo=UTC).timestamp())
        here = at(low)
        for step in range(low, high, STEP_S):
            then = at(step + STEP_S)
            if then != here:
                a, b = step, step + STEP_S
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if at(mid) == here else (a, mid)
                changes.append((b, *then))
                here = then
    found, start = [], -(FAR // 1_000_000)
    for second, off, abbr in changes:
        if (off, abbr) != now:
            if second > start:
                found.append((start, second, *now))
            start, now = max(start, second), (off, abbr)
    return [*found, (start, FAR // 1_000_000, *now)]


def _explode_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    years = range(FIRST_YEAR, LAST_YEAR + 1)
    begins = [int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (*years, LAST_YEAR + 1)]
    for batch in batches:
        zones, own, offsets, rows = [], [], [0], {"lo": [], "hi": [], "off": [], "abbr": []}
        for name in batch.column(0).to_pylist():
            try:
                spans = offset_intervals(name)
            except Exception:  # noqa: BLE001 - an unreadable zone has no intervals
                continue
            for k, year in enumerate(years):
                lo = begins[k] - 172_800 if k else -FAR
                hi = begins[k + 1] + 172_800
                for s, e, off, abbr in spans:
                    if e >= lo and s <= hi:
                        rows["lo"].append((s + off) * 1_000_000)
                        rows["hi"].append((e + off) * 1_000_000)
                        rows["off"].append(off * 1_000_000)
                        rows["abbr"].append(abbr)
                zones.append(name)
                own.append(year)
                offsets.append(len(rows["lo"]))
        values = pa.StructArray.from_arrays([pa.array(rows["lo"], pa.int64()), pa.array(rows["hi"], pa.int64()), pa.array(rows["off"], pa.int64()), pa.array(rows["abbr"], pa.string())], names=list(rows))
        yield pa.record_batch({"tz": pa.array(zones, pa.string()), "year": pa.array(own, pa.int32()), "intervals": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})


def zone_intervals(spark: SparkSession) -> DataFrame:
    """The interval table of all zones of the database."""
    names = spark.createDataFrame([(n,) for n in sorted(available_timezones())], "tz string")
    return names.repartition(8).mapInArrow(_explode_zones, INTERVALS)


def _same_weekdays(year: Column) -> Column:
    """A year among the last 28 of the table with the same weekdays as a later one."""
    table = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        table[(date(y, 1, 1).weekday(), date(y, 12, 31).weekday())] = y
    cycle = [table[(date(y, 1, 1).weekday(), date(y, 12, 31).weekday())] for y in range(2000, 2400)]
    alike = F.array(*[F.lit(y) for y in cycle])
    return F.when(year > LAST_YEAR, F.get(alike, F.pmod(year, F.lit(400)).cast("int"))).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))


def _int(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k)).try_cast("bigint")


def normalize_instants(df: DataFrame, value: str, zone: str = "tz", order: str = "date_order", out: str = "utc_us", matches: str | None = None) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC of the written time in ``value``.

    Null, blank and unusable values, dates and times that do not exist, local times without a known zone
    and slashed dates without a known order give null. Fractions finer than a microsecond are cut off.
    Bare numbers count seconds, ms, µs or ns by their digits. Letters of a zone mean that zone's offset of
    that name, else UTC or GMT. A zone named in the value (``[Europe/Paris]``) goes before ``zone``. ``matches`` names a
    column for the number of intervals that hold a time read by a zone's rules: 2 where it occurs twice, 0 where it
    was skipped, 1 otherwise; null where the value has its own offset or counts seconds, or means no instant. Rows are
    neither added nor dropped; columns called like ``out`` or ``matches`` are replaced, all others stay.
    """
    names = [c for c in df.columns if c not in (out, matches)]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    v = F.trim(F.regexp_replace(F.col(f"row.`{value}`").cast("string"), r"[ \s]+", " "))
    base = base.select("row", v.alias("v"), F.col(f"row.`{zone}`").alias("tz"), F.upper(F.trim(F.col(f"row.`{order}`"))).alias("ord"))
    p = F.col("p")
    base = base.withColumn("num", F.col("v").rlike(NUMBER)).withColumn(
        "p", F.when(F.col("num"), F.split(F.regexp_replace(F.col("v"), r"^[+-]?0*", ""), r"\.")).otherwise(wall_parts(F.col("v"), F.col("ord")))
    )
    month_name = F.lower(F.substring(F.get(p, F.lit(1)), 1, 3))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month_name)
    month = F.when(F.get(p, F.lit(1)).rlike(r"^\d+$"), _int(p, 1)).otherwise(F.when(named > 0, named))
    half = F.upper(F.get(p, F.lit(8)))
    hour = (
        F.when(half == "", _int(p, 3))
        .when((_int(p, 3) < 1) | (_int(p, 3) > 12), F.lit(None).cast("bigint"))
        .otherwise(F.pmod(_int(p, 3), F.lit(12)) + F.when(half == "PM", 12).otherwise(0))
    )
    base = base.select(
        "row", "v", "num", "tz",
        _int(p, 0).alias("y"), month.cast("bigint").alias("mo"), _int(p, 2).alias("d"), hour.alias("h"), _int(p, 4).alias("mi"),
        F.when(F.get(p, F.lit(5)) == "", F.lit(0).cast("bigint")).otherwise(_int(p, 5)).alias("s"),
        F.rpad(F.substring(F.get(p, F.lit(6)), 1, 6), 6, "0").cast("bigint").alias("us"),
        F.get(p, F.lit(7)).alias("z"), F.get(p, F.lit(9)).alias("named"),
        F.when(F.col("num"), F.get(p, F.lit(0))).alias("whole"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("rest"),
    )
    y, mo, d = F.col("y"), F.col("mo"), F.col("d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= last) & F.col("h").between(0, 23) & F.col("mi").between(0, 59) & F.col("s").between(0, 59)
    wall = days_from_civil(y, mo, d) * DAY_US + ((F.col("h") * 60 + F.col("mi")) * 60 + F.col("s")) * 1_000_000 + F.col("us")
    z = F.col("z")
    zone_parts = F.regexp_replace(z, ":", "")
    fixed = F.when(F.lower(z) == "z", F.lit(0).cast("bigint")).when(
        z.rlike(r"^[+-]"),
        F.when(z.startswith("-"), -1).otherwise(1)
        * (F.substring(zone_parts, 2, 2).try_cast("bigint") * 3600 + F.coalesce(F.substring(zone_parts, 4, 2).try_cast("bigint"), F.lit(0)) * 60)
        * 1_000_000,
    )
    base = base.select(
        "row",
        F.when(
            F.col("num"),
            epoch_us(F.coalesce(F.col("whole").try_cast("bigint"), F.lit(0).cast("bigint")), F.col("rest"), F.length("whole"), F.col("v").startswith("-")),
        ).alias("direct"),
        F.when(valid, wall.cast("bigint")).alias("wall"),
        fixed.alias("fixed"),
        F.when(z.rlike("^[A-Za-z]{2,}$"), F.upper(z)).alias("letters"),
        F.coalesce(F.when(F.col("named") != "", F.col("named")), F.col("tz")).alias("zone"),
        _same_weekdays(y).cast("int").alias("yr"), y.alias("y"),
    )
    one = F.lit(1).cast("bigint")
    shifted = F.when(F.col("y") > LAST_YEAR, (days_from_civil(F.col("y"), one, one) - days_from_civil(F.col("yr").cast("bigint"), one, one)) * DAY_US).otherwise(F.lit(0))
    base = base.withColumn("read", F.col("wall") - shifted)
    # As large as the zone database, not the data: a few megabytes.
    table = zone_intervals(df.sparkSession)
    joined = base.join(F.broadcast(table.withColumnRenamed("tz", "ztz")), (F.col("zone") == F.col("ztz")) & (F.col("yr") == F.col("year")), "left")
    w = F.col("read")
    inside = F.filter("intervals", lambda x: (w >= x["lo"]) & (w < x["hi"]))
    before = F.filter("intervals", lambda x: x["hi"] <= w)
    lettered = F.filter("intervals", lambda x: x["abbr"] == F.col("letters"))
    lettered_inside = F.filter(lettered, lambda x: (w >= x["lo"]) & (w < x["hi"]))
    local = F.when(F.size(inside) >= 1, F.get(inside, F.lit(0))["off"]).otherwise(F.get(before, F.size(before) - 1)["off"])
    by_letters = F.coalesce(
        F.get(lettered_inside, F.lit(0))["off"], F.get(lettered, F.lit(0))["off"],
        F.when(F.col("letters").isin("UTC", "GMT", "UT"), F.lit(0).cast("bigint")),
    )
    offset = F.coalesce(F.col("fixed"), F.when(F.col("letters").isNotNull(), by_letters).otherwise(local))
    result = F.coalesce(F.col("direct"), F.col("wall") - offset)
    # In two steps: a name among the row's own columns could else be taken for one used in the result.
    ruled = F.when(result.isNotNull() & F.col("direct").isNull() & F.col("fixed").isNull() & F.col("letters").isNull(), F.size(inside))
    done = joined.select("row", result.alias("__us"), ruled.alias("__n"))
    return done.select("row.*", F.col("__us").alias(out), *([F.col("__n").alias(matches)] if matches else []))
