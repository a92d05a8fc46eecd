from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from skeinlog.operators.instants import normalize_instants, offset_intervals


def us(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2025-01-02T18:22:15.906Z", "Europe/Berlin", "DMY", us(2025, 1, 2, 18, 22, 15) + 906_000),
    ("2025-02-11T23:42:57.694005345Z", "UTC", "DMY", us(2025, 2, 11, 23, 42, 57) + 694_005),
    ("1735839992", "UTC", None, us(2025, 1, 2, 17, 46, 32)), ("1735783036494750845", "UTC", None, 1_735_783_036_494_750), ("1735858656.889", "UTC", None, 1_735_858_656_889_000),
    ("1737063317353", None, None, 1_737_063_317_353_000), ("1737708657194227", None, None, 1_737_708_657_194_227), ("-5", None, None, -5_000_000), ("0", None, None, 0),
    ("02/01/2025 09:12:43 PM", "UTC", "DMY", us(2025, 1, 2, 21, 12, 43)), ("02/01/2025 12:12:43 AM", "UTC", "MDY", us(2025, 2, 1, 0, 12, 43)),
    ("01.02.2025 20:40:23", "UTC", "MDY", us(2025, 2, 1, 20, 40, 23)), ("Thu, 16 Jan 2025 01:56:13 +0100", "UTC", None, us(2025, 1, 16, 0, 56, 13)),
    ("2025-02-07T12:25:18+11:00[Australia/Sydney]", "UTC", None, us(2025, 2, 7, 1, 25, 18)), ("20250121T132818Z", None, None, us(2025, 1, 21, 13, 28, 18)), ("2025-01-16t01:18:06z", None, None, us(2025, 1, 16, 1, 18, 6)),
    ("2025-01-15 02:57:49", "America/New_York", None, us(2025, 1, 15, 7, 57, 49)), ("2025-07-15 02:57:49 CEST", "Europe/Berlin", None, us(2025, 7, 15, 0, 57, 49)),
    ("2025-01-15 02:57:49 CST", "America/Chicago", None, us(2025, 1, 15, 8, 57, 49)), ("2025-01-15 02:57:49 CST", "Asia/Shanghai", None, us(2025, 1, 14, 18, 57, 49)), ("2025-01-15 02:57:49 GMT", "Asia/Tokyo", None, us(2025, 1, 15, 2, 57, 49)),
    ("2025-10-26 02:30:00", "Europe/Berlin", None, us(2025, 10, 26, 0, 30)), ("2025-03-30 02:30:00", "Europe/Berlin", None, us(2025, 3, 30, 1, 30)),
    ("2025-03-30 02:30:00.25", "Europe/Berlin", None, us(2025, 3, 30, 1, 30) + 250_000), ("2024-02-29T00:00:00Z", None, None, us(2024, 2, 29)), ("  2025-01-02T00:00:00Z ", None, None, us(2025, 1, 2)),
    ("2025-02-30T10:00:00Z", "UTC", "DMY", None), ("2025-13-01 08:00:00", "UTC", "DMY", None), ("2025-01-01T24:00:00Z", "UTC", None, None), ("2025-01-15 02:57:49", None, None, None), ("02/01/2025 10:00:00", "UTC", None, None),
    ("13/14/2025 10:00:00", "UTC", "DMY", None), ("02/01/2025 13:00:00 PM", "UTC", "DMY", None), ("unknown", "UTC", "DMY", None), ("", "UTC", "DMY", None), (None, "UTC", "DMY", None), ("x" * 100_000, "UTC", "DMY", None),
    ("2025-07-01T12:00:00[Europe/Paris]", "UTC", None, us(2025, 7, 1, 10)), ("2075-07-01 12:00:00", "Europe/Berlin", None, us(2075, 7, 1, 10)), ("2075-12-01 12:00:00", "Europe/Berlin", None, us(2075, 12, 1, 11)), ("2103-07-01 12:00:00", "America/New_York", None, us(2103, 7, 1, 16)),
    ("1968-01-10 12:00:00", "Europe/London", None, us(1968, 1, 10, 12)), ("1969-01-10 12:00:00", "Europe/London", None, us(1969, 1, 10, 11)), ("1945-07-01 12:00:00", "Europe/Berlin", None, us(1945, 7, 1, 9)),
    ("2025-01-15 02:57:49", "No/Where", None, None), ("99999999999999999999999", "UTC", None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "wall int, value string, tz string, date_order string")
    got = {r["wall"]: r["utc_us"] for r in normalize_instants(df, "value").collect()}
    for k, case in enumerate(CASES):
        assert got[k] == case[3], case


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2025-01-02T00:00:00Z", "UTC", "DMY", 7, "a")] * 2, "value string, tz string, date_order string, utc_us int, intervals string")
    rows = normalize_instants(df, "value").collect()
    assert len(rows) == 2 and rows[0]["intervals"] == "a" and rows[0]["utc_us"] == us(2025, 1, 2)
    assert normalize_instants(df.limit(0), "value").count() == 0


def test_matches(spark):
    cases = [("2025-10-26 02:30:00", 2), ("2025-03-30 02:30:00", 0), ("2025-05-01 02:30:00", 1), ("2025-05-01T02:30:00Z", None), ("1735839992", None), ("nonsense", None), (None, None)]
    df = spark.createDataFrame([(k, v, "Europe/Berlin", None) for k, (v, _) in enumerate(cases)], "k int, value string, tz string, date_order string")
    got = {r["k"]: r["n"] for r in normalize_instants(df, "value", matches="n").collect()}
    assert [got[k] for k in range(len(cases))] == [n for _, n in cases]


@pytest.mark.parametrize("name", ["Europe/Berlin", "Europe/London", "Africa/Cairo", "Asia/Tokyo", "America/Sao_Paulo", "Africa/Casablanca", "Asia/Kathmandu", "Australia/Lord_Howe"])
def test_intervals_against_zoneinfo(name):
    spans, zone = offset_intervals(name), ZoneInfo(name)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    at = datetime(1903, 1, 1, tzinfo=UTC)
    while at.year < 2065:
        second = int(at.timestamp())
        span = next(s for s in spans if s[0] <= second < s[1])
        assert span[2] == at.astimezone(zone).utcoffset().total_seconds()
        at += timedelta(hours=997)
