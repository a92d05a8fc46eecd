"""Written times to local wall times: every supported form is taken apart by one regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(Z|z|[+-]\d\d(?::?\d\d)?|[A-Za-z]{2,6})?"
FRACTION = r"(?:[.,](\d+))?"
#: Forms of written times; fixed values.
ISO = rf"^(\d{{4}})-?(\d\d)-?(\d\d)[Tt ](\d\d):?(\d\d)(?::?(\d\d))?{FRACTION}\s*{ZONE}(?:\[([^\]]+)\])?$"
DOTTED = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?[Tt ](\d{{1,2}}):(\d\d)(?::(\d\d))?{FRACTION}\s*([AaPp][Mm])?\s*{ZONE}$"
SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?[Tt ](\d{{1,2}}):(\d\d)(?::(\d\d))?{FRACTION}\s*([AaPp][Mm])?\s*{ZONE}$"
MAIL = rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{4}})\s+(\d{{1,2}}):(\d\d)(?::(\d\d))?{FRACTION}\s*{ZONE}$"
NUMBER = r"^[+-]?\d{1,19}(?:\.\d*)?$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_US = 86_400_000_000


def epoch_us(whole: Column, rest: Column, digits: Column, negative: Column) -> Column:
    """Whole part and fraction digits of a bare number since 1970 to microseconds.

    The count of digits without leading zeros tells s, ms, µs or ns.
    """
    fraction = lambda n: F.rpad(F.substring(rest, 1, n), n, "0").cast("bigint")
    us = (
        F.when(digits <= 11, whole * 1_000_000 + fraction(6))
        .when(digits <= 14, whole * 1_000 + fraction(3))
        .when(digits <= 17, whole)
        .otherwise(F.call_function("div", whole, F.lit(1000).cast("bigint")))
    )
    return F.when(negative, -us).otherwise(us)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a valid date of the Gregorian calendar (years from 1 on)."""
    year = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(year / 400)
    yoe = year - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146_097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719_468


def wall_parts(value: Column, order: Column) -> Column:
    """``array(Y, M, D, h, m, s, fraction, zone, am/pm, bracket)`` of text forms; one entry where none fits.

    ``order`` (DMY or MDY) says how day and month parted by slashes stand; null leaves such a value unread.
    """
    v = value
    slashed = (
        F.when(order == "DMY", F.regexp_replace(v, SLASHED, "$3|$2|$1|$4|$5|$6|$7|$9|$8|"))
        .when(order == "MDY", F.regexp_replace(v, SLASHED, "$3|$1|$2|$4|$5|$6|$7|$9|$8|"))
    )
    text = (
        F.when(v.rlike(r"^\d{4}"), F.regexp_replace(v, ISO, "$1|$2|$3|$4|$5|$6|$7|$8||$9"))
        .when(v.rlike(r"^\d{1,2}/"), slashed)
        .when(v.rlike(r"^\d{1,2}\."), F.regexp_replace(v, DOTTED, "$3|$2|$1|$4|$5|$6|$7|$9|$8|"))
        .otherwise(F.regexp_replace(v, MAIL, "$3|$2|$1|$4|$5|$6|$7|$8||"))
    )
    return F.split(text, r"\|")
