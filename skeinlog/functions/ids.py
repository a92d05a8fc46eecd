"""Identifiers that are written differently but mean the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(col: Column) -> Column:
    """Lower case, without blanks and braces around it; null where nothing is left.

    Null, empty, blank and ``{}`` give null. Inner characters stay as they are.
    """
    bare = F.lower(F.regexp_replace(col, r"^[\s{ ]+|[\s} ]+$", ""))
    return F.when(bare == "", F.lit(None)).otherwise(bare)
