"""Time buckets and intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from the epoch to 2000-01-03, a Monday, at which buckets below a month start.
ORIGIN = 10959 * 86400
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def parse_width(width: str) -> tuple[int, str]:
    """``5 minutes`` as (5, minute)."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", width.lower())
    if not found or found[2] not in SECONDS | MONTHS or not int(found[1]):
        raise ValueError(f"bad bucket width {width!r}")
    return int(found[1]), found[2]


def time_bucket(ts: Column, width: str) -> Column:
    """Start of the bucket that holds ``ts``: fixed widths count from 2000-01-03, months from 2000-01-01 (a date)."""
    n, unit = parse_width(width)
    if unit in MONTHS:
        months = n * MONTHS[unit]
        index = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
        start = F.floor(index / F.lit(months)) * months
        return F.make_date((F.lit(2000) + F.floor(start / F.lit(12))).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1))
    seconds = n * SECONDS[unit]
    offset = ORIGIN % seconds
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds")["start"]
