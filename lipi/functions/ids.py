"""Id helpers: stable md5 buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(key: Column, m: int) -> Column:
    """int(md5(key).hexdigest(), 16) % m without 128-bit integers: fold the
    32 hex digits left to right, keeping the running value modulo m."""
    digits = F.transform(F.split(F.md5(key), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + d, F.lit(m)))


def hsl_color(key: Column) -> Column:
    """The colour key text: hsl(h, s%, l%)."""
    return F.format_string("hsl(%d, %d%%, %d%%)", md5_bucket(key, 360),
                           F.lit(60) + md5_bucket(key, 30), F.lit(75) + md5_bucket(key, 15))
