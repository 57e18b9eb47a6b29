"""Reporting labels. All texts here are fixed values that reports filter on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channels and platforms.
LCS = "LCS"
TMALL = "TMALL"
DOUYIN = "DOUYIN"
DOUYIN_B2B = "DOUYIN_B2B"
OMNI = "Omni"
BRANDWMP = "BRANDWMP"
BRANDEC = "BRANDEC"
WMP = "WMP"

# The last year that gets no label of its own, and its three spellings.
FLOOR_YEAR = 2022
FLOOR_SPACED = "2022 及以前"
FLOOR_JOINED = "2022及以前"
FLOOR_ENGLISH = "2022 and before"

# First and last day gap (both included) of each revisit bucket.
REVISIT_GAPS = [
    (1, 7, "1-7 days"),
    (8, 14, "8-14 days"),
    (15, 30, "15-30 days"),
    (31, 60, "31-60 days"),
    (61, 90, "61-90 days"),
    (91, 180, "91-180 days"),
    (181, 360, "181-360 days"),
    (361, None, "> 361 days"),
]

# Days from registration to first purchase. 361 is in no bucket.
CONVERSION_GAPS = [
    (0, 0, "1 - 当天转化"),
    (1, 7, "2 - 1-7天转化"),
    (8, 14, "3 - 8-14天转化"),
    (15, 30, "4 - 15-30"),
    (31, 90, "5 - 31-90"),
    (91, 180, "6 - 91-180"),
    (181, 360, "7 - 181-360"),
    (362, None, "8 - 361+"),
]
NOT_CONVERTED = "未转化"

# Visit days from which a member-year is counted as frequent.
FREQUENT_DAYS = 5
FREQUENT = "greater than 5"


def channel_label(column: str = "eff_reg_channel") -> Column:
    channel = F.col(column)
    return F.when(channel.contains(LCS), F.lit(LCS)).otherwise(channel)


def platform_label(column: str = "source_channel") -> Column:
    platform = F.col(column)
    return F.when(platform.isin(DOUYIN, DOUYIN_B2B), F.lit(DOUYIN)).otherwise(platform)


def year_label(year: Column, floor_text: str) -> Column:
    return F.when(year <= FLOOR_YEAR, F.lit(floor_text)).otherwise(year.cast("string"))


def gap_label(days: Column, buckets: list[tuple], otherwise: str | None = None) -> Column:
    """The text of the bucket a day gap falls in."""
    chain = F
    for first, last, text in buckets:
        inside = days >= first if last is None else days.between(first, last)
        chain = chain.when(inside, F.lit(text))
    return chain.otherwise(F.lit(otherwise))


def frequency_label(days: Column) -> Column:
    return F.when(days >= FREQUENT_DAYS, F.lit(FREQUENT)).otherwise(days.cast("string"))
