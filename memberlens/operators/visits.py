"""Visits at the grains the visit marts count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import SPREAD, keyed
from memberlens.operators.identity import latest_identity
from memberlens.operators.members import first_join_date
from memberlens.sources.checks import none_of, watched


def identified_views(
    page_view: DataFrame,
    identity: DataFrame,
    member: DataFrame,
    by_day: bool = False,
    with_pages: bool = True,
) -> DataFrame:
    """Distinct views of identified members on or after the day they joined.

    A device has at most one member and one join date, so the join adds no row. Full times
    hardly repeat: views are joined first and made distinct after, which needs no second
    shuffle, as they lie by device already. ``by_day`` cuts times to the day, enough for
    counting visits; such views repeat a lot and become distinct first, combined on the map
    side. For a member with several join dates the first one decides.
    """
    pages = ["page_type"] if with_pages else []
    seen = F.to_date("event_time") if by_day else F.col("event_time")
    views = page_view.select("gio_id", seen.alias("event_time"), *pages)
    views = watched("page_view", views, **none_of("gio_id", "event_time"))
    views = views.distinct() if by_day else views
    joined = first_join_date(member)
    devices = keyed(
        latest_identity(identity), F.col("member_detail_id"), "gio_id", "member_detail_id"
    ).join(keyed(joined, F.col("member_detail_id"), "join_date"), SPREAD)
    found = (
        views.join(devices, "gio_id")
        .filter(F.to_date("event_time") >= F.col("join_date"))
        .select("member_detail_id", "gio_id", "event_time", *pages)
    )
    return found if by_day else found.distinct()


#: Days of a year are bits of six numbers, of 62 each to leave the sign alone.
WORD, WORDS = 62, 6


def member_years(visit_log: DataFrame) -> DataFrame:
    """One row per member and year: ``visit_days``, ``first_day`` and ``second_day``.

    The days of a group are bits that are put together in one aggregation: a state of a fixed
    size, merged before the shuffle however often a member comes, with no distinct days in
    between. A visit without a time is in the year NULL and has no days.
    """
    days = visit_log.select(
        "member_detail_id",
        F.year("event_time").alias("visit_year"),
        (F.dayofyear("event_time") - 1).alias("day"),
    )
    bit = f"shiftleft(1L, day % {WORD})"
    states = days.groupBy("member_detail_id", "visit_year").agg(
        *[
            F.bit_or(F.expr(f"CASE WHEN day div {WORD} = {k} THEN {bit} ELSE 0L END")).alias(f"w{k}")
            for k in range(WORDS)
        ]
    )
    words = [F.col(f"w{k}") for k in range(WORDS)]
    before, rest = F.lit(0).cast("bigint"), []
    for word in words:
        rest.append(F.when(before == 0, word.bitwiseAND(word - 1)).otherwise(word))
        before = before.bitwiseOR(word)
    count = F.bit_count(words[0])
    for word in words[1:]:
        count = count + F.bit_count(word)
    return states.select(
        "member_detail_id",
        "visit_year",
        count.cast("bigint").alias("visit_days"),
        _first_day(words).alias("first_day"),
        _first_day(rest).alias("second_day"),
    )


def _first_day(words: list[Column]) -> Column:
    """The date of the lowest bit."""
    places = [
        F.when(w != 0, k * WORD + F.bit_count(w.bitwiseAND(-w) - 1)) for k, w in enumerate(words)
    ]
    return F.date_add(F.make_date("visit_year", F.lit(1), F.lit(1)), F.coalesce(*places))
