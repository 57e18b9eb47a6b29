"""Views of the member dimension.

All are merged to distinct rows before they are joined, so that a member listed very
often does not multiply the rows of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import int_key, text_key
from memberlens.functions.labels import BRANDWMP, channel_label, year_label
from memberlens.sources.checks import bad_ids, none_of, watched


def join_year() -> Column:
    return F.year("join_time")


def cohorts(member: DataFrame, floor_text: str) -> DataFrame:
    """Reporting channel and join-year label by numeric member id.

    A repeated member keeps each of its labels once, with the number of dimension rows.
    """
    return (
        _known(member)
        .groupBy(
            "member_detail_id",
            channel_label().alias("eff_reg_channel"),
            year_label(join_year(), floor_text).alias("join_year"),
        )
        .agg(F.count("*").alias("copies"))
    )


def channels(member: DataFrame) -> DataFrame:
    """Distinct (numeric member id, reporting channel)."""
    label = channel_label().alias("eff_reg_channel")
    return _known(member).select("member_detail_id", label).distinct()


def channel_years(member: DataFrame) -> DataFrame:
    """Distinct (numeric member id, reporting channel, join year), years as they are."""
    return (
        _known(member)
        .select(
            "member_detail_id",
            channel_label().alias("eff_reg_channel"),
            join_year().alias("join_year"),
        )
        .distinct()
    )


def first_join_date(member: DataFrame) -> DataFrame:
    return (
        _known(member)
        .groupBy("member_detail_id")
        .agg(F.min(F.to_date("join_time")).alias("join_date"))
    )


def wmp_registrants(member: DataFrame, floor_text: str) -> DataFrame:
    """Distinct (id text, join year, label) of members registered in the mini-program."""
    return (
        member.filter(F.col("eff_reg_channel") == BRANDWMP)
        .select(
            text_key("member_detail_id").alias("member_detail_id"),
            join_year().alias("join_year"),
            year_label(join_year(), floor_text).alias("reg_year"),
        )
        .distinct()
    )


def _known(member: DataFrame) -> DataFrame:
    """Dimension rows with a numeric id; the others match no lookup."""
    key = int_key("member_detail_id")
    ids = {**none_of("member_detail_id", "join_time"), **bad_ids("member_detail_id")}
    return watched("member", member, **ids).filter(key.isNotNull()).withColumn("member_detail_id", key)
