"""Registration, contact-adding and conversion funnels.

Counts of members that meet a condition are sums of per-member flags: every side is
brought down to one row per member (or member and year) before it is joined, which
keeps rows from multiplying and lets one pass answer all counts of a mart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import (
    SPREAD,
    int_key,
    int_text_key,
    keyed,
    lookup,
    spread_nulls,
)
from memberlens.functions.labels import (
    CONVERSION_GAPS,
    DOUYIN,
    DOUYIN_B2B,
    FLOOR_ENGLISH,
    FLOOR_JOINED,
    LCS,
    NOT_CONVERTED,
    TMALL,
    WMP,
    gap_label,
    year_label,
)
from memberlens.functions.measures import ratio
from memberlens.operators.members import channels, join_year, wmp_registrants
from memberlens.operators.purchases import first_purchase_days


def _flag(condition: Column) -> Column:
    """Whether any row of the group meets the condition; unknown counts as no."""
    return F.max(F.coalesce(condition, F.lit(False)))


def _look_up(buyers: DataFrame) -> DataFrame:
    """Buying years to look up by the text of the member id."""
    at = F.col("source_channel").alias("bought_at")
    return keyed(buyers, F.col("omni_channel_member_id"), "buy_year", at)


def _store_buyers(buyers: DataFrame) -> DataFrame:
    return _look_up(buyers.filter(F.col("source_channel") == LCS))


def days_to_first_purchase(member: DataFrame, member_order: DataFrame) -> DataFrame:
    """Days from registration to first purchase, for mini-program channels."""
    registered = member.filter(F.col("eff_reg_channel").contains(WMP)).select(
        "member_detail_id",
        F.to_date("join_time").alias("join_date"),
        year_label(join_year(), FLOOR_JOINED).alias("reg_year"),
    )
    key = int_key("member_detail_id")
    first = first_purchase_days(member_order)
    days = F.datediff("date_id", "join_date")
    return (
        lookup(
            spread_nulls(registered, key, registered.columns),
            keyed(first, F.col("member_key"), "date_id"),
        )
        .groupBy(
            "reg_year", gap_label(days, CONVERSION_GAPS, NOT_CONVERTED).alias("days_to_0_1_convert")
        )
        .agg(F.count_distinct("member_detail_id").alias("member_count"))
    )


def conversion_by_cohort(
    member: DataFrame, buyers: DataFrame, contact_adds: DataFrame
) -> DataFrame:
    """Purchases of mini-program registrants, by platform and contact-adding."""
    registrants = wmp_registrants(member, FLOOR_ENGLISH)
    adders = (
        keyed(contact_adds, int_key("crm_member_id")).distinct().withColumn("added", F.lit(True))
    )
    same_year = F.col("buy_year") == F.col("join_year")
    at = F.col("bought_at")
    members = (
        lookup(
            spread_nulls(registrants, F.col("member_detail_id"), registrants.columns),
            _look_up(buyers),
        )
        .groupBy("reg_year", "member_detail_id", SPREAD)
        .agg(
            _flag(F.col("buy_year").isNotNull()).alias("bought"),
            _flag(same_year).alias("bought_same_year"),
            _flag(same_year & (at == LCS)).alias("lcs"),
            _flag(same_year & (at == TMALL)).alias("tmall"),
            _flag(same_year & at.isin(DOUYIN, DOUYIN_B2B)).alias("douyin"),
        )
    )
    everyone = lookup(
        spread_nulls(members, int_key("member_detail_id"), ["reg_year", "member_detail_id"]),
        adders,
    )
    added = F.col("added").isNotNull()
    return everyone.groupBy("reg_year").agg(
        F.count("member_detail_id").alias("reg_member"),
        _members(F.col("bought")).alias("ltd_omni_converted_member"),
        _members(F.col("bought_same_year")).alias("ytd_omni_converted_member"),
        _members(F.col("lcs")).alias("ytd_lcs_converted_member"),
        _members(F.col("tmall")).alias("ytd_tmall_converted_member"),
        _members(F.col("douyin")).alias("ytd_dy_converted_member"),
        _members(added).alias("add_wecom_member"),
        _members(added & F.col("lcs")).alias("add_wecom_and_ytd_lcs_converted"),
        _members(~added).alias("not_add_wecom_member"),
        _members(~added & F.col("lcs")).alias("not_add_wecom_but_ytd_lcs_converted"),
    )


def _members(condition: Column, member: str = "member_detail_id") -> Column:
    """Members whose row meets the condition; rows without an id are not members."""
    return F.count(F.when(condition, F.col(member)))


def recruitment_funnel(
    member: DataFrame, buyers: DataFrame, contact_adds: DataFrame, still_added: DataFrame
) -> DataFrame:
    """Registered, contact added, still added, bought in store; with ratios.

    "Still added" looks at current relations alone and needs no contact-adding event.
    """
    registrants = wmp_registrants(member, FLOOR_ENGLISH)
    adders = (
        keyed(contact_adds, int_key("crm_member_id"), "through_wmp")
        .groupBy(SPREAD)
        .agg(F.max("through_wmp").alias("through_wmp"))
    )
    joined = spread_nulls(registrants, F.col("member_detail_id"), registrants.columns)
    for side in [adders, still_added, _store_buyers(buyers)]:
        joined = lookup(joined, side)
    members = joined.groupBy("reg_year", "member_detail_id", SPREAD).agg(
        _flag(F.col("through_wmp").isNotNull()).alias("added"),
        _flag(F.col("through_wmp")).alias("by_wmp"),
        _flag(F.col("still_copies").isNotNull()).alias("still"),
        _flag(F.col("buy_year").isNotNull()).alias("bought"),
        _flag(F.col("buy_year") == F.col("join_year")).alias("bought_same_year"),
    )
    added, by_wmp, still_there = F.col("added"), F.col("by_wmp"), F.col("still")
    bought, same_year = F.col("bought"), F.col("bought_same_year")
    counts = members.groupBy("reg_year").agg(
        F.count("member_detail_id").alias("reg_member"),
        _members(added).alias("add_wecom_member"),
        _members(still_there).alias("add_wecom_member_still_added"),
        _members(by_wmp).alias("add_wecom_through_wmp_member"),
        _members(by_wmp & still_there).alias("add_wecom_through_wmp_member_and_still_added"),
        _members(added & bought).alias("add_wecom_and_ltd_converted_member"),
        _members(by_wmp & bought).alias("add_wecom_through_wmp_and_ltd_converted_member"),
        _members(added & same_year).alias("add_wecom_and_ytd_converted_member"),
        _members(by_wmp & same_year).alias("add_wecom_through_wmp_and_ytd_converted_member"),
    )

    def share(part: str, whole: str, name: str) -> Column:
        return ratio(F.col(part), F.col(whole)).alias(name)

    wmp_adders = "add_wecom_through_wmp_member"
    return counts.select(
        "reg_year",
        "reg_member",
        share("add_wecom_member", "reg_member", "wecom_added_ratio"),
        "add_wecom_member",
        "add_wecom_member_still_added",
        share("add_wecom_member_still_added", "add_wecom_member", "wecom_still_added_ratio"),
        wmp_adders,
        "add_wecom_through_wmp_member_and_still_added",
        share(
            "add_wecom_through_wmp_member_and_still_added",
            wmp_adders,
            "wecom_through_wmp_still_added_ratio",
        ),
        "add_wecom_and_ltd_converted_member",
        "add_wecom_through_wmp_and_ltd_converted_member",
        share("add_wecom_and_ltd_converted_member", "add_wecom_member", "add_wecom_ltd_CR"),
        share(
            "add_wecom_through_wmp_and_ltd_converted_member",
            wmp_adders,
            "add_wecom_through_wmp_member_ltd_CR",
        ),
        "add_wecom_and_ytd_converted_member",
        "add_wecom_through_wmp_and_ytd_converted_member",
        share("add_wecom_and_ytd_converted_member", "add_wecom_member", "add_wecom_ytd_CR"),
        share(
            "add_wecom_through_wmp_and_ytd_converted_member",
            wmp_adders,
            "add_wecom_through_wmp_member_ytd_CR",
        ),
    )


def contact_adders_by_year(
    contact_adds: DataFrame, still_added: DataFrame, member: DataFrame, buyers: DataFrame
) -> DataFrame:
    """Contact-adding members per add year, channel and way of adding.

    Members are counted by the id's text, so ids that are no number count too, without
    a channel. "Same year" is the year the contact was added.
    """
    joined = spread_nulls(contact_adds, int_text_key("crm_member_id"), contact_adds.columns)
    cohort = keyed(channels(member), F.col("member_detail_id"), "eff_reg_channel")
    for side in [still_added, cohort, _store_buyers(buyers)]:
        joined = lookup(joined, side)
    keys = ["add_year", "eff_reg_channel", "through_wmp"]
    per_member = joined.groupBy(*keys, "crm_member_id", SPREAD).agg(
        _flag(F.col("still_copies").isNotNull()).alias("still"),
        _flag(F.col("buy_year").isNotNull()).alias("bought"),
        _flag(F.col("buy_year") == F.col("add_year")).alias("bought_same_year"),
    )
    return per_member.groupBy(
        F.col("add_year").cast("bigint").alias("add_wecom_year"),
        "eff_reg_channel",
        F.col("through_wmp").cast("bigint").alias("add_wecom_through_wmp"),
    ).agg(
        F.count("crm_member_id").alias("member_count"),
        _members(F.col("still"), "crm_member_id").alias("add_wecom_member_still_added"),
        _members(F.col("bought"), "crm_member_id").alias("ltd_lcs_converted"),
        _members(F.col("bought_same_year"), "crm_member_id").alias("ytd_lcs_converted"),
    )
