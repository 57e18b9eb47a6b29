"""Marts over the visit log (M01-M09), most of them over its members' years.

Both sides of each join are distinct, per member and period and per member and label,
so that every member meets a cell at most once and plain counts are distinct counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.labels import (
    BRANDEC,
    DOUYIN,
    FLOOR_SPACED,
    REVISIT_GAPS,
    channel_label,
    frequency_label,
    gap_label,
    year_label,
)
from memberlens.functions.measures import ratio
from memberlens.operators import visits
from memberlens.operators.members import channel_years, channels, cohorts
from memberlens.operators.purchases import purchase_years

# Fixed values of the historical e-commerce member table.
HISTORY_TYPE = "registerOrBind"
HISTORY_CHANNELS = {"TMall": BRANDEC, "Douyin": DOUYIN}


def _bigint(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def member_visits_log(page_view: DataFrame, identity: DataFrame, member: DataFrame) -> DataFrame:
    """Distinct page views of identified members since they joined."""
    return visits.identified_views(page_view, identity, member)


def visitors_by_year(visit_years: DataFrame, member: DataFrame) -> DataFrame:
    """Visiting members per visit year, channel and join year."""
    return (
        visit_years.join(cohorts(member, FLOOR_SPACED), "member_detail_id", "left")
        .groupBy(
            _bigint("visit_year").alias("visit_wmp_year"), "eff_reg_channel", "join_year"
        )
        .agg(F.count("member_detail_id").alias("visit_wmp_member_count"))
    )


def average_visit_days(visit_years: DataFrame, member: DataFrame) -> DataFrame:
    """Visit days, visitors and days per visitor.

    A member listed twice in the dimension adds its days twice but counts once.
    """
    days = F.sum(F.col("visit_days") * F.coalesce("copies", F.lit(1))).cast("double")
    members = F.count("member_detail_id")
    return (
        visit_years.join(cohorts(member, FLOOR_SPACED), "member_detail_id", "left")
        .groupBy(_bigint("visit_year").alias("visit_year"), "eff_reg_channel", "join_year")
        .agg(days.alias("ttl_visit_days"), members.alias("visit_member_count"))
        .withColumn("avg_visit_days", ratio(F.col("ttl_visit_days"), F.col("visit_member_count")))
    )


def visit_day_distribution(visit_years: DataFrame, member: DataFrame) -> DataFrame:
    """Members by their number of visit days in the year."""
    return (
        visit_years.join(cohorts(member, FLOOR_SPACED), "member_detail_id", "left")
        .groupBy(
            _bigint("visit_year").alias("visit_year"),
            "join_year",
            "eff_reg_channel",
            frequency_label(F.col("visit_days")).alias("visit_day_count"),
        )
        .agg(F.count("member_detail_id").alias("member_count"))
    )


def revisiting_members(visit_years: DataFrame, member: DataFrame) -> DataFrame:
    """Visitors, and those with two or more visit days in the year."""
    revisited = F.when(F.col("visit_days") >= 2, F.col("member_detail_id"))
    return (
        visit_years.join(cohorts(member, FLOOR_SPACED), "member_detail_id", "left")
        .groupBy(_bigint("visit_year").alias("visit_year"), "join_year", "eff_reg_channel")
        .agg(
            F.count("member_detail_id").alias("visit_member_count"),
            F.count(revisited).alias("revisit_member_count"),
        )
    )


def revisit_gaps(visit_years: DataFrame, member: DataFrame) -> DataFrame:
    """Days between the first and second visit day of a member's year.

    A member with several join years or channels has one row per day and each of them, also
    of years that share a label; the rows order by day, then year, then channel. So its second row
    is its first day again, with its second label, and a gap of 0 has no bucket. Years get their
    labels last.
    """
    in_order = Window.partitionBy("member_detail_id").orderBy(
        F.col("join_year").asc_nulls_last(), F.col("eff_reg_channel").asc_nulls_last()
    )
    of_second_row = (
        channel_years(member)
        .select(
            "*",
            F.row_number().over(in_order).alias("place"),
            F.lead(F.lit(1)).over(in_order).isNull().alias("alone"),
        )
        .filter((F.col("place") == 2) | ((F.col("place") == 1) & F.col("alone")))
    )
    again = F.when(F.col("place") == 2, F.col("first_day")).otherwise(F.col("second_day"))
    gap = F.datediff("again", "first_day")
    return (
        visit_years.join(of_second_row, "member_detail_id", "left")
        .withColumn("again", again)
        .filter(F.col("again").isNotNull())
        .groupBy(
            _bigint("visit_year").alias("visit_year"),
            year_label(F.col("join_year"), FLOOR_SPACED).alias("join_year"),
            "eff_reg_channel",
            gap_label(gap, REVISIT_GAPS).alias("time_diff"),
        )
        .agg(F.count("member_detail_id").alias("member_count"))
    )


def _bought_in_year(member_years: DataFrame, member_order: DataFrame) -> DataFrame:
    """Adds a 0/1 flag: a qualifying purchase of the member in the same year.

    Members meet, not member years, so that rows which lie by member stay where they are.
    """
    bought = F.coalesce(F.array_contains("years", F.col("visit_year")), F.lit(False)).cast("int")
    return (
        member_years.join(purchase_years(member_order), "member_detail_id", "left")
        .withColumn("bought", bought)
        .drop("years")
    )


def same_year_buyers(visit_years: DataFrame, member_order: DataFrame, member: DataFrame) -> DataFrame:
    """Visitors by whether they bought in the year of the visit."""
    return (
        _bought_in_year(visit_years.select("member_detail_id", "visit_year"), member_order)
        .join(channels(member), "member_detail_id", "left")
        .groupBy(
            _bigint("visit_year").alias("visit_year"),
            _bigint("bought").alias("YTD_converted"),
            "eff_reg_channel",
        )
        .agg(F.count("member_detail_id").alias("ttl_member_count"))
    )


def page_penetration(visit_log: DataFrame, member_order: DataFrame, member: DataFrame) -> DataFrame:
    """Share of visitors that saw a page type, buyers against others.

    The flag belongs to the member: a purchase in any year with a visit sets it for all
    years. Cells without a channel get no denominator. The log is read once: windows
    over a member's few (year, page type) rows find the flag and mark one row per year,
    and the marked rows add up to the members of a cell.
    """
    pages = visit_log.select(
        "member_detail_id", F.year("event_time").alias("visit_year"), "page_type"
    ).distinct()
    of_member = Window.partitionBy("member_detail_id")
    of_year = Window.partitionBy("member_detail_id", "visit_year").orderBy("page_type")
    known = F.when(F.col("member_detail_id").isNotNull(), F.max("bought").over(of_member))
    seen = (
        _bought_in_year(pages, member_order)
        .withColumn("YTD_converted", known)
        .withColumn("first_of_year", F.row_number().over(of_year) == 1)
    )
    cell = ["visit_year", "YTD_converted", "eff_reg_channel"]
    marked = F.when(F.col("first_of_year"), F.col("member_detail_id"))
    counts = (
        seen.join(channels(member), "member_detail_id", "left")
        .groupBy(*cell, "page_type")
        .agg(F.count("member_detail_id").alias("member_count"), F.count(marked).alias("marked"))
    )
    in_cell = F.sum("marked").over(Window.partitionBy(*cell))
    complete = F.col(cell[0]).isNotNull()
    for column in cell[1:]:
        complete = complete & F.col(column).isNotNull()
    return counts.withColumn("ttl_member_count", F.when(complete, in_cell)).select(
        _bigint("visit_year").alias("visit_year"),
        _bigint("YTD_converted").alias("YTD_converted"),
        "eff_reg_channel",
        "page_type",
        "member_count",
        "ttl_member_count",
        ratio(F.col("member_count"), F.col("ttl_member_count")).alias("visit_penetration"),
    )


def registered_and_visited(
    visit_years: DataFrame, member: DataFrame, ec_history: DataFrame, load_time: datetime
) -> DataFrame:
    """Members registered to date per channel, and those that ever visited."""
    registered = member.groupBy(channel_label().alias("eff_reg_channel")).agg(
        F.count("member_detail_id").alias("member_count")
    )
    unbound = F.when(F.col("member_detail_id").isNull(), F.col("platform_id_value"))
    belonging = F.col("eff_belong_channel")
    label = F
    for source, text in HISTORY_CHANNELS.items():
        label = label.when(belonging == source, F.lit(text))
    historical = (
        ec_history.filter(
            (F.col("belong_type") == HISTORY_TYPE) & belonging.isin(*HISTORY_CHANNELS)
        )
        .groupBy(label.alias("eff_reg_channel"))
        .agg(F.count_distinct(unbound).alias("member_count"))
    )
    # Both historical channels are reported even when the table has no row for them.
    both = F.array(*[F.lit(text) for text in HISTORY_CHANNELS.values()])
    always = member.sparkSession.range(1).select(
        F.explode(both).alias("eff_reg_channel"), F.lit(0).cast("bigint").alias("member_count")
    )
    by_channel = (
        registered.unionByName(historical)
        .unionByName(always)
        .groupBy("eff_reg_channel")
        .agg(F.sum("member_count").alias("reg_member_count"))
    )
    visited = (
        visit_years.select("member_detail_id")
        .distinct()
        .join(channels(member), "member_detail_id", "left")
        .groupBy("eff_reg_channel")
        .agg(F.count("member_detail_id").alias("member_visit_count"))
    )
    return by_channel.join(visited, "eff_reg_channel", "left").select(
        "eff_reg_channel",
        "reg_member_count",
        "member_visit_count",
        F.lit(load_time.strftime("%Y%m%d")).alias("dl_batch_date"),
        F.to_timestamp(F.lit(load_time.isoformat(sep=" "))).alias("dl_load_time"),
    )
