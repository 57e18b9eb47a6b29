"""Omni-channel order lines: which count, and whose they are."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.keys import keyed, lookup, spread_nulls, text_key
from memberlens.functions.labels import DOUYIN, DOUYIN_B2B, LCS, TMALL
from memberlens.functions.measures import ALL_SALES, Money
from memberlens.sources.checks import none_of, watched

# Fixed values of the order table.
ALL_CHANNELS = (LCS, TMALL, DOUYIN, DOUYIN_B2B)
RESOLVABLE_IDS = ("CRM_memberid", "DY_openid", "TMALL_kyid")
LCS_EXCLUDED_SALES_TYPE = 3
ECOM_ORDER_TYPE = "normal"
ID_COLUMNS = ["type_name", "type_value", "crm_member_detail_id"]
#: Where distinct lines are placed; sums by these columns need no further shuffle. ``loose``
#: spreads lines without a member or order, which no order holds together.
PLACE = ["omni_channel_member_id", "parent_order_id", "order_paid_date", "loose"]
#: What distinct lines have besides the columns that make them equal.
ADDED = ["loose", "copies"]


def counts_as_order(as_of: date, channels: Sequence[str] = ALL_CHANNELS) -> Column:
    """Paid before the as-of day and of a kind that its channel counts."""
    per_channel = F.lit(False)
    if LCS in channels:
        store = F.col("source_channel") == LCS
        per_channel = per_channel | (
            store & (F.col("sales_type") != LCS_EXCLUDED_SALES_TYPE)
        )
    online = [c for c in channels if c != LCS]
    if online:
        per_channel = per_channel | (
            F.col("source_channel").isin(online) & (F.col("order_type") == ECOM_ORDER_TYPE)
        )
    return (F.to_date("order_paid_date") < F.lit(as_of)) & per_channel


def with_omni_id(lines: DataFrame, crm_map: DataFrame, first_match: str | None = None) -> DataFrame:
    """Replace the three id columns by ``omni_channel_member_id``.

    The mapped CRM id comes first, then the channel's own id; id types outside the
    list have none, so those lines skip the lookup. An id mapped in several ways
    repeats its lines; equal map entries do not. ``first_match`` names a column that is true in
    one of the rows of each line.
    """
    resolvable = F.col("type_name").isin(*RESOLVABLE_IDS)
    crm_id = F.when(resolvable, text_key("crm_member_detail_id"))
    entries = crm_map.select(text_key("member_id").alias("member_id"), text_key("id").alias("mapped_id"))
    entries = watched("crm_map", entries, **none_of("member_id", "mapped_id"))
    found, counted = ["mapped_id"], []
    if first_match:
        by_id = Window.partitionBy("member_id").orderBy("mapped_id")
        repeats = F.lag("mapped_id").over(by_id).eqNullSafe(F.col("mapped_id"))
        place = F.row_number().over(by_id)
        entries = (
            entries.filter(F.col("member_id").isNotNull())
            .select("*", (place == 1).alias(first_match), ((place > 1) & repeats).alias("repeats"))
            .filter(~F.col("repeats"))
        )
        found.append(first_match)
        counted = [F.coalesce(first_match, F.lit(True)).alias(first_match)]
    else:
        entries = entries.distinct()
    mapped = keyed(entries, F.col("member_id"), *found)
    omni_id = F.when(resolvable, F.coalesce("mapped_id", text_key("type_value")))
    rest = [c for c in lines.columns if c not in ID_COLUMNS]
    return lookup(spread_nulls(lines, crm_id, lines.columns), mapped).select(
        *rest, omni_id.alias("omni_channel_member_id"), *counted
    )


def distinct_lines(
    order_line: DataFrame,
    crm_map: DataFrame,
    as_of: date,
    channels: Sequence[str] = ALL_CHANNELS,
) -> DataFrame:
    """Order lines with equal ones merged; the column list decides which are equal.

    ``copies`` is how many lines each stands for: a line whose id is mapped in several ways
    is in several rows and counts in one of them, so that sums over all lines, equal ones
    included, need no second read. Lines are placed by member, order and day: equal ones meet
    there, and so do the lines of an order for the sums that follow, all in one shuffle. Where the
    member or the order is null, the whole row decides the place (``loose``).
    """
    lines = order_line.filter(counts_as_order(as_of, channels)).select(
        F.to_date("order_paid_date").alias("order_paid_date"),
        "source_channel",
        "if_eff_order_tag",
        "sales_qty",
        "is_member_order",
        "order_rrp_amt",
        "parent_order_id",
        *ID_COLUMNS,
    )
    lines = watched(
        "order_line",
        lines,
        **none_of("order_rrp_amt", "parent_order_id", "type_name"),
        rejected_amounts=Money.of(lines).rejected(),
    )
    known = with_omni_id(lines, crm_map, first_match="counts")
    equal = [c for c in known.columns if c != "counts"]
    unplaced = F.col("omni_channel_member_id").isNull() | F.col("parent_order_id").isNull()
    return (
        known.withColumn("loose", F.when(unplaced, F.xxhash64(*equal)))
        .repartition(*PLACE)
        .groupBy(*equal, "loose")
        .agg(F.sum(F.col("counts").cast("bigint")).alias("copies"))
    )


def buying_years(
    order_line: DataFrame,
    crm_map: DataFrame,
    as_of: date,
    channels: Sequence[str] = ALL_CHANNELS,
) -> DataFrame:
    """Distinct (member, year, channel) with an effective order.

    Both the life-to-date and the same-year buyers of a mart come from these rows, so
    the orders are read once. Lines shrink to ids and years before the id lookup.
    """
    bought = (
        order_line.filter(
            counts_as_order(as_of, channels)
            & F.col("if_eff_order_tag")
            & F.col("type_name").isin(*RESOLVABLE_IDS)
        )
        .select(
            F.year("order_paid_date").alias("buy_year"),
            "source_channel",
            # These types all resolve alike; one name for them leaves fewer rows.
            F.lit(RESOLVABLE_IDS[0]).alias("type_name"),
            "type_value",
            "crm_member_detail_id",
        )
        .distinct()
    )
    return (
        with_omni_id(bought, crm_map)
        .filter(F.col("omni_channel_member_id").isNotNull())
        .distinct()
    )


def buying_years_of(lines: DataFrame) -> DataFrame:
    """The same rows as :func:`buying_years`, from distinct lines that are written."""
    return (
        lines.filter(F.col("if_eff_order_tag") & F.col("omni_channel_member_id").isNotNull())
        .select(
            "omni_channel_member_id",
            F.year("order_paid_date").alias("buy_year"),
            "source_channel",
        )
        .distinct()
    )


def lcs_buyers(order_line: DataFrame, crm_map: DataFrame, as_of: date) -> DataFrame:
    """Members with an effective store order, ever."""
    return (
        buying_years(order_line, crm_map, as_of, [LCS])
        .select("omni_channel_member_id")
        .distinct()
    )


def raw_sales_by_year(order_line: DataFrame, as_of: date, channel: str) -> DataFrame:
    """Net sales of a channel over all lines, equal ones included."""
    money = Money.of(order_line)
    return (
        order_line.filter(counts_as_order(as_of, [channel]))
        .groupBy(F.year("order_paid_date").alias("transaction_year"))
        .agg(*money.sums())
        .groupBy("transaction_year")
        .agg(money.net(ALL_SALES).alias("total_sales"))
    )
