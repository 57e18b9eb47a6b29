"""Qualifying purchases in the member order table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import int_key

# Fixed values of the member order table.
EXCLUDED_DISTRIBUTOR = "LBR"
FIRST_PURCHASE = "会员生命周期首单"


def qualifying(member_order: DataFrame) -> DataFrame:
    """Effective retail-price sales; an unknown distributor does not qualify."""
    return member_order.filter(
        (F.col("is_rrp_sales_type") == 1)
        & (F.col("distributor_name") != EXCLUDED_DISTRIBUTOR)
        & F.col("if_eff_order_tag")
    )


def purchase_days(member_order: DataFrame) -> DataFrame:
    return qualifying(member_order).select("crm_member_id", "date_id").distinct()


def purchase_years(member_order: DataFrame) -> DataFrame:
    """The years in which each member (numeric id) bought, as an array."""
    return (
        qualifying(member_order)
        .groupBy(int_key("crm_member_id").alias("member_detail_id"))
        .agg(F.collect_set(F.year("date_id")).alias("years"))
    )


def first_purchase_days(member_order: DataFrame) -> DataFrame:
    """Distinct (numeric member id, day) of the lifecycle's first order."""
    return (
        qualifying(member_order)
        .filter(F.col("initial_vs_repurchase_lifecycle") == FIRST_PURCHASE)
        .select(int_key("crm_member_id").alias("member_key"), "date_id")
        .distinct()
    )
