"""Every mart and shared block as a query over the test tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.functions.labels import (
    CONVERSION_GAPS,
    FLOOR_ENGLISH,
    FLOOR_JOINED,
    FLOOR_SPACED,
    LCS,
    NOT_CONVERTED,
    REVISIT_GAPS,
    channel_label,
    frequency_label,
    gap_label,
    platform_label,
    year_label,
)
from memberlens.functions.measures import ALL_SALES, MEMBER_SALES, Money, ratio
from memberlens.operators import contacts, identity, members, orders, purchases, visits
from memberlens.plans.marts import MARTS, VISIT_LOG
from memberlens.plans.sales_marts import registrant_sales, yearly_sales
from memberlens.session import configure, shared_folder
from memberlens.sinks.refresh import FolderSink
from memberlens.sources.sample import from_test_data
from memberlens.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def queries(as_of: date, load_time: datetime) -> dict[str, Query]:
    result = {mart.build.__name__: _mart_query(mart, as_of, load_time) for mart in MARTS}
    for name, block in blocks(as_of).items():
        result[f"block_{name}"] = _block_query(block)
    return result


def _mart_query(mart, as_of: date, load_time: datetime) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = from_test_data(configure(spark), folder)
        if {"visit_log", "visit_years"} & {*mart.inputs}:
            tables = tables.with_table("visit_log", VISIT_LOG(tables, as_of, load_time))
        return mart(tables, as_of, load_time)

    return run


def _block_query(block: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return block(from_test_data(configure(spark), folder))

    return run


def blocks(as_of: date) -> dict[str, Callable[[Tables], DataFrame]]:
    """The shared blocks over given inputs, with the column types of their SQL."""
    contact_inputs = ("contact_event", "identity", "contact_tag")

    def omni_member_ids(t: Tables) -> DataFrame:
        given = [F.col(c).alias(f"given_{c}") for c in orders.ID_COLUMNS]
        ids = (
            t["order_line"].filter(orders.counts_as_order(as_of))
            .select(*orders.ID_COLUMNS)
            .distinct()
            .select("*", *given)
        )
        back = [F.col(f"given_{c}").alias(c) for c in orders.ID_COLUMNS]
        return (
            orders.with_omni_id(ids, t["crm_map"])
            .select(*back, "omni_channel_member_id")
            .distinct()
        )

    def platform_totals(t: Tables) -> DataFrame:
        lines = orders.distinct_lines(t["order_line"], t["crm_map"], as_of)
        return yearly_sales(lines, t["member"]).select(
            F.col("transaction_year").cast("bigint").alias("transaction_year"),
            "source_channel",
            F.col("total_sales").cast("double").alias("total_sales"),
            "member_shopper",
            F.col("member_sales").cast("double").alias("member_sales"),
            "transactions",
        )

    def raw_lcs_totals(t: Tables) -> DataFrame:
        return orders.raw_sales_by_year(t["order_line"], as_of, LCS).select(
            F.col("transaction_year").cast("bigint").alias("transaction_year"),
            F.col("total_sales").cast("double").alias("total_sales"),
        )

    def valid_orders(t: Tables) -> DataFrame:
        counted = orders.counts_as_order(as_of)
        return (
            t["order_line"].groupBy("source_channel", "order_type", F.col("sales_type").cast("bigint").alias("sales_type"))
            .agg(F.count(F.when(counted, 1)).alias("valid"), F.count("*").alias("lines"))
        )

    def net_sales(t: Tables) -> DataFrame:
        lines = t["order_line"].filter(orders.counts_as_order(as_of))
        money = Money.of(lines)
        per_order = lines.groupBy(
            F.year("order_paid_date").cast("bigint").alias("transaction_year"),
            platform_label().alias("platform"),
            "parent_order_id",
        ).agg(*money.sums(), *money.sums(members_only=True))
        sales = F.col("sales")
        return (
            per_order.groupBy("transaction_year", "platform")
            .agg(
                money.net(ALL_SALES).cast("double").alias("sales"),
                money.net(MEMBER_SALES).cast("double").alias("member_sales"),
                F.count("parent_order_id").alias("transactions"),
            )
            .withColumn("atv", ratio(sales, F.col("transactions")))
        )

    def labels(t: Tables) -> DataFrame:
        year, floors = members.join_year(), (FLOOR_SPACED, FLOOR_JOINED, FLOOR_ENGLISH)
        days = F.datediff(F.lit(as_of), F.to_date("join_time"))
        return (
            t["member"]
            .select(
                channel_label().alias("channel"),
                *(year_label(year, f).alias(n) for f, n in zip(floors, "abc", strict=True)),
                gap_label(days, REVISIT_GAPS).alias("revisit"),
                gap_label(days, CONVERSION_GAPS, NOT_CONVERTED).alias("conversion"),
                frequency_label(F.month("join_time")).alias("frequency"),
            )
            .groupBy("channel", "a", "b", "c", "revisit", "conversion", "frequency")
            .agg(F.count("*").alias("members"))
        )

    def buying_years_of(t: Tables) -> DataFrame:
        lines = orders.distinct_lines(t["order_line"], t["crm_map"], as_of)
        return orders.buying_years_of(lines).withColumn("buy_year", F.col("buy_year").cast("bigint"))

    def visit_years(t: Tables) -> DataFrame:
        log = VISIT_LOG(t, as_of)
        years = visits.member_years(log)
        return years.withColumn("visit_year", F.col("visit_year").cast("bigint"))

    def line_copies(t: Tables) -> DataFrame:
        lines = orders.distinct_lines(t["order_line"], t["crm_map"], as_of)
        return lines.groupBy(
            F.year("order_paid_date").cast("bigint").alias("transaction_year"), "source_channel"
        ).agg(F.count("*").alias("distinct_lines"), F.sum("copies").alias("lines"))

    def refreshed_mart(t: Tables) -> DataFrame:
        """The flagship as of a year before, refreshed as of today, read from what is written."""
        spark = t["member"].sparkSession
        folder = shared_folder(spark) or tempfile.mkdtemp(prefix="refreshed-")
        sink = FolderSink(spark, f"{folder}/refreshed-{uuid4().hex}")
        mart = next(m for m in MARTS if m.build is registrant_sales)
        for day in (as_of.replace(year=as_of.year - 1), as_of):
            rows = sink.refresh(mart.table, mart(t, day))
        return rows

    return {
        "visit_years": visit_years,
        "line_copies": line_copies,
        "refreshed_mart": refreshed_mart,
        "all_identities": lambda t: identity.all_identities(t["identity"]),
        "valid_orders": valid_orders,
        "net_sales": net_sales,
        "labels": labels,
        "buying_years_of": buying_years_of,
        "latest_identity": lambda t: identity.latest_identity(t["identity"]),
        "contact_adds": lambda t: contacts.contact_adds(**t.pick(*contact_inputs), as_of=as_of),
        "current_relations": lambda t: contacts.current_relations(
            **t.pick("staff_relation", "staff", "thirdparty_bind")
        )
        .withColumn("created_type", F.col("created_type").cast("bigint"))
        .withColumn("relation_deleted", F.col("relation_deleted").cast("bigint")),
        "omni_member_ids": omni_member_ids,
        "lcs_buyers": lambda t: orders.lcs_buyers(t["order_line"], t["crm_map"], as_of),
        "buying_years": lambda t: orders.buying_years(
            t["order_line"], t["crm_map"], as_of
        ).withColumn("buy_year", F.col("buy_year").cast("bigint")),
        "distinct_lines": lambda t: orders.distinct_lines(
            t["order_line"], t["crm_map"], as_of
        )
        .drop(*orders.ADDED)
        .withColumn("order_rrp_amt", F.col("order_rrp_amt").cast("double")),
        "purchase_days": lambda t: purchases.purchase_days(t["member_order"]),
        "platform_totals": platform_totals,
        "raw_lcs_totals": raw_lcs_totals,
    }
