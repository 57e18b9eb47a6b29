"""One key with a third of all rows: same results, and no task left with all of them."""

from __future__ import annotations

import re

import pytest
from conftest import AS_OF, LOAD_TIME, rows_of
from pyspark.sql import functions as F

from memberlens.functions.keys import SPREAD, spread_nulls
from memberlens.operators.orders import counts_as_order, distinct_lines
from memberlens.plans.marts import BY_TABLE, VISIT_LOG
from memberlens.sources.tables import from_frames

ROWS = 240_000
MEMBERS = 20_000
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def as_if_large(spark):
    """Settings that make these tables as large, for the planner, as real ones."""
    before = {key: spark.conf.get(key) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def number(salt: int, below: int):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))


def hot(salt: int, prefix: str = ""):
    """A third of the rows has key 42, a sixth has none, the others spread."""
    draw = number(salt, 6)
    other = F.concat(F.lit(prefix), number(salt + 1, MEMBERS).cast("string"))
    return F.when(draw < 2, F.lit(f"{prefix}42")).when(draw > 2, other)


def moment(salt: int):
    return F.timestamp_seconds(F.lit(1_577_836_800) + number(salt, 86_400 * 1900))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = spark.range(0, ROWS, 1, 8)
    members = spark.range(0, MEMBERS, 1, 2)
    text_id = F.col("id").cast("string")
    made = {
        "page_view": rows.select(
            hot(1, "g").alias("gio_id"),
            moment(3).alias("event_time"),
            number(4, 4).cast("string").alias("page_type"),
        ),
        "identity": members.select(
            F.concat(F.lit("g"), text_id).alias("gio_id"),
            F.lit("id_CRM_memberid").alias("prop_key"),
            text_id.alias("prop_value"),
            F.lit(1).alias("sign"),
            moment(5).alias("update_time"),
        ),
        "member": members.select(
            text_id.alias("member_detail_id"),
            moment(6).alias("join_time"),
            F.when(F.col("id") % 2 == 0, "BRANDWMP").otherwise("LCS").alias("eff_reg_channel"),
        ),
        "crm_map": members.select("id", F.col("id").alias("member_id")),
        "order_line": rows.select(
            moment(7).alias("order_paid_date"),
            F.when(number(8, 3) == 0, "TMALL").otherwise("LCS").alias("source_channel"),
            F.lit(1).alias("sales_type"),
            F.lit("normal").alias("order_type"),
            F.lit("CRM_memberid").alias("type_name"),
            hot(9, "tv").alias("type_value"),
            hot(11).alias("crm_member_detail_id"),
            F.lit(True).alias("if_eff_order_tag"),
            (number(13, 4) - 1).alias("sales_qty"),
            (number(14, 4) > 0).alias("is_member_order"),
            (number(15, 9999) / 100).cast("decimal(18,2)").alias("order_rrp_amt"),
            F.when(number(16, 3) == 0, 7).otherwise(number(17, ROWS)).alias("parent_order_id"),
            F.when(number(16, 3) == 0, 7).otherwise(number(17, ROWS)).alias("original_order_id"),
            F.lit("WOS企微小程序-新场景").alias("payment_type"),
        ),
        "order_scenario": rows.select(
            F.col("id").alias("parent_order_id"), F.lit("Organic").alias("order_scenario")
        ),
    }
    folder = tmp_path_factory.mktemp("skew")
    for role, df in made.items():
        df.write.parquet(f"{folder}/{role}")
    return from_frames({role: spark.read.parquet(f"{folder}/{role}") for role in made})


def final_plan(df) -> str:
    """The plan that adaptive execution arrived at; the rows must have been fetched."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "table",
    ["wmp_reg_member_converted_by_transaction_year",
     "wos_converted_through_wmp_by_transaction_year"],
)
def test_hot_members_and_orders(spark, tables, as_if_large, table):
    mart = BY_TABLE[table]
    result = mart(tables, AS_OF, LOAD_TIME)
    found = rows_of(result)
    assert "skew=true" in final_plan(result)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
    try:
        assert rows_of(mart(tables, AS_OF, LOAD_TIME)) == found
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_a_hot_device_is_split(tables, as_if_large):
    log = VISIT_LOG(tables)
    device = F.xxhash64("event_time", "page_type")
    found = log.agg(F.count("*"), F.sum(device.cast("decimal(38,0)")))
    (row,) = found.collect()
    assert re.search(r"SortMergeJoin\(skew=true\) \[gio_id", final_plan(found))
    assert row[0] > ROWS // 6


def test_lines_of_a_hot_member_do_not_share_a_task(tables, as_if_large):
    lines = distinct_lines(tables["order_line"], tables["crm_map"], AS_OF)
    per_task = lines.groupBy(F.spark_partition_id()).count()
    counts = [row["count"] for row in per_task.collect()]
    assert max(counts) < 2 * sum(counts) / len(counts)


@pytest.mark.parametrize("lost", ["member", "order", "both"])
def test_lines_of_one_day_without_member_or_order_do_not_share_a_task(tables, as_if_large, lost):
    """A third of all lines on one day, without what would spread them."""
    on_the_day = number(21, 3) == 0
    day = F.when(on_the_day, F.lit("2024-11-11").cast("timestamp")).otherwise(F.col("order_paid_date"))
    lines = tables["order_line"].withColumn("id", F.xxhash64(*tables["order_line"].columns))
    lines = lines.withColumn("order_paid_date", day)
    if lost != "order":
        for name in ("crm_member_detail_id", "type_value"):
            lines = lines.withColumn(name, F.when(~on_the_day, F.col(name)))
    if lost != "member":
        lines = lines.withColumn("parent_order_id", F.when(~on_the_day, F.col("parent_order_id")))
    if lost == "order":
        lines = lines.withColumn("crm_member_detail_id", F.when(on_the_day, "42").otherwise(F.col("crm_member_detail_id")))
    found = distinct_lines(lines.drop("id"), tables["crm_map"], AS_OF)
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) < 2 * sum(counts) / len(counts)
    assert found.agg(F.sum("copies")).first()[0] == lines.filter(counts_as_order(AS_OF)).count()


def test_lines_without_a_member_do_not_share_a_task(tables, as_if_large):
    lines = tables["order_line"].filter(F.col("crm_member_detail_id").isNull())
    spread = spread_nulls(lines, F.col("crm_member_detail_id"), ["type_value", "parent_order_id",
                                                                 "order_paid_date"])
    placed = spread.repartition(16, SPREAD).groupBy(F.spark_partition_id()).count()
    counts = [row["count"] for row in placed.collect()]
    assert len(counts) == 16
    assert max(counts) < 2 * sum(counts) / len(counts)
