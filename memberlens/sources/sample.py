"""The 13 inputs derived from the order, customer, supplier and event test tables.

Every row of those tables flows in; arithmetic on keys only decides which case a row
shows (missing mapping, deleted relation, second identity...). The rules are written out
in FIXTURES.md, and once more as SQL in ``memberlens.verification.oracle``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memberlens.functions.labels import (
    BRANDEC,
    BRANDWMP,
    DOUYIN,
    DOUYIN_B2B,
    LCS,
    TMALL,
)
from memberlens.operators.contacts import BINDING_APP, BINDING_TYPE, CONTACT_ADD, WMP_SCENE
from memberlens.operators.identity import MEMBER_PROPERTY
from memberlens.operators.orders import ECOM_ORDER_TYPE
from memberlens.operators.purchases import EXCLUDED_DISTRIBUTOR, FIRST_PURCHASE, qualifying
from memberlens.plans.sales_marts import ASSISTANT_PAYMENT, ORGANIC
from memberlens.plans.visit_marts import HISTORY_TYPE
from memberlens.sources.tables import Tables

JOIN_OFFSETS = [0, 5, 10, 20, 60, 120, 300, 361, 500, -4, 1]
SEGMENT_CHANNELS = {
    "FURNITURE": BRANDWMP,
    "BUILDING": "LCS_STORE",
    "HOUSEHOLD": DOUYIN,
    "AUTOMOBILE": BRANDEC,
}

# Schemas of files read before; asking the file again costs a job per table and query.
_schemas: dict[str, StructType] = {}


def from_test_data(spark: SparkSession, folder: str) -> Tables:
    @cache
    def read(name: str) -> DataFrame:
        path = f"{folder}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = spark.read.parquet(path).schema
        return spark.read.schema(_schemas[path]).parquet(path)

    @cache
    def orders() -> DataFrame:
        return read("orders").select(
            "o_orderkey",
            "o_custkey",
            "o_orderpriority",
            F.col("o_orderstatus").alias("status"),
            F.expr("o_orderdate + interval 24 year").alias("ts"),
        )

    derive = {
        "member": lambda: _member(read("customer"), orders()),
        "order_line": lambda: _order_line(read("lineitem"), orders()),
        "crm_map": lambda: _crm_map(read("customer")),
        "member_order": lambda: _member_order(orders()),
        "contact_event": lambda: _contact_event(orders(), read("events")),
        "identity": lambda: _identity(read("customer")),
        "page_view": lambda: _page_view(orders(), read("events")),
        "contact_tag": lambda: _contact_tag(read("customer")),
        "staff_relation": lambda: _staff_relation(read("customer"), read("supplier")),
        "staff": lambda: _staff(read("supplier")),
        "thirdparty_bind": lambda: _thirdparty_bind(read("customer")),
        "ec_history": lambda: _ec_history(read("customer")),
        "order_scenario": lambda: _order_scenario(orders()),
    }
    return Tables(lambda role: derive[role]())


def _tagged(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    """One output row per struct; NULL structs (cases that do not apply) give none."""
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def _sales(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("crm_member_id"),
        F.to_date("ts").alias("date_id"),
        F.when(key % 6 == 0, 0).otherwise(1).alias("is_rrp_sales_type"),
        F.when(key % 9 == 0, EXCLUDED_DISTRIBUTOR)
        .when(key % 11 == 0, F.lit(None))
        .otherwise("D1")
        .alias("distributor_name"),
        (F.col("status") != "P").alias("if_eff_order_tag"),
    )


def _member_order(orders: DataFrame) -> DataFrame:
    sales = _sales(orders)
    # Each customer's first qualifying order, found without gathering the customer's rows.
    first = (
        qualifying(sales)
        .groupBy("crm_member_id")
        .agg(F.min(F.struct("date_id", "o_orderkey")).alias("first"))
        .select(F.col("first.o_orderkey").alias("o_orderkey"), F.lit(True).alias("is_first"))
    )
    lifecycle = F.when(F.col("is_first"), FIRST_PURCHASE).otherwise("repeat")
    return (
        sales.join(first, "o_orderkey", "left")
        .withColumn("initial_vs_repurchase_lifecycle", lifecycle)
        .drop("o_orderkey", "is_first")
    )


def _member(customer: DataFrame, orders: DataFrame) -> DataFrame:
    first = (
        qualifying(_sales(orders))
        .groupBy(F.col("crm_member_id").alias("member_detail_id"))
        .agg(F.min("date_id").alias("first_date"))
    )
    case = F.col("c_custkey") % 12
    offset = F.element_at(F.array(*map(F.lit, JOIN_OFFSETS)), (case + 1).cast("int"))
    by_purchase = F.when(case < len(JOIN_OFFSETS), F.date_sub("first_date", offset))
    by_key = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    channel = F
    for segment, text in SEGMENT_CHANNELS.items():
        channel = channel.when(F.col("c_mktsegment") == segment, text)
    members = (
        customer.withColumn("member_detail_id", F.col("c_custkey").cast("string"))
        .join(first, "member_detail_id", "left")
        .select(
            "c_custkey",
            "member_detail_id",
            F.coalesce(by_purchase, by_key).alias("join_date"),
            channel.alias("channel"),
        )
    )

    def row(join_date: Column, channel: Column) -> Column:
        return F.struct(
            "member_detail_id",
            join_date.cast("timestamp").alias("join_time"),
            channel.alias("eff_reg_channel"),
        )

    again = F.col("c_custkey") % 50 == 7
    return _rows(
        members,
        row(F.col("join_date"), F.col("channel")),
        F.when(again, row(F.date_add("join_date", 400), F.lit("WMP_LCS"))),
    )


def _order_line(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    channel = (
        F.when((flag == "A") & (status == "F"), TMALL)
        .when((flag == "A") & (status == "O"), DOUYIN)
        .when((flag == "N") & (status == "F"), DOUYIN_B2B)
        .otherwise(LCS)
    )
    quantity = F.col("l_quantity").cast("bigint")
    times = F.when((key % 10 == 3) & (line == 1), 2).otherwise(1)
    joined = lineitem.join(orders, F.col("l_orderkey") == key)
    return joined.select(
        F.col("ts").alias("order_paid_date"),
        channel.alias("source_channel"),
        (line % 4).alias("sales_type"),
        F.when(line == 7, "presale").otherwise(ECOM_ORDER_TYPE).alias("order_type"),
        F.when(line == 6, "other").otherwise("CRM_memberid").alias("type_name"),
        _tagged("tv", "o_custkey").alias("type_value"),
        F.when(key % 8 != 5, F.col("o_custkey").cast("string")).alias("crm_member_detail_id"),
        (F.col("status") != "P").alias("if_eff_order_tag"),
        F.when(flag == "R", -quantity).otherwise(quantity).alias("sales_qty"),
        (key % 5 != 0).alias("is_member_order"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("order_rrp_amt"),
        key.alias("parent_order_id"),
        key.alias("original_order_id"),
        F.when(key % 2 == 0, ASSISTANT_PAYMENT).otherwise("other").alias("payment_type"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("copy"),
    ).drop("copy")


def _crm_map(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    known = F.when(key % 20 != 0, key).alias("member_id")
    return _rows(
        customer,
        F.struct(key.alias("id"), known),
        F.when(key % 60 == 1, F.struct((key + 1).alias("id"), known)),
    )


def _contact_event(orders: DataFrame, events: DataFrame) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    added = (key % 12 == 0) & (customer % 4 != 3)
    attributes = F.concat(
        F.lit('{"unionId":"u'), customer.cast("string"), F.lit('","store_codes":"s1"}')
    )
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).alias("event_time")
    from_orders = orders.select(
        F.when(added, CONTACT_ADD).otherwise("order_placed").alias("event_key"),
        seconds,
        F.when(key % 40 == 0, "not json").otherwise(attributes).alias("attributes"),
        _tagged("g", "o_custkey").alias("gio_id"),
    )
    return from_orders.unionByName(
        events.select(
            F.col("event_type").alias("event_key"),
            seconds,
            F.col("props").alias("attributes"),
            _tagged("g", "user_id").alias("gio_id"),
        )
    )


def _identity(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")

    def value(text: Column, sign: int, day: str, name: str = MEMBER_PROPERTY) -> Column:
        return F.struct(
            _tagged("g", "c_custkey").alias("gio_id"),
            F.lit(name).alias("prop_key"),
            text.cast("string").alias("prop_value"),
            F.lit(sign).alias("sign"),
            F.lit(day).cast("timestamp").alias("update_time"),
        )

    return _rows(
        customer,
        value(key, 1, "2024-02-01"),
        value(F.lit("z"), 1, "2024-02-01", "id_other"),
        F.when(key % 10 == 0, value(key + 1, 1, "2023-02-01")),
        F.when(key % 40 == 0, value(F.concat(F.lit("00"), key.cast("string")), 1, "2022-02-01")),
        F.when(key % 25 == 0, value(_tagged("bad", "c_custkey"), 1, "2024-06-01")),
        F.when(key % 30 == 0, value(key + 2, 0, "2024-06-01")),
    )


def _page_view(orders: DataFrame, events: DataFrame) -> DataFrame:
    def view(df: DataFrame, device: str, page: str) -> DataFrame:
        return df.select(
            _tagged("g", device).alias("gio_id"),
            F.col("ts").alias("event_time"),
            F.col(page).alias("page_type"),
        )

    return view(orders, "o_custkey", "o_orderpriority").unionByName(
        view(events, "user_id", "event_type")
    )


def _contact_tag(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    union_id = F.when(key % 7 != 0, _tagged("u", "c_custkey")).alias("union_id")

    def tag(source: Column) -> Column:
        return F.struct(union_id, source.alias("wecom_channel_source"))

    return _rows(
        customer,
        tag(F.when(key % 3 == 0, WMP_SCENE).when(key % 3 == 1, "other")),
        F.when(key % 21 == 1, tag(F.lit(WMP_SCENE))),
    )


def _staff_relation(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    staff_count = supplier.agg(F.count("*")).scalar()
    deleted = (key % 2 != 0) | (key % 5 == 0)
    return customer.select(
        _tagged("u", "c_custkey").alias("external_user_unionid"),
        (key % staff_count).alias("staff_ext_id"),
        F.lit("2024-01-01").cast("timestamp").alias("relation_created_at"),
        (key % 2).cast("int").alias("relation_source"),
        F.when(deleted, 1).otherwise(0).alias("relation_deleted"),
    )


def _staff(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("staff_ext_id"),
        F.col("s_name").alias("staff_name"),
        F.when(key % 10 != 4, _tagged("store", "s_suppkey")).alias("lego_store_code"),
        _tagged("Store ", "s_suppkey").alias("store_name"),
        F.lit("D1").alias("distributor"),
        F.lit("P1").alias("partner"),
        F.col("s_nationkey").cast("string").alias("region"),
        F.lit(LCS).alias("channel"),
    )


def _thirdparty_bind(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        F.when(key % 13 == 0, "openId").otherwise(BINDING_TYPE).alias("id_type"),
        F.when(key % 17 == 0, 3).otherwise(BINDING_APP).alias("thirdparty_app_id"),
        _tagged("u", "c_custkey").alias("id_value"),
        key.cast("string").alias("member_detail_id"),
    )


def _ec_history(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        F.lit(HISTORY_TYPE).alias("belong_type"),
        F.when(key % 2 == 0, "TMall").otherwise("Douyin").alias("eff_belong_channel"),
        F.when(key % 3 == 0, key.cast("string")).alias("member_detail_id"),
        F.concat(F.lit("p"), (key % 50).cast("string")).alias("platform_id_value"),
    )


def _order_scenario(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")

    def scenario(text: Column) -> Column:
        return F.struct(key.alias("parent_order_id"), text.alias("order_scenario"))

    return _rows(
        orders,
        scenario(F.when(key % 7 != 0, F.when(key % 4 == 0, ORGANIC).otherwise("Staff"))),
        F.when(key % 16 == 0, scenario(F.lit("Staff"))),
    )
