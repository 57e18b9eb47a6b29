"""Shared blocks on hand-written rows: each NULL, boundary and label case."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal, localcontext

import pytest
from conftest import AS_OF, rows_of
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from memberlens.functions import keys, labels
from memberlens.functions.measures import ALL_SALES, MEMBER_SALES, Money, ratio, zero_to_null
from memberlens.operators import contacts, identity, orders, purchases
from memberlens.session import (
    ADVISED_BYTES,
    INITIAL_PARTITIONS,
    PARTITION_BYTES,
    TASK_BYTES,
    configure,
    now,
)
from memberlens.sources.checks import key_report, lost_keys, repeated_keys
from memberlens.sources.tables import from_frames

DAY = datetime(2024, 2, 1)
MEMBER_KEY = "id_CRM_memberid"
IDENTITY = "gio_id string, prop_key string, prop_value string, sign int, update_time timestamp"


def test_channel_and_platform_labels(frame):
    df = frame("c string", ("X_LCS_Y",), ("LCS",), ("DOUYIN",), ("DOUYIN_B2B",), (None,))
    assert rows_of(df.select("c", labels.channel_label("c"), labels.platform_label("c"))) == [
        ("DOUYIN", "DOUYIN", "DOUYIN"),
        ("DOUYIN_B2B", "DOUYIN_B2B", "DOUYIN"),
        ("LCS", "LCS", "LCS"),
        ("X_LCS_Y", "LCS", "X_LCS_Y"),
        (None, None, None),
    ]


@pytest.mark.parametrize(
    "floor", [labels.FLOOR_SPACED, labels.FLOOR_JOINED, labels.FLOOR_ENGLISH]
)
def test_year_label(frame, floor):
    df = frame("y int", (2017,), (2022,), (2023,), (None,))
    found = rows_of(df.select("y", labels.year_label(F.col("y"), floor).alias("label")))
    assert found == [(2017, floor), (2022, floor), (2023, "2023"), (None, None)]


def test_the_three_floor_texts_differ():
    texts = {labels.FLOOR_SPACED, labels.FLOOR_JOINED, labels.FLOOR_ENGLISH}
    assert texts == {"2022 及以前", "2022及以前", "2022 and before"}


def test_revisit_gap_labels(frame):
    expected = {
        0: None, 1: "1-7 days", 7: "1-7 days", 8: "8-14 days", 14: "8-14 days",
        15: "15-30 days", 30: "15-30 days", 31: "31-60 days", 60: "31-60 days",
        61: "61-90 days", 90: "61-90 days", 91: "91-180 days", 180: "91-180 days",
        181: "181-360 days", 360: "181-360 days", 361: "> 361 days",
    }
    df = frame("d int", *[(d,) for d in expected])
    label = labels.gap_label(F.col("d"), labels.REVISIT_GAPS)
    assert dict(df.select("d", label).collect()) == expected


def test_conversion_gap_labels(frame):
    no = "未转化"
    expected = {
        -1: no, 0: "1 - 当天转化", 1: "2 - 1-7天转化", 7: "2 - 1-7天转化",
        8: "3 - 8-14天转化", 14: "3 - 8-14天转化", 15: "4 - 15-30", 30: "4 - 15-30",
        31: "5 - 31-90", 90: "5 - 31-90", 91: "6 - 91-180", 180: "6 - 91-180",
        181: "7 - 181-360", 360: "7 - 181-360", 361: no, 362: "8 - 361+", None: no,
    }
    df = frame("d int", *[(d,) for d in expected])
    label = labels.gap_label(F.col("d"), labels.CONVERSION_GAPS, labels.NOT_CONVERTED)
    assert dict(df.select("d", label).collect()) == expected


def test_keys(frame):
    df = frame("id string", ("12",), ("007",), ("a12",), ("12\n",), ("",), (None,))
    found = df.select(
        "id", keys.digits_only("id"), keys.int_key("id"), keys.int_text_key("id")
    ).collect()
    assert {row[0]: tuple(row)[1:] for row in found} == {
        "12": (True, 12, "12"),
        "007": (True, 7, "7"),
        "a12": (False, None, None),
        "12\n": (False, 12, "12"),
        "": (False, None, None),
        None: (None, None, None),
    }


def test_lookup_keeps_null_keys_apart(frame):
    left = frame("k string, n int", ("1", 1), ("?2", 2), (None, 3), (None, 4))
    right = frame("k string, v string", ("1", "one"), (None, "never"), ("?2", "two"))
    spread = keys.spread_nulls(left, F.col("k"), ["n"])
    assert spread.select(keys.SPREAD).distinct().count() == 4
    found = keys.lookup(spread, keys.keyed(right, F.col("k"), "v"))
    assert rows_of(found, "n", "v") == [(1, "one"), (2, "two"), (3, None), (4, None)]


def test_latest_identity(frame):
    older, newer, newest = datetime(2023, 1, 1), DAY, datetime(2024, 6, 1)
    df = frame(
        IDENTITY,
        ("g1", MEMBER_KEY, "1", 1, older),
        ("g1", MEMBER_KEY, "2", 1, newer),
        ("g1", MEMBER_KEY, "bad", 1, newest),
        ("g1", MEMBER_KEY, "3", 0, newest),
        ("g1", "other", "4", 1, newest),
        ("g2", MEMBER_KEY, "5", 1, None),
        ("g2", MEMBER_KEY, "6", 1, older),
        ("g3", MEMBER_KEY, "7", 1, newer),
        ("g3", MEMBER_KEY, "8", 1, newer),
        ("g4", MEMBER_KEY, "12\n", 1, newer),
    )
    assert rows_of(identity.latest_identity(df), "gio_id", "member_detail_id") == [
        ("g1", 2),
        ("g2", 5),  # NULL comes first in a descending order
        ("g3", 8),
    ]


def test_all_identities_keeps_every_value(frame):
    df = frame(
        IDENTITY,
        ("g1", MEMBER_KEY, "1", 1, DAY),
        ("g1", MEMBER_KEY, "2", 0, DAY),
        ("g1", "other", "3", 1, DAY),
    )
    assert rows_of(identity.all_identities(df)) == [("g1", "1"), ("g1", "2")]


EVENT = "event_key string, event_time bigint, attributes string, gio_id string"
TAG = "union_id string, wecom_channel_source string"


def seconds(*moment: int) -> int:
    return int((datetime(*moment) - datetime(1970, 1, 1)).total_seconds())


@pytest.fixture
def contact_tables(frame):
    add = contacts.CONTACT_ADD
    noon = seconds(2024, 5, 1, 12)
    events = frame(
        EVENT,
        (add, noon, '{"unionId":"u1","store_codes":"s1","add_way":3}', "g1"),
        (add, noon, "{not json", "g1"),
        (add, noon, '{"other":1}', "g1"),
        (add, noon, '{"unionId":null}', "g1"),
        (add, noon, '{"unionId":"u1"}', "unknown device"),
        (add, seconds(2025, 6, 30, 23, 59, 59), '{"unionId":"u2"}', "g2"),
        (add, seconds(2025, 7, 1), '{"unionId":"u2"}', "g2"),
        ("click", noon, '{"unionId":"u1"}', "g1"),
    )
    ids = frame(IDENTITY, ("g1", MEMBER_KEY, "1", 1, DAY), ("g2", MEMBER_KEY, "x2", 1, DAY))
    tags = frame(TAG, ("u1", contacts.WMP_SCENE), ("u1", "other"), (None, "never"))
    return events, ids, tags


@pytest.mark.parametrize(
    ("text", "union_id", "code"),
    [
        ('{"unionId":"u","code_name":"c"}', "u", "c"),
        ('{"unionId":{"a":[1,{"b":"c"}]},"code_name":[1,"k"]}', '{"a":[1,{"b":"c"}]}', '[1,"k"]'),
        ('{"unionId":7,"code_name":true}', "7", "true"),
        ('{"unionId":"","code_name":null}', "", None),
        ('{"unionId":"é\\u00e9\\"q"}', 'éé"q', None),
        ('{"unionid":"other spelling"}', None, None),
        ('{"outer":{"unionId":"inner"}}', None, None),
        ('{"unionId":"first","unionId":"last"}', "last", None),
        ('{"unionId":"u", broken', None, None),
        ('{"unionId":"u"', None, None),
        ('[{"unionId":"u"}]', None, None),
        ('"unionId"', None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_attributes_are_parsed_once_with_any_text(frame, text, union_id, code):
    events = frame(EVENT, (contacts.CONTACT_ADD, 0, text, "g"))
    ids = frame(IDENTITY, ("g", MEMBER_KEY, "1", 1, DAY))
    found = contacts.contact_adds(events, ids, frame(TAG), AS_OF)
    row = found.first()
    assert (row["unionId"], row["code_name"], row["crm_member_id"]) == (union_id, code, "1")
    expected = contacts.F.get_json_object("attributes", "$.unionId")
    if "first" not in (text or ""):
        assert events.select(expected).first()[0] == union_id
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan


def test_contact_adds(contact_tables):
    found = contacts.contact_adds(*contact_tables, AS_OF)
    assert rows_of(
        found, "unionId", "store_codes", "add_way", "crm_member_id", "latest_wecom_channel_source"
    ) == sorted(
        [
            ("u1", "s1", "3", "1", contacts.WMP_SCENE),
            ("u1", "s1", "3", "1", "other"),
            (None, None, None, "1", None),
            (None, None, None, "1", None),
            (None, None, None, "1", None),
            ("u1", None, None, None, contacts.WMP_SCENE),
            ("u1", None, None, None, "other"),
            ("u2", None, None, "x2", None),
        ],
        key=lambda row: [(v is None, str(v)) for v in row],
    )


def test_adding_years_follow_contact_adds(contact_tables):
    found = contacts.adding_years(*contact_tables, AS_OF)
    assert rows_of(found, "crm_member_id", "add_year", "through_wmp") == [
        ("1", 2024, False),
        ("1", 2024, True),
        ("x2", 2025, False),
    ]


def test_contact_day_follows_the_session_zone(spark, contact_tables):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        found = rows_of(contacts.adding_years(*contact_tables, date(2025, 6, 30)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [("1", 2024, False), ("1", 2024, True)]


def relation_tables(frame):
    relation = frame(
        "external_user_unionid string, staff_ext_id int, relation_created_at timestamp, "
        "relation_source int, relation_deleted int",
        ("u1", 1, DAY, 0, 0),  # counts
        ("u2", 9, DAY, 0, 0),  # staff unknown
        ("u3", 2, DAY, 0, 0),  # no store
        ("u4", 1, DAY, 0, 1),  # deleted
        ("u5", 1, DAY, 0, 0),  # bound in another app
        ("u6", 1, DAY, 0, 0),  # bound by another id type
        (None, 1, DAY, 0, 0),  # no union id
    )
    staff = frame(
        "staff_ext_id int, staff_name string, lego_store_code string, store_name string, "
        "distributor string, partner string, region string, channel string",
        (1, "n", "store1", "s", "d", "p", "r", "c"),
        (2, "n", None, "s", "d", "p", "r", "c"),
    )
    bind = frame(
        "id_type string, thirdparty_app_id int, id_value string, member_detail_id string",
        *[("unionId", 4, f"u{n}", str(n)) for n in range(1, 5)],
        ("unionId", 4, "u1", "01"),
        ("unionId", 3, "u5", "5"),
        ("openId", 4, "u6", "6"),
        ("unionId", 4, None, "7"),
    )
    return relation, staff, bind


def test_current_relations(frame):
    found = contacts.current_relations(*relation_tables(frame))
    assert rows_of(found, "external_user_unionid", "member_detail_id") == [
        ("u1", "01"),
        ("u1", "1"),
        ("u5", None),
        ("u6", None),
        (None, None),
    ]


def test_still_added_counts_spellings(frame):
    found = contacts.still_added(*relation_tables(frame))
    assert rows_of(found, keys.SPREAD, "still_copies") == [("=1", 2)]


LINE = (
    "order_paid_date timestamp, source_channel string, sales_type int, order_type string, "
    "type_name string, type_value string, crm_member_detail_id string, "
    "if_eff_order_tag boolean, sales_qty bigint, is_member_order boolean, "
    "order_rrp_amt decimal(18,2), parent_order_id bigint"
)


def line(**changes):
    values = {
        "paid": datetime(2024, 3, 4, 10),
        "channel": "LCS",
        "sales_type": 1,
        "order_type": "normal",
        "type_name": "CRM_memberid",
        "type_value": "tv1",
        "crm": "1",
        "effective": True,
        "qty": 1,
        "member": True,
        "amount": Decimal("10.00"),
        "order": 1,
    }
    values.update(changes)
    return tuple(values.values())


def test_which_orders_count(frame):
    lines = frame(
        LINE,
        line(order=1),
        line(order=2, sales_type=3),
        line(order=3, sales_type=None),
        line(order=4, channel="TMALL", sales_type=3),
        line(order=5, channel="TMALL", order_type="presale"),
        line(order=6, channel="DOUYIN_B2B", order_type=None),
        line(order=7, channel="OTHER"),
        line(order=8, paid=datetime(2025, 6, 30, 23, 59)),
        line(order=9, paid=datetime(2025, 7, 1)),
        line(order=10, paid=None),
        line(order=11, channel="DOUYIN"),
    )

    def kept(*channels):
        found = lines.filter(orders.counts_as_order(AS_OF, *channels))
        return sorted(row.parent_order_id for row in found.collect())

    assert kept() == [1, 4, 8, 11]
    assert kept(["LCS"]) == [1, 8]


def test_omni_ids_and_distinct_lines(frame):
    crm_map = frame("id bigint, member_id bigint", (100, 1), (None, 2), (300, None))
    lines = frame(
        LINE,
        line(order=1),
        line(order=1),
        line(order=2, crm="2"),
        line(order=3, crm="3", type_name="DY_openid"),
        line(order=4, type_name="other"),
        line(order=5, crm=None, type_name="TMALL_kyid", type_value=None),
        line(order=6, type_name=None),
        line(order=7, crm="01"),
    )
    found = orders.distinct_lines(lines, crm_map, AS_OF)
    assert rows_of(found, "parent_order_id", "omni_channel_member_id") == [
        (1, "100"),
        (2, "tv1"),
        (3, "tv1"),
        (4, None),
        (5, None),
        (6, None),
        (7, "tv1"),
    ]
    buyers = orders.lcs_buyers(lines, crm_map, AS_OF)
    assert rows_of(buyers) == [("100",), ("tv1",)]


def test_merged_lines_know_how_many_they_are(frame):
    """Each line counts in one row, however many ids it is mapped to, equal map entries aside."""
    crm_map = frame("id bigint, member_id bigint", (100, 1), (200, 1), (100, 1), (None, 1), (None, 1), (None, 2), (None, 2), (3, None))
    lines = frame(LINE, line(), line(), line(), line(crm="2"), line(crm=None), line(crm=None), line(order=2))
    found = orders.distinct_lines(lines, crm_map, AS_OF)
    rows = rows_of(found, "parent_order_id", "omni_channel_member_id", "copies")
    assert sum(r[2] for r in rows) == 7
    assert [r for r in rows if r[0] == 2] == [(2, "100", 0), (2, "200", 0), (2, "tv1", 1)]
    assert [r for r in rows if r[0] == 1] == [(1, "100", 0), (1, "200", 0), (1, "tv1", 6)]


def test_buying_years_want_effective_orders(frame):
    crm_map = frame("id bigint, member_id bigint", (100, 1))
    lines = frame(
        LINE,
        line(),
        line(paid=datetime(2023, 1, 1), channel="TMALL"),
        line(paid=datetime(2022, 1, 1), effective=False),
        line(paid=datetime(2021, 1, 1), effective=None),
    )
    distinct = orders.distinct_lines(lines, crm_map, AS_OF)
    for found in [
        orders.buying_years(lines, crm_map, AS_OF),
        orders.buying_years_of(distinct),
    ]:
        assert rows_of(found, "omni_channel_member_id", "buy_year", "source_channel") == [
            ("100", 2023, "TMALL"),
            ("100", 2024, "LCS"),
        ]


def net_sales(df, money: Money):
    sums = df.groupBy().agg(*money.sums(), *money.sums(members_only=True))
    row = sums.groupBy().agg(money.net(ALL_SALES), money.net(MEMBER_SALES)).first()
    return tuple(row)


def test_net_sales(frame):
    amounts = [(2, "10.00"), (-1, "4.00"), (0, "5.00"), (None, "5.00"), (-1, "-1.00")]
    df = frame(
        LINE,
        *[line(qty=q, amount=Decimal(a)) for q, a in amounts],
        line(qty=1, amount=Decimal("7.77"), member=False),
        line(qty=1, amount=None),
    )
    assert net_sales(df, Money.of(df)) == (Decimal("12.77"), Decimal("5.00"))


def test_net_sales_of_unknown_amounts(frame):
    known = frame(LINE, line(qty=1, amount=None))
    assert net_sales(known, Money()) == (None, None)
    mixed = frame(LINE, line(qty=1, amount=None), line(qty=-1, amount=None))
    assert net_sales(mixed, Money()) == (Decimal(0), Decimal(0))


def test_money_keeps_the_scale_of_the_column(spark):
    df = spark.sql("SELECT cast(1.2345 AS decimal(18,4)) AS order_rrp_amt")
    money = Money.of(df)
    assert money == Money(DecimalType(18, 4)) and money.narrow
    units = df.select(money.units(F.col("order_rrp_amt")).alias("u"))
    assert units.first().u == 12345
    assert units.select(money.amount(F.col("u"))).first()[0] == Decimal("1.2345")


@pytest.mark.parametrize(
    ("kind", "amount", "copies", "total"),
    [
        ("double", "0.004", 1000, 4.0),
        ("decimal(38,12)", "1234567890.5", 3, 3703703671.5),
        ("decimal(38,12)", "-12345678901234567890123456.000000000001", 1, -1.2345678901234567e25),
        ("decimal(38,8)", "0.00000001", 7, 7e-8),
        ("decimal(38,0)", "9" * 30, 2, 2e30),
        ("decimal(18,6)", "999999999999.999999", 4, 3999999999999.999996),
        ("bigint", "9007199254740993", 2, 18014398509481986.0),
    ],
)
def test_money_of_any_type_is_not_rounded(spark, kind, amount, copies, total):
    df = spark.range(copies).select(
        F.lit(1).alias("sales_qty"),
        F.lit(True).alias("is_member_order"),
        F.lit(amount).cast(kind).alias("order_rrp_amt"),
    )
    money = Money.of(df)
    sums = df.groupBy().agg(*money.sums())
    assert float(sums.groupBy().agg(money.net(ALL_SALES)).first()[0]) == pytest.approx(total, rel=1e-15)
    units = sums.select(F.col(ALL_SALES[0]).cast("string")).first()[0]
    with localcontext(prec=60):
        assert Decimal(units) == Decimal(amount) * copies * 10**money.kind.scale


@pytest.mark.parametrize("kind", ["double", "float", "string"])
def test_amounts_that_do_not_fit_are_unknown_and_counted(spark, kind):
    """NaN, infinite, or 10**26 and more: like NULL in the sums, and none is silent."""
    amounts = ["1.5", "NaN", "Infinity", "-Infinity", "1e27", "-1e26", None, "2.5", "9e25"]
    rows = spark.createDataFrame([(1, True, a) for a in amounts], "sales_qty int, is_member_order boolean, a string")
    df = rows.select("sales_qty", "is_member_order", F.col("a").cast(kind).alias("order_rrp_amt"))
    money = Money.of(df)
    small = df.filter("coalesce(order_rrp_amt, '0') <> '9e25'") if kind == "string" else df.filter("order_rrp_amt is null or order_rrp_amt < 5 or order_rrp_amt > 1e26 or isnan(order_rrp_amt)")
    assert net_sales(small, money) == (4.0, 4.0)
    assert df.agg(money.rejected()).first()[0] == 5
    only = df.filter("order_rrp_amt is null")
    assert net_sales(only, money) == (None, None) and only.agg(money.rejected()).first()[0] == 0


def test_exact_amounts_are_never_rejected(spark):
    for kind in ("decimal(18,2)", "decimal(38,0)", "bigint"):
        df = spark.sql(f"SELECT cast('9999999999999999' AS {kind}) AS order_rrp_amt")
        assert df.agg(Money.of(df).rejected()).first()[0] == 0


def test_ratio_and_zero_to_null(frame):
    df = frame("a bigint, b bigint", (1, 3), (1, 0), (None, 1))
    found = df.select(ratio(F.col("a"), F.col("b")), zero_to_null(F.col("b"))).collect()
    assert [tuple(row) for row in found] == [(1 / 3, 3), (None, None), (None, 1)]


def test_qualifying_purchases(frame):
    day = date(2024, 1, 2)
    df = frame(
        "crm_member_id string, date_id date, is_rrp_sales_type int, distributor_name string, "
        "if_eff_order_tag boolean, initial_vs_repurchase_lifecycle string",
        ("1", day, 1, "D1", True, purchases.FIRST_PURCHASE),
        ("1", day, 1, "D1", True, "repeat"),
        ("01", day, 1, "D1", True, "repeat"),
        ("2", day, 0, "D1", True, "repeat"),
        ("3", day, 1, "LBR", True, "repeat"),
        ("4", day, 1, None, True, "repeat"),
        ("5", day, 1, "D1", None, "repeat"),
    )
    assert rows_of(purchases.purchase_days(df)) == [("01", day), ("1", day)]
    assert rows_of(purchases.purchase_years(df)) == [(1, [2024])]
    assert rows_of(purchases.first_purchase_days(df)) == [(1, day)]


def test_repeated_keys(frame):
    df = frame("k string", ("a",), ("a",), ("b",), (None,))
    assert rows_of(repeated_keys(df, "k")) == [("a", 2)]


def test_key_report(frame):
    _, staff, _ = relation_tables(frame)
    member = frame(
        "member_detail_id string, join_time timestamp, eff_reg_channel string",
        ("7", DAY, "LCS"),
        ("007", DAY, "LCS"),
        (None, DAY, "LCS"),
        (None, DAY, "LCS"),
    )
    tables = from_frames(
        {
            "member": member,
            "crm_map": frame("id bigint, member_id bigint", (1, 1)),
            "contact_tag": frame(TAG, ("u1", "a"), ("u1", "b")),
            "staff": staff,
        }
    )
    assert rows_of(key_report(tables)) == [
        ("contact_tag", 1, 2),
        ("crm_map", 0, 0),
        ("member", 1, 2),
        ("staff", 0, 0),
    ]


def test_missing_columns_are_named(frame):
    tables = from_frames({"crm_map": frame("id bigint", (1,))})
    with pytest.raises(ValueError, match="member_id"):
        tables["crm_map"]


def test_shuffles_follow_the_size_of_the_input(spark):
    assert spark.conf.get(INITIAL_PARTITIONS, None) is None
    try:
        configure(spark)
        assert spark.conf.get(INITIAL_PARTITIONS, None) is None
        configure(spark, input_bytes=1000 * PARTITION_BYTES + 1)
        assert spark.conf.get(INITIAL_PARTITIONS) == "1001"
        configure(spark, input_bytes=1)
        assert spark.conf.get(INITIAL_PARTITIONS) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)


@pytest.mark.parametrize(
    ("given", "kept"),
    [("64MB", f"{TASK_BYTES}b"), ("67108864b", f"{TASK_BYTES}b"), ("1g", f"{TASK_BYTES}b"), ("8m", "8m"),
     ("16k", "16k"), ("1048576", "1048576")],
)
def test_merged_partitions_are_bounded(spark, given, kept):
    before = spark.conf.get(ADVISED_BYTES)
    try:
        spark.conf.set(ADVISED_BYTES, given)
        configure(spark)
        assert spark.conf.get(ADVISED_BYTES) == kept
    finally:
        spark.conf.set(ADVISED_BYTES, before)


def test_no_task_merges_very_many_lines(spark):
    """About 40 MB of shuffled lines do not meet in one task, though all would fit into 64 MB."""
    settings = {
        ADVISED_BYTES: "64MB",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    draw = F.xxhash64("id")
    lines = spark.range(0, 1_000_000, 1, 4).select(
        F.lit(DAY).alias("order_paid_date"),
        F.lit("LCS").alias("source_channel"),
        F.lit(1).alias("sales_type"),
        F.lit("normal").alias("order_type"),
        F.lit("CRM_memberid").alias("type_name"),
        draw.cast("string").alias("type_value"),
        F.lit(None).cast("string").alias("crm_member_detail_id"),
        F.lit(True).alias("if_eff_order_tag"),
        F.lit(1).cast("bigint").alias("sales_qty"),
        F.lit(True).alias("is_member_order"),
        F.pmod(draw, F.lit(10**6)).cast("decimal(18,2)").alias("order_rrp_amt"),
        F.xxhash64(draw).alias("parent_order_id"),
    )
    crm_map = spark.createDataFrame([], "id bigint, member_id bigint")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        configure(spark)
        found = orders.distinct_lines(lines, crm_map, AS_OF).rdd
        assert found.getNumPartitions() > 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_the_clock_is_the_sessions(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "+14:00")
        east = now(spark)
        spark.conf.set("spark.sql.session.timeZone", "-10:00")
        assert timedelta(hours=23, minutes=59) < east - now(spark) <= timedelta(hours=24)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def rows_out_of_joins(plan) -> list[int]:
    """The row counts of all joins of a plan that has run, stages and all."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_out_of_joins(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return rows_out_of_joins(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    below = plan.children()
    return own + [n for k in range(below.size()) for n in rows_out_of_joins(below.apply(k))]


def test_a_shared_device_does_not_pair_members_with_union_ids(frame):
    n = 200
    event = ("external_user_add", int(DAY.timestamp()))
    events = [(*event, f'{{"unionId":"u{k}"}}', "g") for k in range(n)]
    owners = [("g", MEMBER_KEY, str(k), 1, DAY) for k in range(n)]
    adds = contacts.adding_years(
        frame("event_key string, event_time bigint, attributes string, gio_id string", *events),
        frame(IDENTITY, *owners),
        frame("union_id string, wecom_channel_source string", ("u1", "乐高小程序")),
        AS_OF,
    )
    assert len(adds.collect()) == 2 * n
    made = rows_out_of_joins(adds._jdf.queryExecution().executedPlan())
    assert len(made) == 2 and max(made) <= 2 * n


def test_ids_beyond_64_bits_are_reported(frame):
    ids = {"member": "member_detail_id", "identity": "prop_value", "member_order": "crm_member_id",
           "thirdparty_bind": "member_detail_id", "crm_map": "id"}
    rows = [("9" * 25,), ("7",), ("x",), (None,)]
    tables = {role: frame(f"{c} string", *rows) for role, c in ids.items()}
    assert {tuple(r) for r in lost_keys(tables).collect()} == {(role, 1) for role in ids}
