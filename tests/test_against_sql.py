"""Every registered query against its SQL, on the test data and on hostile tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import AS_OF, LOAD_TIME, duck_rows, rows_of

import __spark_entry__ as entry_points
from memberlens.plans.marts import MARTS, VISIT_LOG
from memberlens.sources.tables import SOURCE_TABLES, from_frames
from memberlens.verification import oracle, registered

SMALL = "/root/testdata/sf0.001"
RAW = ["customer", "supplier", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def raw_tables():
    con = duckdb.connect()
    for name in RAW:
        con.sql(f"CREATE VIEW {name} AS FROM '{SMALL}/{name}.parquet'")
    return con


#: The marts and blocks; the training-data operators have tests of their own.
OWN = sorted(registered.queries(AS_OF, LOAD_TIME))


@pytest.mark.parametrize("name", OWN)
def test_on_test_data(spark, raw_tables, name):
    result = entry_points.queries()[name](spark, SMALL)
    expected = raw_tables.sql(entry_points.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    found = rows_of(result)
    assert found
    assert found == duck_rows(expected, result.columns)


def test_every_query_has_sql():
    assert set(OWN) <= set(entry_points.queries()) & set(entry_points.oracle_sql())


IDS = ["1", "2", "3", "4", "5", "6", "7", "007", "x8", None]
UNIONS = ["u1", "u2", "u3", "u4", None]
DEVICES = ["g1", "g2", "g3", "g4", "g5", "g6", None]
CHANNELS = ["BRANDWMP", "BRANDWMP", "LCS_STORE", "X_LCS_Y", "WMP_LCS", "DOUYIN", None]


def hostile_tables(seed: int) -> dict[str, pa.Table]:
    """Few keys, many NULLs, repeated and misspelt ids, repeated rows."""
    rng = random.Random(seed)
    pick = rng.choice

    def moment():
        start = datetime(2021, 12, 20)
        return pick([None, start + timedelta(minutes=rng.randrange(60 * 24 * 1300))])

    def sure_moment():
        return moment() or datetime(2024, 12, 31, 23, 59)

    def seconds():
        return int((sure_moment() - datetime(1970, 1, 1)).total_seconds())

    def amount():
        return pick([None, *[Decimal(rng.randrange(-500, 5000)).scaleb(-2) for _ in range(6)]])

    def table(count: int, **columns):
        """Columns map to (type, maker); about one row in eight is repeated."""
        rows = [[make() for _, make in columns.values()] for _ in range(count)]
        rows += [pick(rows) for _ in range(count // 8)]
        arrays = [
            pa.array([row[i] for row in rows], kind)
            for i, (kind, _) in enumerate(columns.values())
        ]
        return pa.table(dict(zip(columns, arrays, strict=True)))

    text, long, flag, ts = pa.string(), pa.int64(), pa.bool_(), pa.timestamp("us")
    yes_no = lambda: pick([True, True, True, False, None])
    attributes = [
        '{"unionId":"u1","add_way":7}', '{"unionId":"u2"}', '{"unionId":"u3","code_name":null}',
        '{"unionId":null}', '{"other":1}', "{bad", None,
    ]
    return {
        "member": table(
            12,
            member_detail_id=(text, lambda: pick(IDS)),
            join_time=(ts, moment),
            eff_reg_channel=(text, lambda: pick(CHANNELS)),
        ),
        "order_line": table(
            250,
            order_paid_date=(ts, moment),
            source_channel=(text, lambda: pick(["LCS", "LCS", "LCS", "TMALL", "DOUYIN",
                                                "DOUYIN_B2B", "OTHER"])),
            sales_type=(long, lambda: pick([0, 1, 2, 3, None])),
            order_type=(text, lambda: pick(["normal", "normal", "presale", None])),
            type_name=(text, lambda: pick(["CRM_memberid", "DY_openid", "TMALL_kyid", "x", None])),
            type_value=(text, lambda: pick(IDS)),
            crm_member_detail_id=(text, lambda: pick(IDS)),
            if_eff_order_tag=(flag, yes_no),
            sales_qty=(long, lambda: pick([-2, -1, 0, 1, 2, 3, None])),
            is_member_order=(flag, yes_no),
            order_rrp_amt=(pa.decimal128(18, 2), amount),
            parent_order_id=(long, lambda: pick([None, *range(1, 40)])),
            original_order_id=(long, lambda: pick([None, *range(1, 40)])),
            payment_type=(text, lambda: pick(["WOS企微小程序-新场景", "other", None])),
        ),
        "crm_map": table(
            8,
            id=(long, lambda: rng.randrange(1, 9)),
            member_id=(long, lambda: pick([None, *range(1, 8)])),
        ),
        "member_order": table(
            60,
            crm_member_id=(text, lambda: pick(IDS)),
            date_id=(pa.date32(), lambda: sure_moment().date()),
            is_rrp_sales_type=(long, lambda: pick([0, 1, 1, 1, None])),
            distributor_name=(text, lambda: pick(["D1", "D1", "D1", "LBR", None])),
            if_eff_order_tag=(flag, yes_no),
            initial_vs_repurchase_lifecycle=(
                text, lambda: pick(["会员生命周期首单", "repeat", None])
            ),
        ),
        "contact_event": table(
            40,
            event_key=(text, lambda: pick(["external_user_add", "external_user_add", "x"])),
            event_time=(long, seconds),
            attributes=(text, lambda: pick(attributes)),
            gio_id=(text, lambda: pick(DEVICES)),
        ),
        "identity": table(
            20,
            gio_id=(text, lambda: pick(DEVICES)),
            prop_key=(text, lambda: pick(["id_CRM_memberid"] * 5 + ["x", None])),
            prop_value=(text, lambda: pick([*IDS, "12\n", ""])),
            sign=(long, lambda: pick([1, 1, 1, 0, None])),
            update_time=(ts, lambda: pick([None, datetime(2024, 1, 1), moment()])),
        ),
        "page_view": table(
            200,
            gio_id=(text, lambda: pick(DEVICES)),
            event_time=(ts, moment),
            page_type=(text, lambda: pick(["home", "shop", "game", None])),
        ),
        "contact_tag": table(
            6,
            union_id=(text, lambda: pick(UNIONS)),
            wecom_channel_source=(text, lambda: pick(["乐高小程序", "other", None])),
        ),
        "staff_relation": table(
            12,
            external_user_unionid=(text, lambda: pick(UNIONS)),
            staff_ext_id=(long, lambda: pick([1, 2, 3, 4, None])),
            relation_created_at=(ts, moment),
            relation_source=(long, lambda: pick([0, 1])),
            relation_deleted=(long, lambda: pick([0, 0, 1, None])),
        ),
        "staff": table(
            4,
            staff_ext_id=(long, lambda: pick([1, 2, 3, None])),
            **{
                c: (text, lambda: pick(["a", "b", None]))
                for c in ["staff_name", "lego_store_code", "store_name", "distributor",
                          "partner", "region", "channel"]
            },
        ),
        "thirdparty_bind": table(
            10,
            id_type=(text, lambda: pick(["unionId", "unionId", "unionId", "openId"])),
            thirdparty_app_id=(long, lambda: pick([4, 4, 4, 3])),
            id_value=(text, lambda: pick(UNIONS)),
            member_detail_id=(text, lambda: pick(IDS)),
        ),
        "ec_history": table(
            30,
            belong_type=(text, lambda: pick(["registerOrBind", "registerOrBind", "x"])),
            eff_belong_channel=(text, lambda: pick(["TMall", "Douyin", "x", None])),
            member_detail_id=(text, lambda: pick(["1", None])),
            platform_id_value=(text, lambda: pick(["p1", "p2", "p3", "p4", None])),
        ),
        "order_scenario": table(
            40,
            parent_order_id=(long, lambda: pick([None, *range(1, 40)])),
            order_scenario=(text, lambda: pick(["Organic", "Organic", "Staff", None])),
        ),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_on_hostile_tables(spark, tmp_path, seed):
    con = duckdb.connect()
    frames = {}
    made = hostile_tables(seed)
    assert set(made) == set(SOURCE_TABLES)
    for role, rows in made.items():
        path = f"{tmp_path}/{role}.parquet"
        pq.write_table(rows, path)
        con.sql(f"CREATE VIEW {role} AS FROM '{path}'")
        frames[role] = spark.read.parquet(path)
    tables = from_frames(frames)
    tables = tables.with_table("visit_log", VISIT_LOG(tables).cache())
    expected = oracle.statements(AS_OF, LOAD_TIME, inputs=None)
    for mart in MARTS:
        result = mart(tables, AS_OF, LOAD_TIME)
        wanted = duck_rows(con.sql(expected[mart.build.__name__]), result.columns)
        assert rows_of(result) == wanted, mart.table
    for name, block in registered.blocks(AS_OF).items():
        result = block(tables)
        wanted = duck_rows(con.sql(expected[f"block_{name}"]), result.columns)
        assert rows_of(result) == wanted, name

