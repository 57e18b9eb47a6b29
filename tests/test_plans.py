"""Physical plans: what the marts must not contain, and what must reach the scans."""

from __future__ import annotations

import contextlib
import io
import re

import pyarrow.parquet as pq
import pytest
from conftest import AS_OF, LOAD_TIME, rows_of
from test_against_sql import hostile_tables

from memberlens.operators import contacts
from memberlens.operators.visits import member_years
from memberlens.plans.marts import MARTS, VISIT_LOG
from memberlens.sinks.clustered import ClusteredTables
from memberlens.sources.tables import from_frames

BY_NAME = {mart.build.__name__: mart for mart in MARTS}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    frames = {}
    for role, rows in hostile_tables(0).items():
        pq.write_table(rows, f"{folder}/{role}.parquet")
        frames[role] = spark.read.parquet(f"{folder}/{role}.parquet")
    given = from_frames(frames)
    VISIT_LOG(given).write.parquet(f"{folder}/visit_log.parquet")
    return given.with_table("visit_log", spark.read.parquet(f"{folder}/visit_log.parquet"))


@pytest.fixture
def clustered(spark, tables, tmp_path):
    """The tables of a full run, whose members' years are written by member."""
    work = ClusteredTables(spark, str(tmp_path / "work"))
    years = work.write("visit_years", member_years(tables["visit_log"]), "member_detail_id")
    yield tables.with_table("visit_years", years)
    work.remove()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when every table is large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df, mode="formatted") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def mart_plan(tables, name: str, mode="formatted") -> str:
    return plan_of(BY_NAME[name](tables, AS_OF, LOAD_TIME), mode)


def scans(plan: str, role: str) -> list[str]:
    """The scan details of one input, one text per scan."""
    return [
        block
        for block in re.split(r"\n\n", plan)
        if block.lstrip().startswith("(") and f"/{role}.parquet" in block
    ]


@pytest.mark.parametrize("name", sorted(BY_NAME))
def test_no_mart_multiplies_rows_or_leaves_the_jvm(tables, no_broadcast, name):
    plan = mart_plan(tables, name)
    for unwanted in ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas",
                     "Exchange SinglePartition"]:
        assert unwanted not in plan
    assert "Arguments: SinglePartition" not in plan


@pytest.mark.parametrize(
    "name",
    ["conversion_by_cohort", "recruitment_funnel", "registrant_sales", "assistant_sales",
     "contact_adders_by_year", "revisiting_members", "page_penetration"],
)
def test_many_counts_do_not_expand_rows(tables, name):
    assert not re.search(r"\bExpand\b", mart_plan(tables, name))


@pytest.mark.parametrize(
    ("name", "role", "count"),
    [
        ("conversion_by_cohort", "order_line", 1),
        ("recruitment_funnel", "order_line", 1),
        ("registrant_sales", "order_line", 1),
        ("contact_adders_by_year", "order_line", 1),
        ("contact_adder_sales", "order_line", 1),
        ("assistant_sales", "order_line", 1),
        ("page_penetration", "visit_log", 1),
        ("recruitment_funnel", "contact_event", 1),
        ("member_visits_log", "page_view", 1),
    ],
)
def test_large_inputs_are_read_once(tables, no_broadcast, name, role, count):
    assert len(scans(mart_plan(tables, name), role)) == count


def test_order_scan_reads_what_it_needs(tables):
    (scan,) = scans(mart_plan(tables, "recruitment_funnel"), "order_line")
    assert "LessThan(order_paid_date" in scan
    assert "EqualTo(source_channel,LCS)" in scan
    assert "EqualTo(if_eff_order_tag,true)" in scan
    assert "sales_qty" not in scan
    assert "payment_type" not in scan


def test_event_scan_skips_later_events(tables):
    adds = contacts.adding_years(**tables.pick("contact_event", "identity", "contact_tag"),
                                 as_of=AS_OF)
    (scan,) = scans(plan_of(adds), "contact_event")
    assert "EqualTo(event_key,external_user_add)" in scan
    assert re.search(r"LessThan\(event_time,\d+\)", scan)


def test_log_readers_read_two_columns(tables):
    (scan,) = scans(mart_plan(tables, "average_visit_days"), "visit_log")
    assert "ReadSchema: struct<member_detail_id:bigint,event_time:timestamp_ntz>" in scan


def test_gaps_use_one_window(tables, no_broadcast):
    plan = mart_plan(tables, "revisit_gaps", "simple")
    assert len(re.findall(r"\+- Window ", plan)) == 1
    by_member = re.findall(r"Exchange hashpartitioning\(member_detail_id#\d+L?, \d+\)", plan)
    assert len(by_member) == 2  # the members' years and the member dimension


OVER_YEARS = ["visitors_by_year", "average_visit_days", "visit_day_distribution",
              "revisiting_members", "revisit_gaps", "same_year_buyers",
              "registered_and_visited"]


@pytest.mark.parametrize("name", OVER_YEARS)
def test_written_years_of_members_are_not_shuffled(clustered, no_broadcast, name):
    """Only what joins them is, and the cells they end in."""
    plan = mart_plan(clustered, name)
    assert "memberlens_" in plan
    blocks = [b for b in re.split(r"\n\n", plan) if re.match(r"\(\d+\) Exchange", b.lstrip())]
    assert blocks
    years = {"visit_year", "visit_days", "first_day"}
    for block in blocks:
        columns = set(re.findall(r"(\w+)#\d+", re.search(r"Input \[\d+\]: \[(.*)\]", block)[1]))
        assert not ("member_detail_id" in columns and years & columns), block
    if name == "registered_and_visited":
        joins = [b for b in re.split(r"\n\n", plan) if "SortMergeJoin" in b and "member_detail_id" in b]
        assert joins


@pytest.mark.parametrize("name", OVER_YEARS)
def test_clustered_years_give_the_same_rows(tables, clustered, name):
    expected = BY_NAME[name](tables, AS_OF, LOAD_TIME)
    assert rows_of(BY_NAME[name](clustered, AS_OF, LOAD_TIME)) == rows_of(expected)


def test_years_of_members_are_one_aggregation(tables, no_broadcast):
    """Merged before their only shuffle, with no distinct days in between."""
    plan = plan_of(member_years(tables["visit_log"]), "simple")
    assert len(re.findall(r"Exchange", plan)) == 1 and len(re.findall(r"HashAggregate", plan)) == 2


def test_member_flags_need_no_further_shuffle(tables, no_broadcast):
    """Registrants, adders, relations and buyers meet on one key; then years are counted."""
    plan = mart_plan(tables, "recruitment_funnel", "simple")
    assert len(re.findall(r"Exchange hashpartitioning\(reg_year#\d+, \d+\)", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\(reg_year#\d+, member_detail_id", plan)


def test_order_lines_are_shuffled_twice(tables, no_broadcast):
    """Once for their ids, once by member and order; equal lines and sums meet there."""
    plan = mart_plan(tables, "registrant_sales")
    blocks = [b for b in re.split(r"\n\n", plan) if re.match(r"\(\d+\) Exchange", b.lstrip())]
    line_scale = [b for b in blocks if "sales_qty" in b]
    assert len(line_scale) == 2, line_scale


def test_views_are_shuffled_once(tables, no_broadcast):
    plan = mart_plan(tables, "member_visits_log")
    blocks = [b for b in re.split(r"\n\n", plan) if re.match(r"\(\d+\) Exchange", b.lstrip())]
    assert len([b for b in blocks if "page_type" in b]) == 1
