"""All marts: their inputs, the order to run them in, and their output table names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from memberlens.plans import funnel_marts, sales_marts, shared, visit_marts
from memberlens.session import now
from memberlens.sources.tables import Tables


@dataclass(frozen=True)
class Mart:
    """A mart and what it takes; ``table`` is its output name without a prefix."""

    table: str
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    takes_as_of: bool = False
    takes_load_time: bool = False

    def __call__(
        self, tables: Tables, as_of: date | None = None, load_time: datetime | None = None
    ) -> DataFrame:
        """The mart as of a day and a load time; today and now, in the session's time zone."""
        if as_of is None or (load_time is None and self.takes_load_time):
            clock_now = now(SparkSession.active())
            as_of, load_time = as_of or clock_now.date(), load_time or clock_now
        clock = {}
        if self.takes_as_of:
            clock["as_of"] = as_of
        if self.takes_load_time:
            clock["load_time"] = load_time
        return self.build(**shared.resolve(tables, self.inputs, as_of), **clock)


# Output table names. The log comes first, eight others read it.
VISIT_LOG = Mart(
    "wmp_member_visits_log", visit_marts.member_visits_log, ("page_view", "identity", "member")
)
MARTS = [
    VISIT_LOG,
    Mart("wmp_visits_by_visits_year", visit_marts.visitors_by_year, ("visit_years", "member")),
    Mart(
        "wmp_avg_visits_by_visits_year", visit_marts.average_visit_days, ("visit_years", "member")
    ),
    Mart(
        "wmp_visits_count_distribution_by_visits_year",
        visit_marts.visit_day_distribution,
        ("visit_years", "member"),
    ),
    Mart("wmp_revisit_member_count", visit_marts.revisiting_members, ("visit_years", "member")),
    Mart("wmp_revisit_time_diff", visit_marts.revisit_gaps, ("visit_years", "member")),
    Mart(
        "wmp_visits_by_visits_year_then_YTD_converted",
        visit_marts.same_year_buyers,
        ("visit_years", "member_order", "member"),
    ),
    Mart(
        "wmp_visits_content_converted_vs_non_converted",
        visit_marts.page_penetration,
        ("visit_log", "member_order", "member"),
    ),
    Mart(
        "wmp_visits_ltd",
        visit_marts.registered_and_visited,
        ("visit_years", "member", "ec_history"),
        takes_load_time=True,
    ),
    Mart(
        "wmp_member_0_1_by_days_since_reg",
        funnel_marts.days_to_first_purchase,
        ("member", "member_order"),
    ),
    Mart(
        "wmp_member_converted",
        funnel_marts.conversion_by_cohort,
        ("member", "buyers", "contact_adds"),
    ),
    Mart(
        "wmp_recruit",
        funnel_marts.recruitment_funnel,
        ("member", "buyers", "contact_adds", "still_added"),
    ),
    Mart(
        "wmp_reg_member_converted_by_transaction_year",
        sales_marts.registrant_sales,
        ("lines", "member"),
    ),
    Mart(
        "add_wecom",
        funnel_marts.contact_adders_by_year,
        ("contact_adds", "still_added", "member", "buyers"),
    ),
    Mart(
        "add_wecom_member_converted_by_transaction_year",
        sales_marts.contact_adder_sales,
        ("lines", "contact_adds", "still_added"),
    ),
    Mart(
        "wos_converted_through_wmp_by_transaction_year",
        sales_marts.assistant_sales,
        ("order_line", "crm_map", "member", "order_scenario"),
        takes_as_of=True,
    ),
]
BY_TABLE = {mart.table: mart for mart in MARTS}
