"""Blocks that several marts start from.

A mart builds them from the inputs, or reads what a full run has written once: that
saves scanning the order lines and the event log again for every mart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from memberlens.operators import contacts, orders, visits
from memberlens.sources.tables import Tables

_ORDERS = ("order_line", "crm_map")
_CONTACTS = ("contact_event", "identity", "contact_tag")
_RELATIONS = ("staff_relation", "staff", "thirdparty_bind")


def _visit_years(tables: Tables, as_of: date) -> DataFrame:
    return visits.member_years(tables["visit_log"])


def _lines(tables: Tables, as_of: date) -> DataFrame:
    return orders.distinct_lines(**tables.pick(*_ORDERS), as_of=as_of)


def _buyers(tables: Tables, as_of: date) -> DataFrame:
    if "lines" in tables:
        return orders.buying_years_of(tables["lines"])
    return orders.buying_years(**tables.pick(*_ORDERS), as_of=as_of)


def _contact_adds(tables: Tables, as_of: date) -> DataFrame:
    return contacts.adding_years(**tables.pick(*_CONTACTS), as_of=as_of)


def _still_added(tables: Tables, as_of: date) -> DataFrame:
    return contacts.still_added(**tables.pick(*_RELATIONS))


BLOCKS: dict[str, Callable[[Tables, date], DataFrame]] = {
    "visit_years": _visit_years,
    "lines": _lines,
    "buyers": _buyers,
    "contact_adds": _contact_adds,
    "still_added": _still_added,
}

#: Blocks that all their marts join by one key, which has few rows there: written clustered by it.
CLUSTERED = {"visit_years": "member_detail_id"}


def resolve(tables: Tables, roles: tuple[str, ...], as_of: date) -> dict[str, DataFrame]:
    """The tables of these roles, with blocks built where none is written."""
    return {
        role: BLOCKS[role](tables, as_of)
        if role in BLOCKS and role not in tables
        else tables[role]
        for role in roles
    }
