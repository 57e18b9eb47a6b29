"""Reports on the inputs: on request, and while the marts run. Nothing is repaired.

A run that is watched counts what it reads where it reads it: after the filters that reach
the scan and before the first shuffle, as metrics of the jobs that run anyway. No input is read for it.
"""

from __future__ import annotations

from contextvars import ContextVar
from threading import Thread

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from memberlens.functions.keys import digits_only, int_key, int_text_key, text_key
from memberlens.sources.tables import Tables


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values on more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def key_report(tables: Tables) -> DataFrame:
    """How many keys repeat in the tables where a repeat multiplies sums or labels."""
    looked_up = {
        "member": int_text_key("member_detail_id"),
        "crm_map": text_key("member_id"),
        "contact_tag": text_key("union_id"),
        "staff": text_key("staff_ext_id"),
    }
    reports = [
        repeated_keys(tables[role].select(key.alias("key")), "key")
        .filter(F.col("key").isNotNull())
        .agg(F.count("*").alias("repeated_keys"), F.sum("rows").alias("rows"))
        .select(
            F.lit(role).alias("input"), "repeated_keys", F.coalesce("rows", F.lit(0)).alias("rows")
        )
        for role, key in looked_up.items()
    ]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


def lost_keys(tables: Tables) -> DataFrame:
    """How many ids are all digits, yet beyond 64 bits: they join nothing."""
    ids = {
        "member": "member_detail_id",
        "identity": "prop_value",
        "member_order": "crm_member_id",
        "thirdparty_bind": "member_detail_id",
        "crm_map": "id",
    }
    reports = [
        tables[role]
        .select(F.col(column).cast("string").alias("id"))
        .filter(digits_only("id") & int_key("id").isNull())
        .agg(F.count("*").alias("rows"))
        .select(F.lit(role).alias("input"), "rows")
        for role, column in ids.items()
    ]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


_watching: ContextVar[Watch | None] = ContextVar("watching", default=None)


class Watch:
    """What the jobs inside ``with Watch() as watch`` read, counted once for each input."""

    #: Seconds to wait for counts of a job that has ended: they come after it.
    PATIENCE = 30

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def __enter__(self) -> Watch:
        self._before = _watching.set(self)
        return self

    def __exit__(self, *_) -> None:
        _watching.reset(self._before)

    def counts(self) -> dict[str, dict[str, int]]:
        """The counts by input, once the jobs have run; none of an input whose job left it out."""
        found: dict[str, dict[str, int]] = {}

        def fetch(role: str, observation: Observation) -> None:
            found[role] = observation.get

        # Spark answers only if the first job over the input has counted it.
        waiting = [Thread(target=fetch, args=x, daemon=True) for x in self.observed.items()]
        for thread in waiting:
            thread.start()
        for thread in waiting:
            thread.join(self.PATIENCE)
        return dict(sorted(found.items()))


def watched(role: str, df: DataFrame, **counts: Column) -> DataFrame:
    """``df``, with its rows and some aggregates counted if a run is watched that has not counted it yet."""
    watch = _watching.get()
    if watch is None or role in watch.observed:
        return df
    watch.observed[role] = Observation()
    named = [column.alias(name) for name, column in counts.items()]
    return df.observe(watch.observed[role], F.count(F.lit(1)).alias("rows"), *named)


def none_of(*columns: str) -> dict[str, Column]:
    """Counts of nulls, by column."""
    return {f"without_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in columns}


def bad_ids(column: str) -> dict[str, Column]:
    """Ids that are no number, and of these the ones that are all digits, but beyond 64 bits."""
    lost = F.col(column).isNotNull() & int_key(column).isNull()
    beyond = lost & digits_only(column)
    return {"no_number": F.count(F.when(lost, 1)), "beyond_64_bits": F.count(F.when(beyond, 1))}
