"""Runs all marts: ``spark-submit memberlens/jobs.py --help``."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import SparkSession

from memberlens.plans import shared
from memberlens.plans.marts import BY_TABLE, MARTS, VISIT_LOG
from memberlens.session import configure, now, shared_folder
from memberlens.sinks.clustered import ClusteredTables
from memberlens.sinks.refresh import CatalogSink, FolderSink
from memberlens.sources.checks import Watch
from memberlens.sources.tables import Tables, from_catalog, from_folder


@dataclass(frozen=True)
class Run:
    """The tables that a run has written, and what it counted in its inputs on the way."""

    tables: list[str]
    inputs: dict[str, dict[str, int]]


def refresh_marts(
    spark: SparkSession,
    tables: Tables,
    sink: FolderSink | CatalogSink,
    as_of: date | None = None,
    load_time: datetime | None = None,
    only: Iterable[str] = (),
) -> Run:
    """Refresh the marts (or ``only`` some, by table name); returns their names and input counts.

    The visit log is written first and read back. Blocks that more than one of the marts
    needs are written once to the shared work folder, which also spares recomputing them
    when an executor is lost, and removed at the end; those that all their marts join by one key are
    clustered by it.
    """
    as_of = as_of or now(spark).date()
    chosen = [BY_TABLE[name] for name in only] or MARTS
    uses = [role for mart in chosen for role in mart.inputs]
    repeated = [role for role in shared.BLOCKS if uses.count(role) > 1]
    work = []
    try:
        with Watch() as watch:
            if VISIT_LOG in chosen:
                sink.refresh(VISIT_LOG.table, VISIT_LOG(tables, as_of, load_time))
            if {"visit_log", "visit_years"} & {*uses}:
                tables = tables.with_table("visit_log", sink.read(VISIT_LOG.table))
            if repeated:
                folder = _work_folder(spark, sink)
                plain = FolderSink(spark, f"{folder}/blocks")
                clustered = ClusteredTables(spark, f"{folder}/clustered")
                work = [plain, clustered, FolderSink(spark, folder)]
            for role in repeated:
                block = shared.BLOCKS[role](tables, as_of)
                if role in shared.CLUSTERED:
                    written = clustered.write(role, block, shared.CLUSTERED[role])
                else:
                    written = plain.refresh(role, block)
                tables = tables.with_table(role, written)
            for mart in chosen:
                if mart is not VISIT_LOG:
                    sink.refresh(mart.table, mart(tables, as_of, load_time))
    finally:
        for written in work:
            written.remove()
    return Run([mart.table for mart in chosen], watch.counts())


def _work_folder(spark: SparkSession, sink: FolderSink | CatalogSink) -> str:
    """A folder of this run, in the shared folder that the cluster names."""
    folder = shared_folder(spark)
    if not folder:
        if not isinstance(sink, FolderSink):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{sink.root}/_work"
    return f"{folder}/memberlens-{spark.sparkContext.applicationId}-{uuid4().hex[:8]}"


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--source-folder", help="read <folder>/<schema>/<table>, not the catalog")
    parser.add_argument("--target-folder", help="write <folder>/<table>")
    parser.add_argument("--target-database", help="write tables of this database")
    parser.add_argument("--prefix", default="", help="before each target table name")
    parser.add_argument("--as-of", type=date.fromisoformat, help="default: today")
    parser.add_argument("--load-time", type=datetime.fromisoformat, help="default: now")
    parser.add_argument("--time-zone", default="UTC", help="of the events' calendar days")
    parser.add_argument("--input-gb", type=float, help="size of the largest input, for shuffles")
    parser.add_argument("marts", nargs="*", help="table names; default: all")
    options = parser.parse_args()
    if bool(options.target_folder) == bool(options.target_database):
        parser.error("give either --target-folder or --target-database")

    size = options.input_gb and int(options.input_gb * 1e9)
    spark = configure(SparkSession.builder.getOrCreate(), options.time_zone, size)
    if options.source_folder:
        tables = from_folder(spark, options.source_folder)
    else:
        tables = from_catalog(spark)
    if options.target_folder:
        sink = FolderSink(spark, options.target_folder)
    else:
        sink = CatalogSink(spark, options.target_database, options.prefix)
    run = refresh_marts(spark, tables, sink, options.as_of, options.load_time, options.marts)
    for role, counts in run.inputs.items():
        print(role, *[f"{name}={count}" for name, count in counts.items()])


if __name__ == "__main__":
    main()
