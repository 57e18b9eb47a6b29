"""Work tables of one run, clustered by a key for the joins that read them.

Rows are dealt to buckets by the key once, when they are written; a join or an aggregation
by that key then reads them where they lie, without a shuffle. The catalog keeps the buckets,
so each table has a name of this run there until it is removed.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.session import shuffle_width
from memberlens.sinks.refresh import FolderSink

#: More files than this help no join.
MOST_BUCKETS = 10_000


class ClusteredTables:
    """Tables as files below ``folder``, listed in the session's current database."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.sink = FolderSink(spark, folder)
        self.run = uuid4().hex[:12]
        self.names: list[str] = []

    def write(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """The rows as written. A key must not be hot: its rows make one file, written by one task."""
        buckets = min(shuffle_width(self.spark), MOST_BUCKETS)
        listed = f"memberlens_{self.run}_{name}"
        self.names.append(listed)
        placed = rows.repartition(buckets, key).sortWithinPartitions(key)
        writer = placed.write.format("parquet").option("path", f"{self.sink.root}/{name}")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(listed)
        return self.spark.table(listed).select(*[F.col(f"`{c}`") for c in rows.columns])

    def remove(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.sink.remove()
