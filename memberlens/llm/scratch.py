"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, whatever their names, but for some."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without it gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder of ``spark.checkpoint.dir``.

    A lost executor then costs no earlier stage.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Whether a query's shuffle files go when it ends, rather than when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one computation in the folder of ``spark.checkpoint.dir``.

    For computations of many small steps: a table that is read back has as many parts as
    its size asks for, and carries nothing of the plan that made it. What was shuffled to
    make a table is freed once the table is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/{uuid4().hex}"
        self.tables = 0

    def saved(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Deletes all tables; what is made from them lazily must have been computed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Into how many parts the session deals a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text in a part of a corpus, about.
PART_BYTES = 100 << 20
#: In so many cells the bytes are counted first.
CELLS = 4096


def in_parts(rows: DataFrame, name: str) -> tuple[int, DataFrame]:
    """How many parts the text asks for, and the rows dealt into them by the column ``name``.

    ``rows`` has key, a hash that says where a row goes, body, its text, and others; key is
    left out. There are as many parts as the session deals a shuffle into, or more. Rows of
    one key that would fill a part are written once and spread over all.
    """
    size, cell = F.octet_length("body"), F.pmod("key", F.lit(CELLS))
    cells = rows.groupBy(cell.alias("cell")).agg(F.sum(size).alias("bytes")).collect()
    n = max(width(rows.sparkSession), math.ceil(sum(r["bytes"] for r in cells) / PART_BYTES))
    most = PART_BYTES // 4
    full = [r["cell"] for r in cells if r["bytes"] > most]
    hot = []
    if full:
        of_key = rows.filter(cell.isin(full)).groupBy("key")
        of_key = of_key.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("k"))
        hot = [r["key"] for r in of_key.filter((F.col("bytes") > most) & (F.col("k") > 1)).collect()]

    def placed(some: DataFrame, key: Column) -> DataFrame:
        part = F.pmod(key, F.lit(n)).cast("int").alias(name)
        return some.select(part, *columns(some, "key"))

    if not hot:
        return n, placed(rows, F.col("key")).repartition(n, name)
    is_hot = F.col("key").isin(hot)
    spread = saved(placed(rows.filter(is_hot), F.xxhash64("key", F.monotonically_increasing_id())))
    return n, placed(rows.filter(~is_hot), F.col("key")).unionByName(spread).repartition(n, name)
