"""Session settings the marts rely on, and the session's clock."""

from __future__ import annotations

import re
from datetime import datetime
from math import ceil

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

#: Shuffled bytes that adaptive execution may merge into one task. They are compressed: order lines take
#: 25 to 35 times as much in the hash tables of a task that merges equal ones and adds them up.
TASK_BYTES = 16 << 20

#: Bytes of input for each shuffle partition, where the size of the input is given.
PARTITION_BYTES = 128 << 20


def now(spark: SparkSession) -> datetime:
    """The wall clock in the session's time zone, to the second."""
    text = spark.sql("SELECT date_format(now(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
    return datetime.fromisoformat(text)


def shuffle_width(spark: SparkSession) -> int:
    """Into how many partitions a shuffle begins."""
    planned = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or planned)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share, if it is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of one machine: executors cannot share it")
    return folder and folder.rstrip("/")


def _bytes(size: str) -> int:
    """A size as settings spell it: ``67108864b``, ``64MB``, ``8m`` or plain bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(
    spark: SparkSession, time_zone: str = "UTC", input_bytes: int | None = None
) -> SparkSession:
    """Apply the runtime settings, for good, to a session that already exists.

    ``time_zone`` decides the calendar day of epoch-second events. Memory and broadcast
    limits stay as the session has them; partitions are merged up to :data:`TASK_BYTES`, or up to less
    if the session says so, for the memory of a task. With ``input_bytes``, the size of the largest
    input, shuffles begin with a partition for each 128 MB of it, which adaptive execution
    merges where they turn out small; else with as many as the session says.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", time_zone)
    if _bytes(spark.conf.get(ADVISED_BYTES)) > TASK_BYTES:
        spark.conf.set(ADVISED_BYTES, f"{TASK_BYTES}b")
    if input_bytes:
        planned = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(INITIAL_PARTITIONS, str(max(planned, ceil(input_bytes / PARTITION_BYTES))))
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **settings: str
) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("memberlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        # Call sites of every column expression cost more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
