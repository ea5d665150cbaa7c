"""Session settings, and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "featmart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` adds or overrides.

    Shuffle partition counts are left to adaptive execution: it starts from
    `spark.sql.shuffle.partitions` and coalesces, so one setting serves both small and
    large inputs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Wide feature rows (one column per statistic) stay in generated code.
        "spark.sql.codegen.maxFields": "400",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from `spark.checkpoint.dir`.

    Only a local session, whose executors share the machine, may fall back to a
    temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="featmart-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Runtime settings the plans count on, for sessions that were built elsewhere.

    A skewed join is split even where that costs a later shuffle: without it a hot loan
    would keep its rows in one task from the join on.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.codegen.maxFields", "400")
    # Where the rows are sorted on the key already, aggregate along the sort: run arrays are
    # then built one key at a time.
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


#: Bytes of a file, and compressed bytes of a shuffle, that one task reads at most, as far as row
#: groups and keys allow it, and the number of partitions that adaptive execution starts from:
#: enough for a shuffle of 8 GB; beyond, pieces grow in proportion.
TASK_BYTES, MOST_TASKS = 8 << 20, 1000
UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def bound_tasks(spark: SparkSession) -> None:
    """Settings by which the memory of one task does not grow with the input.

    Keys, statuses and dates of these tables shrink by ten and more in a file, so a task that
    reads the usual 64 MB of a shuffle sorts over 1 GB, and one that scans the usual 128 MB
    groups over 1 GB before its shuffle. A session's smaller pieces and higher numbers are
    kept.
    """
    for size in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", spark.conf.get(size).lower()).groups()
        if int(number) << UNITS[unit] > TASK_BYTES:
            spark.conf.set(size, str(TASK_BYTES))
    coalesce = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    most = max(int(spark.conf.get(c, None) or 0) for c in (coalesce, "spark.sql.shuffle.partitions"))
    if most < MOST_TASKS:
        spark.conf.set(coalesce, str(MOST_TASKS))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table, such as a global aggregate, to every row.

    The only use of a product in the library: `row` has one row by construction, so it is
    broadcast and multiplies nothing.
    """
    return df.crossJoin(F.broadcast(row))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read it when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
