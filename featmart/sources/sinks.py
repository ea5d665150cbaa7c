"""Writers, and tables materialised under the hash of their parameters."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.session import shared_folder


def convert_tables(tables: dict[str, DataFrame], folder: str, codec: str = "zstd") -> dict[str, str]:
    """Write every table as Parquet with the chosen codec."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(paths[name])
    return paths


def save_mart(df: DataFrame, folder: str, version: str) -> str:
    """One versioned feature table, gzip Parquet."""
    path = f"{folder}/mart/{version}"
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)
    return path


def load_mart(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/mart/{version}")


def save_by_key(df: DataFrame, path: str, key: str, then: str) -> str:
    """Parquet ranged and sorted by (key, then), so that a filter on the key skips most row groups.

    Ranges are cut on both columns: the rows of a hot key spread over several files.
    """
    ordered = df.repartitionByRange(key, then).sortWithinPartitions(key, then)
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed", root: str | None = None) -> DataFrame:
    """`df` as a table bucketed and sorted by `key`, read back: tables of equal buckets join
    on the key, and group by it, without a shuffle.

    One file a bucket: rows are dealt by the hash that buckets have. The files lie in the
    shared folder (or under `root`); only their description is in the session's catalog.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{root or shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def save_submission(df: DataFrame, path: str, key: str, score: str) -> str:
    """CSV of (key, score), written in parallel."""
    df.select(key, score).write.mode("overwrite").option("header", True).csv(path)
    return path


def parameter_hash(params: dict) -> str:
    """Address of a parameter set: SHA-256 of its sorted JSON."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def materialized(
    spark: SparkSession,
    name: str,
    params: dict,
    build: Callable[[], DataFrame],
    root: str | None = None,
    use_file: bool = True,
    refresh: bool = False,
) -> DataFrame:
    """The table for (name, params): read if already written, else built and written once.

    Written to the shared folder and read back, so later plans start from the files.
    """
    path = f"{root or shared_folder(spark)}/{name}/{parameter_hash(params)}"
    if not use_file:
        return build()
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialized_parts(
    spark: SparkSession,
    name: str,
    params: dict,
    source: str,
    build: Callable[[DataFrame], DataFrame],
    root: str | None = None,
    pattern: str = "*.parquet",
) -> DataFrame:
    """The table for (name, params) over the Parquet files of `source`, kept up to date.

    `build` works on rows, so that each file's result stands by itself. Every result row is
    written under its file's fingerprint (path, size and time of change): only files whose
    fingerprint has no result yet are read and built, in one job; results of files that are
    gone or have changed are not read any more. File contents are not listed on the driver,
    only the fingerprints of the files that are there.
    """
    path = f"{root or shared_folder(spark)}/{name}/{parameter_hash(params)}"
    stamp = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    files = listed.select("path", stamp.alias("_file")).collect()
    try:
        done = {r["_file"] for r in spark.read.parquet(f"{path}/done").select("_file").distinct().collect()}
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = set()
    fresh = [r for r in files if r["_file"] not in done]
    if fresh:
        stamps = spark.createDataFrame([(r["path"], r["_file"]) for r in fresh], "_path string, _file string")
        rows = spark.read.parquet(*[r["path"] for r in fresh]).withColumn("_path", F.col("_metadata.file_path"))
        built = build(rows.join(F.broadcast(stamps), "_path").drop("_path"))
        # A build that was lost half way left results without a mark: they are written over.
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_file").parquet(f"{path}/parts")
        stamps.select("_file").write.mode("append").parquet(f"{path}/done")
    current = [r["_file"] for r in files]
    return spark.read.parquet(f"{path}/parts").filter(F.col("_file").isin(current)).drop("_file")


def rows_as_json(df: DataFrame, name: str = "row_json") -> DataFrame:
    """Each row as one JSON object; a large result stays distributed."""
    return df.select(F.to_json(F.struct("*")).alias(name))
