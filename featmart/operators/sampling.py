"""Repeatable samples, class balancing and fold assignment along an arithmetic hash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.ordering import first_n_by_hash, hash_rank, null_safe_join
from featmart.session import with_row


def sample_exact(df: DataFrame, key: str, size: int | float, seed: int = 0) -> DataFrame:
    """Exactly `size` rows, or for a float the floor of that share of the rows."""
    if isinstance(size, float):
        size = int(size * df.count())
    return first_n_by_hash(df, key, size, seed=seed)


def named_samples(df: DataFrame, key: str, label: str, specs: Mapping[str, int | float], seed: int = 0) -> DataFrame:
    """The named samples of the labelled rows, stacked; the rows are ranked once for all."""
    labelled = df.filter(F.col(label) > -1)
    size = labelled.agg(F.count("*").alias("_all"))
    ranked = with_row(hash_rank(labelled, key, seed=seed, name="_rank"), size)
    fits = [
        F.when(F.col("_rank") <= (F.floor(F.col("_all") * n) if isinstance(n, float) else F.lit(n)), F.lit(name))
        for name, n in specs.items()
    ]
    return ranked.select(*df.columns, F.explode(F.array_compact(F.array(*fits))).alias("sample"))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("size"))


def under_sample(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Every class cut to the size of the smallest, by hash order."""
    sizes = class_sizes(df, label)
    least = sizes.agg(F.min("size").alias("n"))
    return first_n_by_hash(df, key, sizes.select(label).transform(with_row, least), by=[label], seed=seed)


def over_sample(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Every class raised to the size of the largest by repeating its rows evenly.

    Each row is repeated n_max div n_class times, and the first n_max mod n_class rows in
    hash order once more. `copy` numbers the repetitions.
    """
    sizes = class_sizes(df, label)
    most = sizes.agg(F.max("size").alias("_most"))
    plan = sizes.transform(with_row, most).select(
        label,
        F.floor(F.col("_most") / F.col("size")).alias("_times"),
        (F.col("_most") % F.col("size")).alias("_extra"),
    )
    ranked = null_safe_join(hash_rank(df, key, by=[label], seed=seed, name="_rank"), plan, [label])
    times = F.col("_times") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    return repeated(ranked.select(*df.columns, times.alias("_times")), "_times").select(*df.columns, "copy")


def repeated(df: DataFrame, times: str, name: str = "copy", block: int = 1000) -> DataFrame:
    """Each row `times` times, numbered from 1; numbers are made a block at a time, so a row
    repeated very often never becomes one long array."""
    blocks = df.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times), F.lit(block).cast("long"))))
    upto = F.least(F.col("_from") + (block - 1), F.col(times))
    return blocks.withColumn(name, F.explode(F.sequence("_from", upto))).drop("_from")


def assign_folds(df: DataFrame, key: str, folds: int, by: str | None = None, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold number of each row; folds (of each class, if stratified) differ by one row at most."""
    ranked = hash_rank(df, key, by=[by] if by else [], seed=seed, name="_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")
