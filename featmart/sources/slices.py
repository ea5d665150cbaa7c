"""Row ranges, client slices and sampled scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.operators.ordering import HASH_MODULUS, ordered_prefix, spread


def row_range(
    df: DataFrame, order: Sequence[Column], start: int | None = None, stop: int | None = None
) -> DataFrame:
    """Rows `start:stop` along `order`, with slice rules: negatives count from the end.

    The rows are numbered through one distributed sort, so a deep page never gathers the
    rows in front of it; the range comes out in order.
    """
    start = start or 0
    if start < 0 or (stop is not None and stop < 0):
        n = df.count()
        start = max(start + n, 0) if start < 0 else start
        stop = max(stop + n, 0) if stop is not None and stop < 0 else stop
    placed = ordered_prefix(df, order, {"_pos": F.lit(1)}).filter(F.col("_pos") > start)
    if stop is not None:
        placed = placed.filter(F.col("_pos") <= stop)
    return placed.orderBy("_pos").drop("_pos")


def client_slice(
    df: DataFrame, client: int, key: str = "client_id", via: DataFrame | None = None, on: str | None = None
) -> DataFrame:
    """All rows of one client; the key is attached through `via` first if `df` lacks it.

    The client filter is applied to the map before the join, so only its few loans reach
    the child table.
    """
    if key in df.columns:
        return df.filter(F.col(key) == client)
    return df.join(via.filter(F.col(key) == client), on)


def sample_by_key(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Repeatable sample of keys by hash threshold: no sort, no shuffle, same rows every run."""
    return df.filter(spread(key, seed) < int(fraction * HASH_MODULUS))


def restrict_to_parents(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return child.join(parents.select(key), key, "left_semi")
