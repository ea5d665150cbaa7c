"""Cell-by-cell comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.columns import NUMERIC


def align_types(df: DataFrame, model: DataFrame) -> DataFrame:
    """Cast the shared columns of `df` to the types they have in `model`."""
    kinds = dict(model.dtypes)
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def frame_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per shared column: null-aware equality, and the difference b − a.

    Numbers are subtracted; from a text the other text is taken out. `present` tells in
    which frame a key stands: both, or only the left or right; in the latter cases no
    column is the same.
    """
    kinds = dict(a.dtypes)
    columns = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    right = align_types(b, a).select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    where = F.when(shared, "both").when(F.col("_b").isNull(), "left").otherwise("right")
    out = [where.alias("present")]
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        out.append((shared & x.eqNullSafe(y)).alias(f"{c}_same"))
        if kinds[c] in NUMERIC:
            out.append((y - x).alias(f"{c}_diff"))
        elif kinds[c] == "string":
            out.append(F.when(x != "", F.replace(y, x, F.lit(""))).otherwise(y).alias(f"{c}_diff"))
    return left.join(right, list(keys), "full").select(*keys, *out)


def diff_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(column_name, same, different) over the keys of either frame, one pass after the join."""
    diff = frame_diff(a, b, keys)
    flags = [c for c in diff.columns if c.endswith("_same")]
    counted = diff.agg(
        *[
            F.struct(F.count_if(F.col(c)).alias("same"), F.count_if(~F.col(c)).alias("different")).alias(c[:-5])
            for c in flags
        ]
    )
    return counted.unpivot([], [c[:-5] for c in flags], "column_name", "s").select("column_name", "s.*")
