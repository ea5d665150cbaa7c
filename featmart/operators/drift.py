"""Time slices, drift between a reference and a current sample, regression errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.scalars import ratio
from featmart.operators.ordering import exact_quantiles, ordered_prefix

LEAST_SHARE = 1e-4


def slice_number(ts: str, start: str, days: int) -> Column:
    """Index of the period [start + k·days, start + (k+1)·days) that a timestamp falls in."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))
    return F.floor(seconds / (86400 * days))


def ks_statistics(df: DataFrame, columns: Sequence[str], is_current: Column) -> DataFrame:
    """(column_name, ks): largest distance between the two distribution functions.

    Values are merged per column before the one sort that orders all columns at once.
    """
    long = df.select(is_current.alias("_cur"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["_cur"], list(columns), "column_name", "value"
    )
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count_if(F.col("_cur")).alias("cur"), F.count_if(~F.col("_cur")).alias("ref")
    )
    placed = ordered_prefix(
        counts, [F.col("value")], {"cur_upto": F.col("cur"), "ref_upto": F.col("ref")}, by=["column_name"]
    )
    totals = counts.groupBy("column_name").agg(F.sum("cur").alias("_c"), F.sum("ref").alias("_r"))
    gap = F.abs(ratio("cur_upto", "_c") - ratio("ref_upto", "_r"))
    return placed.join(totals, "column_name").groupBy("column_name").agg(F.round(F.max(gap), 9).alias("ks"))


def psi(df: DataFrame, columns: Sequence[str], is_current: Column, bins: int = 10) -> DataFrame:
    """(column_name, psi) over quantile bins of the reference sample."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, {c: F.when(~is_current, F.col(c)) for c in columns}, probs)
    parts = []
    for c in columns:
        code = F.lit(0)
        for e in sorted(set(edges[c])):
            code = code + (F.col(c) > e).cast("int")
        parts.append(F.when(F.col(c).isNotNull(), code).alias(c))
    binned = df.select(is_current.alias("_cur"), *parts).unpivot(["_cur"], list(columns), "column_name", "bin")
    counts = binned.filter(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(
        F.count_if(F.col("_cur")).alias("cur"), F.count_if(~F.col("_cur")).alias("ref")
    )
    totals = counts.groupBy("column_name").agg(F.sum("cur").alias("_c"), F.sum("ref").alias("_r"))
    cur = F.greatest(ratio("cur", "_c"), F.lit(LEAST_SHARE))
    ref = F.greatest(ratio("ref", "_r"), F.lit(LEAST_SHARE))
    return counts.join(totals, "column_name").groupBy("column_name").agg(
        F.round(F.sum((cur - ref) * F.ln(cur / ref)), 9).alias("psi")
    )


def chi_square(df: DataFrame, columns: Sequence[str], is_current: Column) -> DataFrame:
    """(column_name, chi2, dof) between the category counts of the two samples."""
    long = df.select(is_current.alias("_cur"), *columns).unpivot(["_cur"], list(columns), "column_name", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count_if(F.col("_cur")).alias("cur"), F.count_if(~F.col("_cur")).alias("ref")
    )
    totals = counts.groupBy("column_name").agg(F.sum("cur").alias("_c"), F.sum("ref").alias("_r"))
    n = F.col("cur") + F.col("ref")
    whole = F.col("_c") + F.col("_r")

    def term(seen: str, total: str) -> Column:
        expected = n * F.col(total) / whole
        return F.coalesce(ratio((F.col(seen) - expected) * (F.col(seen) - expected), expected), F.lit(0.0))

    return counts.join(totals, "column_name").groupBy("column_name").agg(
        F.round(F.sum(term("cur", "_c") + term("ref", "_r")), 6).alias("chi2"),
        (F.count("*") - 1).alias("dof"),
    )


def regression_report(df: DataFrame, group: str, actual: str, predicted: str, decimals: int = 6) -> DataFrame:
    """Mean error, mean absolute error and mean absolute percentage error per slice."""
    error = F.col(predicted) - F.col(actual)
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(error), decimals).alias("me"),
        F.round(F.avg(F.abs(error)), decimals).alias("mae"),
        F.round(100 * F.avg(F.abs(ratio(error, actual))), decimals).alias("mape"),
    )
