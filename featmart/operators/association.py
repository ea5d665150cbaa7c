"""Correlations, class weights and densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.columns import equal_width_bins
from featmart.operators.ordering import null_safe_join, ordered_prefix
from featmart.operators.profiling import value_frequencies
from featmart.session import with_row


def correlation_table(df: DataFrame, columns: Sequence[str], decimals: int = 9) -> DataFrame:
    """(a, b, r) for each pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.round(F.corr(a, b), decimals).alias(f"{a}|{b}") for a, b in pairs])
    return row.unpivot([], row.columns, "pair", "r").select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"),
        "r",
    )


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, rank): ranks of the distinct values, ties sharing their mean.

    Equal values are merged first, so a value held by a third of the rows is one row of
    the single sort that orders all columns.
    """
    counts = value_frequencies(df, columns, "double")
    placed = ordered_prefix(counts, [F.col("value")], {"_upto": F.col("n")}, by=["column_name"])
    return placed.select("column_name", "value", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman_table(df: DataFrame, columns: Sequence[str], decimals: int = 9) -> DataFrame:
    """Rank correlation of each pair: Pearson over average ranks of the complete rows."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ranks = average_ranks(complete, columns)
    ranked = complete
    for c in columns:
        own = ranks.filter(F.col("column_name") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}"))
        ranked = ranked.join(own, c)
    return correlation_table(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in columns]), columns, decimals)


def target_correlations(df: DataFrame, columns: Sequence[str], label: str, decimals: int = 9) -> DataFrame:
    """Correlation of every column with the label, strongest first."""
    row = df.agg(*[F.round(F.corr(c, label), decimals).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "r").orderBy(F.desc(F.abs("r")), "column_name")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (1 + rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.transform(with_row, total).select(label, "n", (F.col("_total") / (1 + F.col("n"))).alias("weight"))


def sample_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with the weight of their class; a null class is a class."""
    return null_safe_join(df, class_weights(df, label).select(label, "weight"), [label])


def weighted_mcc(df: DataFrame, label: str, columns: Sequence[str], decimals: int = 9) -> DataFrame:
    """Matthews correlation of 0/1 columns with the label, classes weighted against imbalance.

    The class weight is constant within a class, so the confusion counts are weighted
    after grouping.
    """
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("p"),
        F.count_if(F.col(label) == 0).alias("q"),
        *[F.count_if((F.col(label) == 1) & (F.col(c) == 1)).alias(f"tp|{c}") for c in columns],
        *[F.count_if((F.col(label) == 0) & (F.col(c) == 1)).alias(f"fp|{c}") for c in columns],
    )
    cells = counts.select(
        "p", "q",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"tp|{c}").alias("tp"), F.col(f"fp|{c}").alias("fp")) for c in columns])
        ).alias("s"),
    ).select("p", "q", "s.*")
    n = F.col("p") + F.col("q")
    w1, w0 = n / (1 + F.col("p")), n / (1 + F.col("q"))
    tp, fp = F.col("tp") * w1, F.col("fp") * w0
    fn, tn = (F.col("p") - F.col("tp")) * w1, (F.col("q") - F.col("fp")) * w0
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cells.select(
        "column_name", F.round(F.coalesce(F.try_divide(tp * tn - fp * fn, bottom), F.lit(0.0)), decimals).alias("mcc")
    )


def weighted_kendall(df: DataFrame, label: str, column: str, decimals: int = 9) -> DataFrame:
    """Tie-corrected Kendall tau of a 0/1 label and an ordered column, pairs weighted by class.

    Rows are first merged into a contingency table; running sums along the ordered values
    then give the concordant and discordant pair weights without listing any pair.
    """
    cells = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    placed = ordered_prefix(cells, [F.col(column)], {"upto0": F.col("n0")})
    sums = placed.agg(
        F.sum("n0").alias("t0"),
        F.sum("n1").alias("t1"),
        F.sum(F.col("n1") * (F.col("upto0") - F.col("n0"))).alias("below"),
        F.sum(F.col("n1") * F.col("upto0")).alias("not_above"),
        F.sum(F.col("n0") * F.col("n0")).alias("s00"),
        F.sum(F.col("n0") * F.col("n1")).alias("s01"),
        F.sum(F.col("n1") * F.col("n1")).alias("s11"),
    )
    t0, t1 = F.col("t0"), F.col("t1")
    w0, w1 = (t0 + t1) / (1 + t0), (t0 + t1) / (1 + t1)
    margin = (F.col("below") - (t0 * t1 - F.col("not_above"))) * w0 * w1
    whole = t0 * w0 + t1 * w1
    tied = F.col("s00") * w0 * w0 + 2 * F.col("s01") * w0 * w1 + F.col("s11") * w1 * w1
    bottom = F.sqrt(t0 * w0 * t1 * w1 * (whole * whole - tied) / 2)
    return sums.select(F.round(F.try_divide(margin, bottom), decimals).alias("tau"))


def density_by_class(df: DataFrame, column: str, label: str, bins: int, decimals: int = 9) -> DataFrame:
    """Histogram density of a column for each label class over common bins."""
    span = df.agg(((F.max(column) - F.min(column)) / bins).alias("_width"))
    counts = equal_width_bins(df, column, bins, decimals=9).groupBy(label, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("_total"))
    return (
        counts.join(totals, label)
        .transform(with_row, span)
        .select(label, "bin", "n", F.round(F.col("n") / (F.col("_total") * F.col("_width")), decimals).alias("density"))
    )
