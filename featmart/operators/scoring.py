"""Metrics of binary scores and of class assignments, all from grouped counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.scalars import ratio
from featmart.operators.ordering import ordered_prefix
from featmart.session import with_row

# The weights of recall against precision in the F suite.
BETAS = (1, 2, 4, 8, 16)


def confusion_counts(label: str, predicted: Column) -> list[Column]:
    hit = F.col(label) == 1
    return [
        F.count_if(hit & predicted).alias("tp"),
        F.count_if(~hit & predicted).alias("fp"),
        F.count_if(hit & ~predicted).alias("fn"),
        F.count_if(~hit & ~predicted).alias("tn"),
    ]


def metric_columns(decimals: int = 9) -> list[Column]:
    """Metrics as columns over tp, fp, fn, tn; undefined ones are 0, as is customary."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def metric(top: Column, bottom: Column, name: str) -> Column:
        return F.round(F.coalesce(ratio(top, bottom), F.lit(0.0)), decimals).alias(name)

    return [
        metric(tp + tn, tp + fp + fn + tn, "accuracy"),
        metric(tp, tp + fp, "precision"),
        metric(tp, tp + fn, "recall"),
        metric(tp, tp + fp + fn, "jaccard"),
        *[metric((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp, f"f{b}") for b in BETAS],
    ]


def binary_metrics(df: DataFrame, label: str, predicted: Column, decimals: int = 9) -> DataFrame:
    return df.agg(*confusion_counts(label, predicted)).select("tp", "fp", "fn", "tn", *metric_columns(decimals))


def metrics_by_subset(df: DataFrame, label: str, predicted: Column, subsets: Mapping[str, Column]) -> DataFrame:
    """The metric suite of several overlapping subsets, in one pass over the rows.

    Rows are first counted per combination of label, prediction and membership, so the
    subsets are then summed from a handful of rows.
    """
    cells = df.groupBy(
        (F.col(label) == 1).alias("_hit"), predicted.alias("_guess"), *[cond.alias(n) for n, cond in subsets.items()]
    ).agg(F.count("*").alias("_n"))
    members = cells.unpivot(["_hit", "_guess", "_n"], list(subsets), "subset", "_in").filter("_in")

    def count(hit: bool, guess: bool, name: str) -> Column:
        match = (F.col("_hit") == hit) & (F.col("_guess") == guess)
        return F.coalesce(F.sum(F.when(match, F.col("_n"))), F.lit(0).cast("long")).alias(name)

    counted = members.groupBy("subset").agg(
        count(True, True, "tp"), count(False, True, "fp"), count(True, False, "fn"), count(False, False, "tn")
    )
    return counted.select("subset", "tp", "fp", "fn", "tn", *metric_columns())


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties, however many, become one row."""
    return df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve with ties at half, from running counts."""
    placed = ordered_prefix(score_counts(df, label, score), [F.col(score)], {"upto": F.col("neg")})
    beaten = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return placed.agg(ratio(beaten, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, from the highest down."""
    counts = score_counts(df, label, score)
    placed = ordered_prefix(counts, [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return placed.transform(with_row, totals).select(
        F.col(score).alias("threshold"), "tp", "fp", ratio("tp", "_p").alias("tpr"), ratio("fp", "_n").alias("fpr")
    )


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and error rates per threshold, one pass without multiplying rows."""
    counted = df.agg(
        *[F.struct(*confusion_counts(label, F.col(score) >= t)).alias(str(t)) for t in thresholds]
    )
    return (
        counted.unpivot([], [f"`{t}`" for t in thresholds], "threshold", "s")
        .select(F.col("threshold").cast("double").alias("threshold"), "s.*")
        .withColumns({"fnr": ratio("fn", F.col("fn") + F.col("tp")), "fpr": ratio("fp", F.col("fp") + F.col("tn"))})
    )


def business_gain(sweep: DataFrame, tp: float, fn: float, tn: float, fp: float) -> DataFrame:
    """Gain of each threshold under a cost matrix, the best one marked."""
    gain = F.col("tp") * tp + F.col("fn") * fn + F.col("tn") * tn + F.col("fp") * fp
    gains = sweep.select("threshold", gain.cast("double").alias("gain"))
    best = gains.agg(F.max_by("threshold", "gain").alias("_best"))
    return gains.transform(with_row, best).select("threshold", "gain", (F.col("threshold") == F.col("_best")).alias("best"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    wide = df.groupBy(label).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return wide.select(label, *[F.coalesce(F.col(str(c)), F.lit(0).cast("long")).alias(f"predicted_{c}") for c in classes])


def class_report(df: DataFrame, label: str, predicted: str, decimals: int = 9) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the contingency table."""
    cells = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits")
    )
    guessed = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("guessed"))
    joined = actual.join(guessed, "class", "full").fillna(0, ["support", "hits", "guessed"])

    def rounded(top, bottom, name):
        return F.round(F.coalesce(ratio(top, bottom), F.lit(0.0)), decimals).alias(name)

    return joined.select(
        "class", rounded("hits", "guessed", "precision"), rounded("hits", "support", "recall"),
        rounded(2 * F.col("hits"), F.col("support") + F.col("guessed"), "f1"), "support",
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement of two groupings, from pair counts of the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))

    def pairs(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    rows = cells.groupBy(a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n"))
    whole = cells.agg(F.sum("n").alias("n"))
    sums = pairs(cells, "both")
    for table, name in ((rows, "left"), (cols, "right"), (whole, "total")):
        sums = with_row(sums, pairs(table, name))
    expected = F.col("left") * F.col("right") / F.col("total")
    return sums.select(
        ratio(F.col("both") - expected, (F.col("left") + F.col("right")) / 2 - expected).alias("adjusted_rand")
    )


def class_contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, class, n, best): counts of each pair, the largest class of a cluster marked."""
    cells = df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("class")).agg(F.count("*").alias("n"))
    best = cells.groupBy("cluster").agg(F.max(F.struct("n", F.col("class"))).alias("_b"))
    return cells.join(best, "cluster").select("cluster", "class", "n", (F.col("class") == F.col("_b.class")).alias("best"))
