"""Value counts, column statistics, reports and rates by class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.operators.columns import edge_bins, equal_width_bins, numeric_columns, string_columns
from featmart.operators.ordering import INTEGERS, exact_quantiles, order_statistics, ordered_prefix
from featmart.session import with_row

# Fixed value: the third quartile of the standard normal distribution.
NORMAL_Q75 = 0.6744897501960817


def value_counts(df: DataFrame, column: str, tail: float | bool | None = None) -> DataFrame:
    """(value, n, proportion) of the known values.

    With a share `tail`, the rarest values whose summed share stays under it are merged
    into one "first:last" row; with `tail=True` the cut falls where, after the first value
    that outweighs all rarer ones together, a value no longer does. A tail of one value
    is left alone. The values are ordered by one distributed sort.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    if tail is None:
        total = counts.agg(F.sum("n").alias("_total"))
        return counts.transform(with_row, total).select(
            F.col("value").cast("string").alias("value"), "n", (F.col("n") / F.col("_total")).alias("proportion")
        )
    placed = _marked_tail(counts, tail)
    head = placed.filter(~F.col("in_tail")).select(F.col("value").cast("string").alias("value"), "n", "total")
    merged = (
        placed.filter("in_tail")
        .agg(
            F.concat_ws(":", F.min("value"), F.max("value")).alias("value"),
            F.sum("n").alias("n"),
            F.max("total").alias("total"),
        )
        .filter("n IS NOT NULL")
    )
    return head.unionByName(merged).select("value", "n", (F.col("n") / F.col("total")).alias("proportion"))


def _marked_tail(counts: DataFrame, tail: float | bool) -> DataFrame:
    order = [F.col("n").desc(), F.col("value").asc()]
    placed = ordered_prefix(counts, order, {"upto": F.col("n"), "place": F.lit(1)})
    whole = placed.agg(F.sum("n").alias("total"))
    placed = placed.transform(with_row, whole)
    after = F.col("total") - F.col("upto")
    if tail is True:
        outweighs = (F.col("n") > after) & (after > 0)
        first = placed.agg(F.coalesce(F.min(F.when(outweighs, F.col("place"))), F.lit(1)).alias("first"))
        start = placed.transform(with_row, first).agg(
            F.min(F.when((F.col("place") >= F.col("first")) & ~outweighs, F.col("place"))).alias("start")
        )
        placed = placed.transform(with_row, start).withColumn("in_tail", F.col("place") >= F.col("start"))
    else:
        placed = placed.withColumn("in_tail", (after + F.col("n")) / F.col("total") < float(tail))
    size = placed.agg(F.count_if("in_tail").alias("_size"))
    return placed.transform(with_row, size).select(
        "value", "n", "total", (F.col("in_tail") & (F.col("_size") > 1)).alias("in_tail")
    )


def reduce_long_tail(df: DataFrame, column: str, tail: float | bool = 0.01) -> DataFrame:
    """Replace the rare values of a column by their common "first:last" label."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    rare = _marked_tail(counts, tail).filter("in_tail").select("value")
    label = rare.agg(F.concat_ws(":", F.min("value"), F.max("value")).alias("_label"))
    rare = rare.transform(with_row, label).withColumnRenamed("value", column)
    return df.join(rare, column, "left").withColumn(
        column, F.coalesce(F.col("_label"), F.col(column).cast("string"))
    ).drop("_label")


def discrete_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: known, distinct and missing values, fill rate and diversity rate."""
    columns = list(columns or df.columns)
    row = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.count_distinct(c).alias("n_unique"),
                (F.count("*") - F.count(c)).alias("n_missing"),
            ).alias(c)
            for c in columns
        ]
    )
    return (
        row.unpivot([], columns, "column_name", "s")
        .select("column_name", "s.*")
        .withColumn("fill_rate", F.try_divide("n", F.col("n") + F.col("n_missing")))
        .withColumn("diversity", F.try_divide("n_unique", "n"))
    )


def discrete_stats_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        discrete_stats(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness from the population one."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    n = F.count(c)
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(c) + 6)


def moments(df: DataFrame, columns: Sequence[str], decimals: int = 4) -> DataFrame:
    """Long table of count, min, max, mean, variance, std, skewness and kurtosis."""
    row = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.round(F.avg(c), decimals).alias("mean"),
                F.round(F.var_samp(c), decimals).alias("var"),
                F.round(F.stddev_samp(c), decimals).alias("std"),
                F.round(sample_skewness(c), decimals).alias("skew"),
                F.round(sample_kurtosis(c), decimals).alias("kurt"),
            ).alias(c)
            for c in columns
        ]
    )
    return row.unpivot([], list(columns), "column_name", "s").select("column_name", "s.*")


def value_frequencies(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """(column_name, value, n) for every known value of every column, one shuffle.

    Values are counted as they are and cast to `kind` afterwards, so that large integers
    stay apart even where the result is a double.
    """
    kinds = dict(df.dtypes)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault("bigint" if kind == "double" and kinds[c] in INTEGERS else kind, []).append(c)
    parts = [
        df.select(*[F.col(c).cast(exact).alias(c) for c in named])
        .unpivot([], named, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count("*").alias("n"))
        .withColumn("value", F.col("value").cast(kind))
        for exact, named in groups.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Every most frequent value of every column."""
    counts = value_frequencies(df, columns, kind)
    top = counts.groupBy("column_name").agg(F.max("n").alias("n"))
    return counts.join(top, ["column_name", "n"]).select("column_name", F.col("value").alias("mode"), "n")


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles as a long table (column_name, one column per probability)."""
    found = exact_quantiles(df, {c: F.col(c) for c in columns}, list(probs.values()))
    schema = "column_name string, " + ", ".join(f"{p} double" for p in probs)
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], schema)


def trimmed_means(df: DataFrame, columns: Sequence[str], cut: float = 0.1) -> DataFrame:
    """Mean without the lowest and highest share of the values.

    The two bounding order statistics are selected exactly; one aggregation then sums the
    values strictly between them and adds the bounds as often as they are kept.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    used = [c for c in columns if counts[c]]
    ranks = {c: [int(cut * counts[c]), counts[c] - 1 - int(cut * counts[c])] for c in used}
    bounds = order_statistics(df, {c: F.col(c) for c in used}, ranks)
    aggs = []
    for c in used:
        k = int(cut * counts[c])
        low, high = bounds[c][ranks[c][0]], bounds[c][ranks[c][1]]
        x = F.col(c).cast("double")
        if low == high:
            value = F.lit(low)
        else:
            kept_low = (F.count_if(x <= low) - k) * F.lit(low)
            kept_high = (F.count_if(x >= high) - k) * F.lit(high)
            inner = F.coalesce(F.sum(F.when((x > low) & (x < high), x)), F.lit(0.0))
            value = (inner + kept_low + kept_high) / F.lit(counts[c] - 2 * k)
        aggs.append(value.alias(c))
    return df.agg(*aggs).unpivot([], used, "column_name", "trim_mean")


def median_abs_deviation(df: DataFrame, columns: Sequence[str], middle: Mapping[str, float | None] | None = None) -> DataFrame:
    """Median distance from the median, scaled to the normal deviation; `middle` gives the
    medians where they are known."""
    if middle is None:
        middle = {c: found[0] for c, found in exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5]).items()}
    spread = exact_quantiles(
        df, {c: F.abs(F.col(c).cast("double") - F.lit(middle[c]).cast("double")) for c in columns}, [0.5]
    )
    rows = [(c, spread[c][0] / NORMAL_Q75 if spread[c][0] is not None else None) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, mad double")


def numeric_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, counts, moments, order statistics and robust spread of numeric columns."""
    quartiles = quantile_table(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    stats = discrete_stats(df, columns).select("column_name", "n_unique", "n_missing")
    kinds = df.sparkSession.createDataFrame(
        [(c, k) for c, k in df.dtypes if c in columns], "column_name string, type string"
    )
    top = modes(df, columns).groupBy("column_name").agg(
        F.min("mode").alias("first_mode"), F.count("*").alias("n_modes")
    )
    parts = [
        stats,
        quartiles.select("column_name", "median", (F.col("q75") - F.col("q25")).alias("iqr")),
        trimmed_means(df, columns),
        median_abs_deviation(df, columns, {r["column_name"]: r["median"] for r in quartiles.collect()}),
        top,
        kinds,
    ]
    return reduce(lambda a, b: a.join(b, "column_name"), parts, moments(df, columns, 3))


def category_report(df: DataFrame, columns: Sequence[str], max_modalities: int = 30) -> DataFrame:
    """The most frequent values of each column, and one "..." row for all others.

    Columns are taken one by one, so each list is a bounded top-k over its counts.
    """
    reports = []
    for c in columns:
        counts = value_frequencies(df, [c])
        total = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_kinds"))
        top = counts.orderBy(F.desc("n"), "value").limit(max_modalities)
        shown = top.agg(F.sum("n").alias("_shown"))
        rest = (
            total.transform(with_row, shown)
            .filter(F.col("_kinds") > max_modalities)
            .select(F.lit(c).alias("column_name"), F.lit("...").alias("value"), (F.col("_total") - F.col("_shown")).alias("n"))
        )
        reports.append(
            top.unionByName(rest)
            .transform(with_row, total)
            .select("column_name", "value", "n", (F.col("n") / F.col("_total")).alias("freq"))
        )
    return reduce(DataFrame.unionByName, reports)


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: type, count, and the numeric or the categorical summary."""
    numbers, texts = numeric_columns(df), string_columns(df)
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column_name string, type string")
    stats = discrete_stats(df, numbers + texts).select("column_name", "n", "n_unique")
    numeric = moments(df, numbers).select("column_name", "mean", "std", "min", "max").join(
        quantile_table(df, numbers, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "column_name"
    )
    top = (
        value_frequencies(df, texts)
        .groupBy("column_name")
        .agg(F.max(F.struct("n", "value")).alias("s"))
        .select("column_name", F.col("s.value").alias("top"), F.col("s.n").alias("freq"))
    )
    return kinds.join(stats, "column_name").join(numeric, "column_name", "left").join(top, "column_name", "left")


def rate_by_class(df: DataFrame, column: str, label: str = "target") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"), F.avg(label).alias("target_rate"))


def labelled_pairs(df: DataFrame, column: str, label: str = "target") -> DataFrame:
    return df.filter((F.col(label) > -1) & F.col(column).isNotNull()).select(column, label)


def quantile_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """1-based right-closed quantile bins; equal edges are merged."""
    edges = exact_quantiles(df, {column: F.col(column)}, [i / bins for i in range(bins + 1)])[column]
    edges = sorted(set(e for e in edges if e is not None))
    return df.withColumn(name, edge_bins(column, edges))


def target_rate(df: DataFrame, column: str, label: str = "target", bins: int = 10, quantiles: bool = False) -> DataFrame:
    """Label rate by class: the values of a text, or bins of a number."""
    pairs = labelled_pairs(df, column, label)
    if dict(pairs.dtypes)[column] == "string":
        return rate_by_class(pairs, column, label)
    if quantiles:
        binned = quantile_bins(pairs, column, bins)
    else:
        binned = equal_width_bins(pairs, column, bins, decimals=9)
    return rate_by_class(binned, "bin", label)


def weighted_freqs(df: DataFrame, column: str, weights: Sequence[str]) -> DataFrame:
    """Share of rows and of each weight per category."""
    grouped = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("count"), *[F.sum(w).alias(w) for w in weights]
    )
    totals = grouped.agg(*[F.sum(c).alias(f"_t_{c}") for c in ("count", *weights)])
    return grouped.transform(with_row, totals).select(
        column, *[F.try_divide(F.col(c), F.col(f"_t_{c}")).alias(f"{c}_share") for c in ("count", *weights)]
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Missing count and percentage of the columns that have any."""
    row = df.agg(
        F.count("*").alias("_rows"), *[(F.count("*") - F.count(c)).alias(c) for c in df.columns]
    )
    return (
        row.unpivot(["_rows"], df.columns, "column_name", "missing")
        .filter("missing > 0")
        .select("column_name", "missing", (100 * F.col("missing") / F.col("_rows")).alias("percent"))
    )


def predicate_profile(columns: Sequence[str], test, yes: str, no: str) -> Column:
    """One symbol per column: does the value pass the test."""
    return F.concat(*[F.when(test(F.col(c)), yes).otherwise(no) for c in columns])


def na_profile(columns: Sequence[str], missing: str = "◻", known: str = "◼") -> Column:
    return predicate_profile(columns, lambda c: c.isNull(), missing, known)


def pattern_cube(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Row counts of every combination of flags, each flag on, off or ignored.

    Rows are first counted per full combination, so the cube expands at most 2^k rows.
    """
    full = df.select(*[expr.alias(name) for name, expr in flags.items()]).groupBy(*flags).agg(
        F.count("*").alias("n")
    )
    return full.cube(*flags).agg(F.sum("n").alias("n"))


def constant_groups(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Whether the known values of a column are all equal within each group."""
    return df.groupBy(*keys).agg((F.min(column) == F.max(column)).alias("constant"))


def with_total(df: DataFrame, label_column: str, sums: Sequence[str], label: str = "total") -> DataFrame:
    total = df.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label_column, F.lit(label))
    return df.select(label_column, *sums).unionByName(total.select(label_column, *sums))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, place): the distinct values of each column in order."""
    values = value_frequencies(df, columns).select("column_name", "value")
    return ordered_prefix(values, [F.col("value")], {"place": F.lit(1)}, by=["column_name"])


def label_summary(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation with the label, and median per label class."""
    corr = df.agg(*[F.corr(c, label).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "corr")
    split = {
        f"{c}|{k}": F.when(F.col(label) == k, F.col(c)) for c in columns for k in (0, 1)
    }
    medians = exact_quantiles(df, split, [0.5])
    rows = [(c, medians[f"{c}|0"][0], medians[f"{c}|1"][0]) for c in columns]
    table = df.sparkSession.createDataFrame(rows, "column_name string, median_0 double, median_1 double")
    return corr.join(table, "column_name")


def label_of_missing(df: DataFrame, column: str, label: str) -> DataFrame:
    """Label distribution of the rows that miss a value, next to that of all labelled rows."""
    counts = df.filter(F.col(label) > -1).groupBy(label).agg(
        F.count_if(F.col(column).isNull()).alias("missing_rows"), F.count("*").alias("all_rows")
    )
    totals = counts.agg(F.sum("missing_rows").alias("_m"), F.sum("all_rows").alias("_a"))
    return counts.transform(with_row, totals).select(
        label, "missing_rows", "all_rows",
        F.try_divide("missing_rows", "_m").alias("missing_share"),
        F.try_divide("all_rows", "_a").alias("all_share"),
    )
