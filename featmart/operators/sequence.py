"""Series per key: runs, supports, pivots, lags, moving means and peaks.

Unless said otherwise the input is unique in (keys, order), as monthly tables are after
grouping. A key then holds at most one row per period, which bounds its window whatever
share of the raw rows it had.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.functions.runs import expand, support_positions
from featmart.operators.ordering import null_safe_join, ordered_prefix
from featmart.session import cut_lineage


def run_starts(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Mark, for each column, the rows where its value changes; one shared window."""
    series = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    position = F.row_number().over(series)
    return df.select(
        *keys, order, *columns,
        position.alias("_pos"),
        F.count("*").over(whole).alias("_size"),
        *[((position == 1) | ~F.col(c).eqNullSafe(F.lag(c).over(series))).alias(f"_new_{c}") for c in columns],
    )


def rle_runs(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """(keys, start, value, len) for each run; a run of nulls counts as a run.

    Run lengths are differences between the positions of change rows, so no second
    shuffle and no run number are needed.
    """
    series = Window.partitionBy(*keys).orderBy("_pos")
    starts = run_starts(df, keys, order, [column]).filter(F.col(f"_new_{column}"))
    following = F.lead("_pos").over(series)
    return starts.select(
        *keys,
        F.col(order).alias("start"),
        F.col(column).alias("value"),
        (F.coalesce(following, F.col("_size") + 1) - F.col("_pos")).alias("len"),
    )


def rle_all_columns(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """(keys, column_name, start, value, len): the runs of several columns at once.

    The change flags of all columns share one window; only change rows are stacked.
    """
    marked = run_starts(df, keys, order, columns)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), F.col(f"_new_{c}").alias("new"))
            for c in columns
        ]
    )
    changes = marked.select(
        *keys, order, "_pos", "_size", F.explode(F.filter(cells, lambda x: x["new"])).alias("_cell")
    )
    series = Window.partitionBy(*keys, "column_name").orderBy("_pos")
    return changes.select(*keys, order, "_pos", "_size", "_cell.column_name", "_cell.value").select(
        *keys,
        "column_name",
        F.col(order).alias("start"),
        "value",
        (F.coalesce(F.lead("_pos").over(series), F.col("_size") + 1) - F.col("_pos")).alias("len"),
    )


def rle_jumps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, start, jump, len): runs of the gaps between consecutive positions, from -1."""
    series = Window.partitionBy(*keys).orderBy(order)
    gaps = df.select(*keys, order, (F.col(order) - F.coalesce(F.lag(order).over(series), F.lit(-1))).alias("jump"))
    return rle_runs(gaps, keys, order, "jump").withColumnRenamed("value", "jump")


def tracking_period(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Support runs of the distinct periods of each key."""
    return rle_jumps(df.select(*keys, order).distinct(), keys, order)


def collect_runs(runs: DataFrame, keys: Sequence[str], field: str = "value", name: str = "runs") -> DataFrame:
    """The runs of each key as one array, in order; bounded by the number of periods."""
    ordered = F.array_sort(F.collect_list(F.struct("start", field, "len")))
    return runs.groupBy(*keys).agg(
        F.transform(ordered, lambda r: F.struct(r[field].alias(field), r["len"].alias("len"))).alias(name)
    )


def expand_runs(df: DataFrame, keys: Sequence[str], support: str, frame: str, order: str, value: str) -> DataFrame:
    """Original rows from a support and a frame."""
    cells = F.arrays_zip(support_positions(support).alias(order), expand(frame).alias(value))
    return df.select(*keys, F.explode(cells).alias("_cell")).select(
        *keys, F.col(f"_cell.{order}").alias(order), F.col(f"_cell.{value}").alias(value)
    )


def pivot_values(
    df: DataFrame, keys: Sequence[str], column: str, aggs: Sequence[Column], prefix: str, values: Sequence | None = None,
    outside: str | None = None,
) -> DataFrame:
    """Pivot over the values of `column`: all that occur, or the ones given.

    The values become columns, so they come from a bounded range such as months. With
    `outside` a column of that name counts each key's rows of no given value, so that none
    is left out unseen.
    """
    if values is None:
        values = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(*aggs)
    wide = wide.withColumnsRenamed({c: f"{prefix}{c}" for c in wide.columns if c not in keys})
    if outside is None:
        return wide
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return null_safe_join(wide, df.groupBy(*keys).agg(F.count_if(~listed).alias(outside)), keys)


def lag_diff(df: DataFrame, keys: Sequence[str], order: str, column: str, decimals: int = 4) -> DataFrame:
    series = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(column).over(series)
    return df.withColumns({f"{column}_before": before, f"{column}_diff": F.round(F.col(column) - before, decimals)})


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], first: bool = False) -> DataFrame:
    """Last (or first) row of each key by aggregation, which combines map-side."""
    pick = F.min if first else F.max
    row = pick(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns]))
    return df.groupBy(*keys).agg(row.alias("_row")).select(
        *keys, *[F.col(f"_row._{c}").alias(c) for c in columns]
    )


def ewm_mean(df: DataFrame, keys: Sequence[str], order: str, column: str, alpha: float, name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean of each series up to every row, weights normalised.

    A series is cut into blocks after which a weight has fallen by e^300. Weights restart
    with each block, so they never overflow, and a row's sums take in its own block and
    what the one before carries over; what lies further back weighs nothing in double
    precision. Rows are numbered by the ordered prefix, so a series may hold any share of
    all rows: a window never has more than one block.
    """
    decay = 1 - alpha
    block = max(1, math.ceil(300 / -math.log(decay))) if 0 < decay < 1 else 1
    placed = ordered_prefix(df, [F.col(order)], {"_n": F.lit(1)}, by=keys).withColumns(
        {"_b": F.floor((F.col("_n") - 1) / block), "_j": (F.col("_n") - 1) % block}
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    power = lambda exponent: F.pow(F.lit(float(decay)), exponent)
    values = {"_x": F.col(column).cast("double"), "_w": F.when(F.col(column).isNotNull(), F.lit(1.0))}
    # Each block's sums as they stand behind its last row; a block with a next one is full.
    carried = placed.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(
        *[F.sum(v * power(block - 1 - F.col("_j"))).alias(f"_c{n}") for n, v in values.items()]
    )
    joined = null_safe_join(placed, carried, [*keys, "_b"], "left")

    def total(name: str) -> Column:
        own = F.coalesce(F.sum(values[name] * power(-F.col("_j"))).over(inside) * power(F.col("_j")), F.lit(0.0))
        return own + F.coalesce(F.col(f"_c{name}") * power(F.col("_j") + 1), F.lit(0.0))

    sums = joined.withColumns({n: total(n) for n in values})
    return sums.withColumn(name, F.when(F.col("_w") > 0, F.col("_x") / F.col("_w"))).select(*df.columns, name)


def peaks(series: DataFrame, order: str, height: str, distance: int) -> DataFrame:
    """Peaks of a series, higher ones first, none nearer than `distance` positions to another.

    A peak is a value, or the middle of a level stretch, with lower neighbours on both sides;
    the ends are none. Of two peaks nearer than `distance` the lower one goes, of equal
    heights the earlier one, in the order of heights: a peak that has gone removes no other.
    Positions count rows along `order`, which is unique. Returns `order`, `height` and
    `position`.

    Each round keeps the peaks that are the first in reach among those left, and drops what
    they reach; a stretch of positions sees its neighbours within reach, so rounds are
    spread. A peak that stays in doubt waits for a higher one nearby, so rounds are as many
    as the longest such chain.
    """
    placed = ordered_prefix(series.select(order, height), [F.col(order)], {"position": F.lit(1)}).withColumn(
        "position", F.col("position") - 1
    )
    width = max(20 * distance, 1 << 12)

    def stretches(df: DataFrame, reach: int) -> DataFrame:
        home = F.floor(F.col("position") / width)
        near = [F.floor((F.col("position") + d) / width) for d in (-reach, 0, reach)]
        return df.withColumn("_home", home).withColumn("_stretch", F.explode(F.array_distinct(F.array(*near))))

    # Level stretches are one entry each: they begin where the value changes.
    line = Window.partitionBy("_stretch").orderBy("position")
    changes = stretches(placed, 1).withColumn("_before", F.lag(height).over(line)).filter("_home = _stretch")
    begins = changes.filter(F.col("position").isin(0) | ~F.col(height).eqNullSafe(F.col("_before"))).select(order, height, "position")
    numbered = ordered_prefix(begins, [F.col("position")], {"_run": F.lit(1)})
    around = [
        numbered.select((F.col("_run") + d).alias("_run"), F.col(height).alias(f"_h{i}"), F.col("position").alias(f"_p{i}"))
        for i, d in enumerate((1, -1))
    ]
    runs = numbered.join(around[0], "_run").join(around[1], "_run").filter((F.col(height) > F.col("_h0")) & (F.col(height) > F.col("_h1")))
    middle = F.floor((F.col("position") + F.col("_p1") - 1) / 2)
    left = cut_lineage(runs.select(F.col(height).alias("_height"), middle.alias("position")))
    kept: list[DataFrame] = []
    while not left.isEmpty():
        # Higher first; of equal heights the later one.
        rank = F.struct("_height", "position")
        reach = Window.partitionBy("_stretch").orderBy("position").rangeBetween(1 - distance, distance - 1)
        top = cut_lineage(
            stretches(left, distance).withColumn("_top", F.max(rank).over(reach)).filter("_home = _stretch")
            .withColumn("_keeps", F.col("_top.position") == F.col("position")).drop("_top", "_home", "_stretch")
        )
        kept.append(top.filter("_keeps").select("position"))
        gone = F.max(F.col("_keeps").cast("int")).over(reach)
        left = cut_lineage(stretches(top, distance).withColumn("_gone", gone).filter("_home = _stretch AND _gone = 0").select("_height", "position"))
    found = reduce(DataFrame.unionByName, kept) if kept else left.select("position")
    return placed.join(found, "position").select(order, height, "position")


def value_count_peaks(df: DataFrame, column: str, distance: int) -> DataFrame:
    """(x, n, spacing): peaks of the counts per value, as `peaks` has them, and how far each
    value is from the peak before."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("x")).agg(F.count("*").alias("n"))
    found = peaks(counts, "x", "n", distance).select("x", "n")
    # At most one peak per `distance` positions: a small table, ordered by one sort.
    return found.withColumn("spacing", F.col("x") - F.lag("x").over(Window.orderBy("x")))


def count_peaks(df: DataFrame, column: str, distance: int) -> DataFrame:
    """Values whose count is the highest within ±distance, and the spacing between them.

    Counts are cut into stretches of values; each stretch also sees the counts within
    `distance` of its ends, so the work is spread and the windows stay exact. A peak
    needs a neighbour on either side; of equal heights the first one counts.
    """
    width = max(20 * distance, 1)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("x")).agg(
        F.count("*").alias("n")
    )
    home = F.floor(F.col("x") / width)
    copies = F.array_distinct(
        F.array(F.floor((F.col("x") - distance) / width), home, F.floor((F.col("x") + distance) / width))
    )
    placed = counts.withColumn("home", home).select("*", F.explode(copies).alias("stretch"))
    line = Window.partitionBy("stretch").orderBy("x")
    before = F.max("n").over(line.rangeBetween(-distance, -1))
    after = F.max("n").over(line.rangeBetween(1, distance))
    peaks = (
        placed.withColumns({"_before": before, "_after": after})
        .filter((F.col("home") == F.col("stretch")) & (F.col("n") > F.col("_before")) & (F.col("n") >= F.col("_after")))
        .select("x", "n")
    )
    # At most one peak per `distance` values: a small table, ordered by one sort.
    ordered = Window.orderBy("x")
    return peaks.withColumn("spacing", F.col("x") - F.lag("x").over(ordered))


def transposed_history(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """(keys, variable, order, value) of the variables with any known, non-zero value."""
    long = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*keys, order], list(columns), "variable", "value"
    )
    any_value = F.max(F.abs("value")).over(Window.partitionBy(*keys, "variable"))
    return long.withColumn("_any", any_value).filter(F.col("_any") > 0).drop("_any")
