"""Incremental forms: windowed error reports, runs that are emitted as they close, enrichment.

All of them run in append mode with bounded state: late rows beyond the watermark are
dropped, and a window or a run is written once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from featmart.session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, ts: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A table as a stream, from its own path, be it one file or a folder of files; `ts` is
    made a zoned timestamp so that it can carry a watermark."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A stream takes a single file only through a pattern; this one matches no other name.
    exactly = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(exactly)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all input that is there, into a Parquet table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    # Processors with state variables need this store; the others run on it as well.
    spark.conf.set(STATE_STORE, ROCKSDB)
    running = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{path}/rows")
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def windowed_errors(
    stream: DataFrame, ts: str, actual: str, predicted: str, length: str = "1 day", late: str = "1 day",
    decimals: int = 6,
) -> DataFrame:
    """Mean and mean absolute error per tumbling window, written when the watermark passes it."""
    error = F.col(predicted) - F.col(actual)
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, length).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(error), decimals).alias("me"),
            F.round(F.avg(F.abs(error)), decimals).alias("mae"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "me", "mae")
    )


def windowed_shares(stream: DataFrame, ts: str, category: str, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Category counts per tumbling window: the input of a drift test against a reference."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, length).alias("w"), category)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), category, "n")
    )


def windowed_drift(
    stream: DataFrame, ts: str, category: str, reference: Mapping[str, float], length: str = "7 days", late: str = "1 day",
    decimals: int = 6, threshold: float = 0.2, floor: float = 1e-4,
) -> DataFrame:
    """Population stability index of a category per tumbling window against reference shares.

    Shares below `floor`, on either side, count as `floor`. Values that the reference lacks
    are one more category, whose reference share is `floor`. `drifted` is set from the
    threshold on. Each window is one row of counts while it is open.
    """
    counts = {f"_n{i}": F.count_if(F.col(category) == value) for i, value in enumerate(reference)}
    windows = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, length).alias("w"))
        .agg(F.count(category).alias("n"), *[c.alias(name) for name, c in counts.items()])
    )
    terms = []
    for name, share in zip(counts, reference.values()):
        now, then = F.greatest(F.col(name) / F.col("n"), F.lit(floor)), max(share, floor)
        terms.append((now - then) * F.log(now / then))
    unseen = F.col("n") - reduce(lambda a, b: a + b, [F.col(name) for name in counts], F.lit(0))
    now = F.greatest(unseen / F.col("n"), F.lit(floor))
    terms.append((now - floor) * F.log(now / F.lit(floor)))
    index = F.when(F.col("n") > 0, F.round(reduce(lambda a, b: a + b, terms), decimals))
    return windows.select(F.col("w.start").alias("start"), "n", index.alias("psi"), (index >= threshold).alias("drifted"))


#: Accuracy of a drift sketch: items of its widest level, and the ranks at which two
#: distributions are compared. Ranks are then off by 0.3 % at most, with 99 % confidence.
SKETCH_ITEMS, RANKS = 1024, 400
RANK_ERROR = 0.003


def _value(column: str) -> Column:
    """The number that counts: null if there is none."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _sketch(column: str) -> Column:
    return F.kll_sketch_agg_double(_value(column), F.lit(SKETCH_ITEMS))


def _points(reference: DataFrame, columns: Sequence[str]) -> dict[str, tuple[list[float], list[float]]]:
    """For each column with values, where distributions are compared, and the reference's
    ranks there: its quantiles, and what comes right before each of them.

    Between two of these points the reference rises by 1 / RANKS at most and the other
    distribution is monotone, so that no distance between them is larger by more than that.
    """
    ranks = F.array(*[F.lit(i / RANKS) for i in range(RANKS + 1)])
    row = reference.agg(*[_sketch(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    one = reference.sparkSession.range(1)
    sizes = one.select(*[F.kll_sketch_get_n_double(F.lit(s)) for s in row]).first()
    known = [(c, s) for c, s, n in zip(columns, row, sizes) if n]
    if not known:
        return {}
    edges = one.select(*[F.kll_sketch_get_quantile_double(F.lit(s), ranks) for _, s in known]).first()
    points = [sorted({x for e in found for x in (e, math.nextafter(e, -math.inf))}) for found in edges]
    there = one.select(*[F.kll_sketch_get_rank_double(F.lit(s), _numbers(p)) for (_, s), p in zip(known, points)]).first()
    return {c: (p, r) for (c, _), p, r in zip(known, points, there)}


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def windowed_ks(
    stream: DataFrame, ts: str, columns: Sequence[str], reference: DataFrame, length: str = "7 days", late: str = "1 day",
    threshold: float = 0.2, decimals: int = 6,
) -> DataFrame:
    """(start, column_name, n, ks, drifted): Kolmogorov-Smirnov distance of each numeric column
    of a tumbling window from the rows of `reference`.

    A window's state is a count and one mergeable KLL sketch per column, whatever its rows;
    sketches combine map-side, so a window that holds most rows moves as a few sketches. The
    distance is within 4 * RANK_ERROR + 1 / RANKS of the exact one. Nulls and NaN do not
    count; a window or a reference without values has a null distance. Late rows are dropped.
    """
    sketches = [f"_s{i}" for i in range(len(columns))]
    counts = [f"_n{i}" for i in range(len(columns))]
    base = _points(reference, columns)
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w")).agg(
        *[_sketch(c).alias(s) for c, s in zip(columns, sketches)],
        *[F.count(_value(c)).alias(n) for c, n in zip(columns, counts)],
    )
    cells = []
    for c, s, n in zip(columns, sketches, counts):
        ks = F.lit(None).cast("double")
        if c in base:
            points, there = base[c]
            # An empty sketch has no ranks.
            here = F.kll_sketch_get_rank_double(F.when(F.col(n) > 0, F.col(s)), _numbers(points))
            ks = F.round(F.array_max(F.zip_with(here, _numbers(there), lambda a, b: F.abs(a - b))), decimals)
        cells.append(F.struct(F.lit(c).alias("column_name"), F.col(n).alias("n"), ks.alias("ks")))
    long = windows.select(F.col("w.start").alias("start"), F.explode(F.array(*cells)).alias("c")).select("start", "c.*")
    return long.withColumn("drifted", F.col("ks") >= threshold)


def last_status_per_day(stream: DataFrame, key: str, ts: str, status: Column, order: str, late: str = "1 day") -> DataFrame:
    """(key, day, status): the last status of each key and day, once the day is over.

    The aggregate combines map-side, so a hot key is one row per day and task from here on.
    """
    return (
        stream.withColumn("_status", status)
        .withWatermark(ts, late)
        .groupBy(key, F.window(ts, "1 day").alias("w"))
        .agg(F.max_by("_status", order).alias("status"))
        .select(key, F.col("w.start").alias("day"), "status", F.window_time("w").alias("over"))
    )


DAY_MS = 86_400_000


class OpenRun(StatefulProcessor):
    """State of one key: its open run (value, length, start, last day).

    A run ends with another status or after `idle` days without one. An event-time timer
    emits the last run of a key and clears its state, so that no key is kept for ever.
    """

    def __init__(self, key: str, idle: int):
        self.columns = [key, "start", "value", "length"]
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "value string, length long, start timestamp, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        value, length, start, last = self.run.get() if self.run.exists() else (None, 0, None, None)
        out = []
        for day, status in zip(days["day"], days["status"]):
            near = last is not None and (day - last).days <= self.idle
            if length and near and status == value:
                length += 1
                last = day
                continue
            if length:
                out.append((key[0], start, value, length))
            value, length, start, last = status, 1, day, day
        self.run.update((value, length, start, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + (self.idle + 1) * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            value, length, start, _ = self.run.get()
            self.run.clear()
            yield pd.DataFrame([(key[0], start, value, length)], columns=self.columns)

    def close(self) -> None:
        pass


def closed_runs(days: DataFrame, key: str, idle: int = 7) -> DataFrame:
    """Runs of equal status along the days of each key, emitted when they have ended.

    Days arrive in watermark order, at most one row per key and day; those of one trigger
    are sorted before they are folded into the open run.
    """
    return days.groupBy(key).transformWithStateInPandas(
        statefulProcessor=OpenRun(key, idle),
        outputStructType=f"{key} long, start timestamp, value string, length long",
        outputMode="Append",
        timeMode="EventTime",
    )


def enrich(stream: DataFrame, client: DataFrame, on: str, label: str = "target", unknown: int = -1) -> DataFrame:
    """Stream rows with the label of their client from a static table."""
    return stream.join(client, on, "left").withColumn(label, F.coalesce(F.col(label), F.lit(unknown)))

