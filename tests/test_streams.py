"""Streams over folders of files, late rows, and runs that end by themselves."""

import math
from bisect import bisect_right
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from featmart.streaming import streams

START = datetime(2024, 1, 1)


def folder_of(spark, path, files):
    """A table whose files arrive in the given order."""
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    for rows in files:
        spark.createDataFrame([(i, u, e, START + timedelta(days=d)) for i, u, e, d in rows], schema).coalesce(1).write.mode(
            "append").parquet(f"{path}/events.parquet")
    # Another table whose name begins alike is not part of the stream.
    spark.createDataFrame([(9, 9, "x", START)], schema).write.parquet(f"{path}/events_old.parquet")
    return str(path)


def test_folder_table_streams_all_rows(spark, tmp_path):
    folder = folder_of(spark, tmp_path, [[(1, 1, "a", 0)], [(2, 1, "a", 1), (3, 2, "b", 2)]])
    rows = streams.table_stream(spark, folder, "events")
    assert sorted(r[0] for r in streams.run_available(rows.select("event_id"), "ids").collect()) == [1, 2, 3]


def test_windows_drop_late_rows_and_report_drift(spark, tmp_path):
    # A batch's watermark holds for late rows from the next batch on.
    files = [[(1, 1, "a", 0.1), (2, 1, "b", 0.2)], [(3, 1, "a", 5)], [(6, 1, "a", 5.5)], [(4, 1, "a", 0.3), (5, 1, "b", 9)]]
    rows = streams.table_stream(spark, folder_of(spark, tmp_path, files), "events", "ts", files_per_trigger=1)
    drift = streams.windowed_drift(rows, "ts", "event_type", {"a": 0.5, "b": 0.5}, length="1 day")
    got = {r["start"].day: (r["n"], r["psi"], r["drifted"]) for r in streams.run_available(drift, "drift").collect()}
    assert got[1] == (2, 0.0, False)
    assert got[6][0] == 2 and got[6][1] > 0.2 and got[6][2]


def test_last_run_leaves_by_timer(spark, tmp_path):
    files = [
        [(1, 1, "a", 0.1), (2, 1, "a", 1.1), (3, 2, "a", 0.2)],
        [(4, 2, "a", 3), (5, 2, "b", 4)],
        [(6, 3, "z", 14)], [(7, 3, "z", 28)], [(8, 3, "z", 29)],
    ]
    rows = streams.table_stream(spark, folder_of(spark, tmp_path, files), "events", "ts", files_per_trigger=1)
    days = streams.last_status_per_day(rows, "user_id", "ts", F.col("event_type"), "event_id")
    got = {(r["user_id"], r["value"], r["length"]) for r in streams.run_available(streams.closed_runs(days, "user_id"), "runs").collect()}
    assert {(1, "a", 2), (2, "a", 2), (2, "b", 1)} <= got


def test_categories_that_the_reference_lacks_are_drift(spark, tmp_path):
    files = [[(1, 1, "a", 0.1), (2, 1, "b", 0.2)], [(3, 1, "a", 1.1), (4, 1, "b", 1.2), (5, 1, "new", 1.3), (6, 1, "newer", 1.4)], [(7, 1, "a", 9)]]
    rows = streams.table_stream(spark, folder_of(spark, tmp_path, files), "events", "ts", files_per_trigger=1)
    drift = streams.windowed_drift(rows, "ts", "event_type", {"a": 0.5, "b": 0.5}, length="1 day")
    got = {r["start"].day: r["psi"] for r in streams.run_available(drift, "unseen").collect()}
    seen = 2 * (0.25 - 0.5) * math.log(0.25 / 0.5)
    assert got[1] == 0.0
    assert abs(got[2] - seen - (0.5 - 1e-4) * math.log(0.5 / 1e-4)) < 1e-6


def test_numeric_drift_is_within_the_sketches_error(spark, tmp_path):
    """Windows of many rows, of few, with ties, nulls and NaN; late rows are dropped."""
    def rows(day, values):
        return [(START + timedelta(days=day, seconds=i % 80_000), v) for i, v in enumerate(values)]

    hot = [(i * 37 % 20_011) / 20_011 for i in range(60_000)]
    files = [
        rows(0, hot), rows(1, [v * v for v in hot[:6000]] + [None, math.nan]), rows(2, [0.25] * 50), rows(3, [None]),
        rows(20, [0.5]), rows(20, [0.5]), rows(0, [9.0] * 500) + rows(30, [0.1]),
    ]
    for part in files:
        frame = spark.createDataFrame(part, "ts timestamp_ntz, x double")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/numbers.parquet")
    reference = spark.createDataFrame([(i / 9973,) for i in range(9973)], "x double")
    stream = streams.table_stream(spark, str(tmp_path), "numbers", "ts", files_per_trigger=1)
    drift = streams.windowed_ks(stream, "ts", ["x"], reference, length="1 day", threshold=0.2)
    got = {r["start"].day: (r["n"], r["ks"], r["drifted"]) for r in streams.run_available(drift, "ks").collect()}

    base = [i / 9973 for i in range(9973)]

    def exact(values):
        one, two = sorted(values), base
        return max(abs(bisect_right(one, x) / len(one) - bisect_right(two, x) / len(two)) for x in {*one, *two})

    limit = 4 * streams.RANK_ERROR + 1 / streams.RANKS
    assert got[1][0] == 60_000 and abs(got[1][1] - exact(hot)) <= limit and not got[1][2]
    assert got[2][0] == 6000 and abs(got[2][1] - exact([v * v for v in hot[:6000]])) <= limit and got[2][2]
    assert got[3][0] == 50 and abs(got[3][1] - exact([0.25] * 50)) <= limit and got[3][2]
    assert got[4] == (0, None, None)


def test_numeric_drift_against_an_empty_reference(spark, tmp_path):
    for day in (0, 5, 9):
        spark.createDataFrame([(START + timedelta(days=day), 1.0)], "ts timestamp_ntz, x double").coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/numbers.parquet")
    stream = streams.table_stream(spark, str(tmp_path), "numbers", "ts", files_per_trigger=1)
    empty = spark.createDataFrame([], "x double")
    got = streams.run_available(streams.windowed_ks(stream, "ts", ["x"], empty, length="1 day"), "ks").collect()
    assert got and all(r["ks"] is None and r["n"] == 1 for r in got)
