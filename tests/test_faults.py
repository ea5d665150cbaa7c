"""Cases that once gave wrong results."""

import math
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featmart.operators import columns, compare, keys, profiling, sequence
from featmart.plans import roles
from featmart.sources import sinks


def test_names_never_collide():
    assert columns.safe_names(["x", "x", "x_2", "X", "", "!?", "a b"]) == ["x", "x_2", "x_2_2", "X_3", "column", "column_2", "a_b"]


def test_nested_groups_take_turns():
    groups = columns.ColumnGroups({"a": ["p", "q"], "b": ["r", "a"], "c": [["a", ["x", "y", "z"]], "b"]})
    assert groups.flatten("c") == ["p", "x", "q", "y", "z", "r", "p", "q"]
    assert groups.flatten(["w", "a"]) == ["w", "p", "q"] and groups.flatten("w") == ["w"]


def test_different_columns_survive_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a", "c", "a"), (1, "a", "c", "a"), (2, "x", "x", "x")], "id int, u string, v string, w string")
    assert columns.drop_duplicate_columns(df, ["id"]).columns == ["id", "u", "v"]


def test_weighted_mean_of_a_long_series(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 != 3, (F.col("id") % 100).cast("double")).alias("x"))
    for alpha in (0.1, 0.5, 0.999):
        got = [r["ewm"] for r in sequence.ewm_mean(df, ["k"], "t", "x", alpha).orderBy("t").collect()]
        top = low = 0.0
        for t, value in enumerate(got):
            top, low = top * (1 - alpha), low * (1 - alpha)
            if t % 7 != 3:
                top, low = top + t % 100, low + 1
            assert math.isclose(value, top / low, rel_tol=1e-9, abs_tol=1e-9)


def test_keys_of_one_frame_only_are_reported(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 5.0)], "id int, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 3.0)], "id int, v double")
    got = sorted((str(r["id"]), r["present"], r["v_same"], r["v_diff"]) for r in compare.frame_diff(a, b, ["id"]).collect())
    assert got == [("1", "left", False, None), ("2", "both", False, 0.5), ("3", "right", False, None), ("None", "left", False, None)]
    assert [tuple(r) for r in compare.diff_counts(a, b, ["id"]).collect()] == [("v", 0, 4)]


def test_large_integers_stay_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,)], "v long")
    assert [r["n"] for r in profiling.modes(df, ["v"]).collect()] == [2]


def test_not_a_number_is_missing_in_role_views(spark, tmp_path):
    row = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(3)
    row.withColumn("c_acctbal", F.lit(float("nan"))).write.parquet(str(tmp_path / "customer.parquet"))
    assert roles.client(spark, str(tmp_path)).filter("balance IS NULL").count() == 3


def test_flags_of_repeated_and_null_keys(spark):
    main = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    side = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = sorted((str(r["k"]), r["here"]) for r in keys.membership_flags(main, {"here": side}, "k").collect())
    assert got == [("1", True), ("1", True), ("2", False), ("None", False)]


def test_pivot_covers_every_month(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 83, "b"), (2, 40, "c")], "k int, month long, s string")
    got = sequence.pivot_values(df, ["k"], "month", [F.max("s")], "m_")
    assert got.columns == ["k", "m_0", "m_40", "m_83"]


def plain_peaks(heights, distance):
    """Greedy by height, later ones first among equals."""
    found, i, n = [], 1, len(heights)
    while i < n - 1:
        j = i
        while j + 1 < n and heights[j + 1] == heights[i]:
            j += 1
        if heights[i - 1] < heights[i] and j + 1 < n and heights[j + 1] < heights[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (heights[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("levels, distance", [(4, 5), (1000, 30), (3, 1), (1, 3)])
def test_peaks_keep_their_distance(spark, levels, distance):
    rng = np.random.default_rng(levels)
    heights = rng.integers(0, levels, 700).tolist()
    # Gaps in the order do not count: positions do.
    df = spark.createDataFrame([(i * i, h) for i, h in enumerate(heights)], "x long, n long").repartition(5)
    got = sorted(r["position"] for r in sequence.peaks(df, "x", "n", distance).collect())
    assert got == plain_peaks(heights, distance)


def test_ewm_of_a_series_that_holds_most_rows(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=9000).round(3).tolist()
    rows = [("hot", i, None if i % 17 == 0 else v) for i, v in enumerate(values)] + [(None, i, 1.0) for i in range(5)] + [("b", 1, None), ("b", 2, 4.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(8)
    out = sequence.ewm_mean(df, ["k"], "t", "x", 0.3)
    assert out.columns == ["k", "t", "x", "ewm"]
    got = {(r["k"], r["t"]): r["ewm"] for r in out.collect()}
    assert len(got) == len(rows) and got["b", 1] is None and got["b", 2] == 4.0 and abs(got[None, 4] - 1) < 1e-12
    top = weight = 0.0
    for i, v in enumerate(values):
        top, weight = top * 0.7, weight * 0.7
        if i % 17:
            top, weight = top + v, weight + 1
        assert (got["hot", i] is None) if not weight else abs(got["hot", i] - top / weight) < 1e-9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(k" not in plan or all("_b" in w or "_block" in w for w in plan.split("windowspecdefinition(k")[1:])


def test_rows_outside_a_pivot_are_counted(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 9, "c"), (None, None, "d")], "k int, month int, s string")
    got = {r["k"]: tuple(r)[1:] for r in sequence.pivot_values(df, ["k"], "month", [F.max("s")], "m_", range(3), "outside").collect()}
    assert got == {1: ("a", None, "b", 1), None: (None, None, None, 1)}


def test_only_changed_files_are_built_again(spark, tmp_path):
    source, root = tmp_path / "source", str(tmp_path / "root")
    write = lambda name, rows: pd.DataFrame(rows, columns=["k", "v"]).to_parquet(source / f"{name}.parquet")
    source.mkdir()
    write("one", [(1, 1.0), (2, 2.0)])
    write("two", [(3, 3.0)])
    table = lambda: sinks.materialized_parts(spark, "t", {"times": 2}, str(source), lambda d: d.withColumn("v", d["v"] * 2), root)
    rows = lambda: sorted(map(tuple, table().select("k", "v").collect()))
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(root).rglob("parts/_file=*/*.parquet")}
    assert rows() == [(1, 2.0), (2, 4.0), (3, 6.0)]
    first = files()
    assert rows() == [(1, 2.0), (2, 4.0), (3, 6.0)] and files() == first
    write("three", [(4, 4.0)])
    assert rows() == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)]
    second = files()
    assert len(second) == len(first) + 1 and {p: second[p] for p in first} == first
    time.sleep(0.01)
    write("two", [(3, 30.0), (5, 5.0)])
    assert rows() == [(1, 2.0), (2, 4.0), (3, 60.0), (4, 8.0), (5, 10.0)]
    third = files()
    assert len(third) == len(second) + 1 and {p: third[p] for p in second} == second
    (source / "one.parquet").unlink()
    assert rows() == [(3, 60.0), (4, 8.0), (5, 10.0)]
