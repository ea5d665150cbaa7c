"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from featmart.functions import runs, scalars
from featmart.operators import (
    aggregate, cleaning, columns, compare, credit, keys, neighbors, profiling, scoring, sequence,
)
from featmart.sources import sinks, slices, tables


def column_of(spark, rows, kind, expr, name="x"):
    df = spark.createDataFrame([(r,) for r in rows], f"{name} {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_status_priority(spark):
    got = column_of(spark, ["Active and Completed", "Signed and Demand", "Unknown", None], "string",
                    scalars.status_by_priority("x"))
    assert got == ["Active", "Signed", "Unknown", None]


def test_rle_of_rows_and_arrays(spark):
    for values, want in (
        ([7, 5, 5, 7, 7, 7, 9, 5], [(7, 1), (5, 2), (7, 3), (9, 1), (5, 1)]),
        (["late", None, None, None, "paid", "paid", None], [("late", 1), (None, 3), ("paid", 2), (None, 1)]),
    ):
        text = [None if v is None else str(v) for v in values]
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(text)], "k int, m long, v string")
        got = sequence.rle_runs(df, ["k"], "m", "v").orderBy("start").collect()
        assert [(r["value"], r["len"]) for r in got] == [(None if v is None else str(v), n) for v, n in want]
        arr = spark.createDataFrame([(text,)], "a array<string>").select(runs.array_runs("a").alias("r")).first()["r"]
        assert [(r["value"], r["len"]) for r in arr] == [(None if v is None else str(v), n) for v, n in want]


@pytest.mark.parametrize("months,want", [
    ([0, 1, 2, 3, 4, 5], [(1, 6)]), ([0, 1, 3, 4, 5], [(1, 2), (2, 1), (1, 2)]), ([0], [(1, 1)]),
])
def test_jumps(spark, months, want):
    df = spark.createDataFrame([(1, m) for m in months], "k int, m long")
    got = sequence.rle_jumps(df, ["k"], "m").orderBy("start").collect()
    assert [(r["jump"], r["len"]) for r in got] == want


RUN = "array<struct<value:string,len:bigint>>"
JUMP = "array<struct<jump:bigint,len:bigint>>"


def test_expand(spark):
    df = spark.createDataFrame([([("0", 1), ("1", 2), ("2", 3)],)], f"r {RUN}")
    assert df.select(runs.expand("r")).first()[0] == ["0", "1", "1", "2", "2", "2"]


def test_dense_row(spark):
    schema = f"s {JUMP}, f {RUN}"
    df = spark.createDataFrame([([(2, 2), (4, 1)], [("C", 2), ("0", 1)])], schema)
    full = [None, "C", None, "C", None, None, None, "0"]
    for width, want in ((None, full), (8, full), (11, full + [None] * 3), (4, full[:4]), (0, [])):
        assert df.select(runs.dense_row("s", "f", width)).first()[0] == want
    assert [df.select(runs.cut_cells("s", w)).first()[0] for w in (8, 4, 1)] == [0, 1, 3]
    empty = spark.createDataFrame([(None, None)], schema)
    assert empty.select(runs.dense_row("s", "f", 3)).first()[0] in ([None] * 3, None)


def test_support_measures(spark):
    df = spark.createDataFrame([([(2, 1), (1, 2), (3, 1)],)], f"s {JUMP}")
    got = df.select(runs.support_size("s"), runs.support_min("s"), runs.support_max("s"), runs.support_holes("s")).first()
    assert tuple(got) == (4, 1, 6, 2)


def test_divide(spark):
    rows = [([("C", 3), ("0", 2), ("1", 1), (None, 4)],), ([("0", 2)],), ([(None, 5)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"r {RUN}")
    got = [tuple(r)[:3] for r in df.select(runs.divide("r").alias("d")).select("d.*").collect()]
    assert got == [(3, 3, 4), (0, 2, 0), (5, 0, 5), (0, 0, 0), (0, 0, 0)]


def test_rle_round_trip(spark, sf):
    from featmart.plans import catalog, roles

    got = catalog.PLANS["rle_expand"](spark, sf)
    want = roles.monthly(spark, sf).select("loan_id", "month", F.nullif("status", F.lit("X")).alias("status"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_median_imputation(spark):
    # The median of the labelled values fills the gaps of all rows.
    df = spark.createDataFrame([(7.5, 0), (None, -1), (3.0, 1), (100.0, -1), (9.0, 1)], "f double, target int")
    assert [r["f"] for r in cleaning.impute_median(df, ["f"], "target").collect()] == [7.5, 7.5, 3.0, 100.0, 9.0]


def test_infinity_counts_as_a_gap(spark):
    df = spark.createDataFrame([(float("inf"), 1), (2.0, 0), (4.0, 0)], "f double, target int")
    assert [r["f"] for r in cleaning.impute_median(df, ["f"], "target").collect()] == [3.0, 2.0, 4.0]


def test_long_tail(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1, 2, 1, 2, 3, 1, 1, None])], "i int, v int")
    got = profiling.reduce_long_tail(df, "v", 0.5).orderBy("i").collect()
    assert [r["v"] for r in got] == [None, "1", "2:3", "1", "2:3", "2:3", "1", "1", None]
    alone = profiling.reduce_long_tail(df, "v", 0.2).orderBy("i").collect()
    assert [r["v"] for r in alone] == [None, "1", "2", "1", "2", "3", "1", "1", None]


def test_discrete_stats(spark):
    df = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "dog"), (None, "dog")], "a int, b string")
    got = {r["column_name"]: r for r in profiling.discrete_stats(df).collect()}
    assert (got["a"]["n"], got["a"]["n_unique"], got["a"]["n_missing"], got["a"]["fill_rate"]) == (3, 3, 1, 0.75)
    assert got["b"]["diversity"] == 0.5


def test_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    got = profiling.moments(df, ["x"], 6).first()
    assert (got["skew"], got["kurt"], got["var"]) == (1.469335, 2.030769, 16.25)


def test_ewm(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], "k int, m int, x double")
    got = sequence.ewm_mean(df, ["k"], "m", "x", 0.1).orderBy("m").collect()
    assert math.isclose(got[-1]["ewm"], 2.070110701107011, rel_tol=1e-12)


def test_trimmed_mean_with_ties(spark):
    values = [1.0] * 5 + [2.0, 3.0, 4.0, 50.0, 60.0] + [2.5] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = sorted(values)[2:-2]
    assert math.isclose(profiling.trimmed_means(df, ["x"]).first()["trim_mean"], sum(kept) / len(kept))


def test_frame_diff(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None), (5, None)], "k int, s string")
    b = spark.createDataFrame([(1, "A"), (2, "D"), (3, "C"), (4, "X"), (5, None)], "k int, s string")
    got = {r["k"]: r["s_same"] for r in compare.frame_diff(a, b, ["k"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_checked_cast_stops_on_a_bad_value(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    with pytest.raises(Exception, match="cannot cast s"):
        cleaning.checked_cast(df, {"s": "int"}).collect()
    assert cleaning.cast_report(df, {"s": "int"}).first()["failures"] == 1


def test_forward_fill_stays_in_the_key(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, None), (2, 1, "b")], "k int, m int, s string")
    got = {(r["k"], r["m"]): r["s"] for r in cleaning.forward_fill(df, ["k"], "m", ["s"]).collect()}
    assert got == {(1, 0): "a", (1, 1): "a", (2, 0): None, (2, 1): "b"}


def test_month_of_days(spark):
    got = column_of(spark, [0, 30, 31, 61], "int", scalars.month_of_days("x"))
    assert got == [0, 0, 1, 2]
    assert column_of(spark, [0, 30, 31], "int", scalars.month_of_days("x", "up")) == [0, 1, 2]


def test_names_and_groups():
    assert columns.safe_names(["a b", "a-b", "(c)"]) == ["a_b", "a_b_2", "c"]
    groups = columns.ColumnGroups({"p": ["x", "y"], "q": ["u"], "all": ["k", ["p", "q"]]})
    assert groups.flatten("all") == ["k", "x", "u", "y"]


def test_table_errors(spark, sf):
    with pytest.raises(tables.UnknownFormat):
        tables.scan(spark, sf, "orders", "xlsx")
    with pytest.raises(tables.MissingTable):
        tables.scan(spark, sf, "nothing")


def test_row_ranges_follow_slice_rules(spark):
    df = spark.range(50)
    for start, stop in ((0, 5), (10, 20), (-5, None), (-10, -3), (45, 100), (7, None), (None, None)):
        got = sorted(r["id"] for r in slices.row_range(df, [F.col("id")], start, stop).collect())
        assert got == list(range(50))[start:stop], (start, stop)


def test_materialized_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for params in ({"a": 1, "b": 2}, {"b": 2, "a": 1}):
        assert sinks.materialized(spark, "t", params, build, root=str(tmp_path)).count() == 3
    assert len(calls) == 1
    sinks.materialized(spark, "t", {"a": 2}, build, root=str(tmp_path))
    assert len(calls) == 2


def test_subset_agg_equals_filter_and_join(spark, sf):
    from featmart.plans import mart, roles

    loans = mart.with_dummies(roles.loan(spark, sf))
    one_pass = mart.loans_to_client(spark, sf)
    three = aggregate.rule_agg(loans, ["client_id"], mart.LOAN_RULES, "prev", 6)
    for name, status in (("approved", "F"), ("refused", "P")):
        part = aggregate.rule_agg(loans.filter(F.col("status") == status), ["client_id"], mart.LOAN_RULES, name, 6)
        three = three.join(part, "client_id", "left")
    counts = compare.diff_counts(one_pass, three, ["client_id"])
    assert counts.filter("different > 0").isEmpty()


def test_last_version_with_a_hot_instalment(spark):
    rows = [(1, 1, 1, v, 100, d, 10.0, 5.0) for v in (0, 1) for d in range(200)]
    rows += [(2, i, 1, 0, 90, 80, 10.0, None) for i in range(2, 100)]
    df = spark.createDataFrame(
        rows, "client_id long, loan_id long, number int, version long, due_day long, paid_day long, due double, paid double"
    )
    plain = credit.last_version(df)
    spread = credit.last_version(df.repartition(5))
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()
    assert plain.filter("loan_id = 1").agg(F.count("*"), F.max("fragment")).first() == (200, 199)


def test_expected_delay_sign(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0, 100, 90, 10.0, 10.0)],
        "client_id long, loan_id long, number int, version long, due_day long, paid_day long, due double, paid double",
    )
    repaid = credit.repaid_last_version(df, credit.days_past_due(), "dpd")
    got = credit.expected_delay(repaid, credit.loan_amount(df), ["client_id", "loan_id"], "dpd", "loan_amount").first()
    assert got["expected_dpd"] == 10.0


def test_key_overlap_counts_each_key_once(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(3,), (4,), (4,)], "k int")
    assert tuple(keys.key_overlap(a, b, "k").first()) == (3, 2, 2, 1)
    assert keys.relation_arity(a, b, "k").first()["arity"] == "[A](0..1)--(0..1)[B]"


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert scoring.auc(df, "y", "s").first()["auc"] == 0.875


def test_nearest_is_exact_over_many_boxes(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    # Two thirds of the points in one dense spot, many of them identical.
    x = np.concatenate([rng.normal(0, 0.01, (200, 2)).round(2), rng.uniform(-5, 5, (100, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in neighbors.nearest(df, df, 3, box_rows=25).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["d2"]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i, row in enumerate(np.sort(d, axis=1)[:, :3]):
        assert np.allclose([got[i][p] for p in range(3)], row), i


def test_smote_balances_and_stays_between(spark):
    rows = [(i, [float(i), 1.0], 1 if i < 10 else 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    made = neighbors.smote(df, k=3).collect()
    assert len(made) == 30
    assert all(0 <= r["x"][0] <= 9 and r["x"][1] == 1.0 for r in made)


def test_key_order_spreads_a_hot_key(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    # Small partitions would be coalesced into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = sinks.save_by_key(df.repartition(8), str(tmp_path / "t"), "k", "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(path)
    assert back.count() == 20_000
    hot = back.filter("k = 5").select(F.input_file_name().alias("f")).distinct().count()
    assert hot > 1
