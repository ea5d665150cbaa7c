"""Ordering primitives: the spread path must equal the plain one, hot keys included."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from featmart.operators import association, ordering, sampling
from featmart.sources import slices


def hot_rows(spark):
    """One key holds a third of the rows and one value is shared by many."""
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(50), float(rng.choice([1, 1, 1, 2, 3, 5.5, 8]))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k int, v double").repartition(6)


def test_ordered_prefix_equals_window(spark):
    df = hot_rows(spark)
    got = ordering.ordered_prefix(df, [F.col("id")], {"n": F.lit(1), "s": F.col("v")}, by=["k"])
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count("*").over(w), "s": F.sum("v").over(w)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordered_prefix_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string")
    got = {r["id"]: r["n"] for r in ordering.ordered_prefix(df, [F.col("id")], {"n": F.lit(1)}, by=["k"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_occurrence_index_of_hot_key(spark):
    df = hot_rows(spark)
    spread = ordering.occurrence_index(df, ["k"], [F.col("id")])
    plain = df.withColumn("occurrence", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))


def test_occurrence_index_golden(spark):
    for values, want in (
        ([40, None, 40, 7, None, 40], [0, 0, 1, 0, 1, 2]),
        ([2, 2, 9, 2, 9, -4, 2], [0, 1, 0, 2, 1, 0, 3]),
    ):
        df = spark.createDataFrame(list(enumerate(values)), "pos int, v int")
        got = ordering.occurrence_index(df, ["v"], [F.col("pos")]).orderBy("pos").collect()
        assert [r["occurrence"] for r in got] == want


def test_exact_quantiles_by_selection(spark):
    df = hot_rows(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    columns = {"v": F.col("v"), "id": F.col("id"), "none": F.lit(None).cast("double")}
    rows = df.collect()
    for buckets in (None, 16):
        got = ordering.exact_quantiles(df, columns, probs, buckets=buckets)
        assert np.allclose(got["v"], np.quantile([r["v"] for r in rows], probs))
        assert np.allclose(got["id"], np.quantile([r["id"] for r in rows], probs))
        assert got["none"] == [None] * len(probs)


def test_selection_is_exact_for_large_integers_and_shared_values(spark):
    big = 2**60
    rows = [(big + i % 700,) for i in range(2000)]
    df = spark.createDataFrame(rows, "v long").repartition(4)
    ranks = [0, 7, 999, 1000, 1998]
    want = sorted(r[0] for r in rows)
    assert ordering.order_statistics(df, {"v": F.col("v")}, {"v": ranks}, buckets=4)["v"] == {r: want[r] for r in ranks}
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(1000, 2.5), rng.lognormal(3, 2, 2000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = ordering.order_statistics(df, {"v": F.col("v")}, {"v": [0, 10, 700, 1500, 2999]}, buckets=4)["v"]
    assert got == {r: np.sort(values)[r] for r in (0, 10, 700, 1500, 2999)}


def test_order_statistics(spark):
    df = hot_rows(spark)
    values = sorted(r["v"] for r in df.collect())
    got = ordering.order_statistics(df, {"v": F.col("v")}, {"v": [0, 300, 1500, 2999]}, buckets=8)["v"]
    assert got == {r: values[r] for r in (0, 300, 1500, 2999)}


def test_hash_rank_is_a_rank_in_each_class(spark):
    df = hot_rows(spark)
    ranked = ordering.hash_rank(df, "id", by=["k"], buckets=8)
    for key, ranks in ranked.groupBy("k").agg(F.collect_list("rank")).collect():
        assert sorted(ranks) == list(range(1, len(ranks) + 1)), key


def test_first_n_by_hash_is_exact_and_repeatable(spark):
    df = hot_rows(spark)
    for n in (0, 1, 777, 3000, 5000):
        got = {r["id"] for r in ordering.first_n_by_hash(df, "id", n, buckets=8).collect()}
        want = {r["id"] for r in ordering.hash_rank(df, "id").filter(F.col("rank") <= n).collect()}
        assert got == want and len(got) == min(n, 3000)


def test_seeds_give_unrelated_samples(spark):
    ids = spark.range(20_000).toDF("id")
    samples = [{r[0] for r in ordering.first_n_by_hash(ids, "id", 6000, seed=seed).collect()} for seed in (0, 1, 2, 7, 35)]
    for i, one in enumerate(samples):
        assert len(one) == 6000
        for other in samples[:i]:
            assert 0.27 < len(one & other) / 6000 < 0.33


def test_null_classes_and_keys_are_kept(spark):
    rows = [(i, None if i % 4 == 0 else i % 4) for i in range(100)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "id long, label int")
    assert sampling.assign_folds(df, "id", 5, by="label").count() == 102
    assert sampling.sample_exact(df, "id", 102).count() == 102
    least = sampling.under_sample(df, "id", "label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in least} == {None: 25, 1: 25, 2: 25, 3: 25}
    most = sampling.over_sample(df, "id", "label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in most} == {None: 26, 1: 26, 2: 26, 3: 26}
    assert association.sample_weights(df, "label").count() == 102


def test_rare_rows_are_repeated_in_blocks(spark):
    df = spark.createDataFrame([(1, 2500), (2, 1), (3, 0)], "id int, n long")
    got = sampling.repeated(df.filter("n > 0"), "n").groupBy("id").agg(F.count("*").alias("c"), F.max("copy").alias("m")).collect()
    assert {r["id"]: (r["c"], r["m"]) for r in got} == {1: (2500, 2500), 2: (1, 1)}


def test_page_comes_out_in_order(spark):
    df = spark.range(500).toDF("id").repartition(7)
    for start, stop in ((0, 20), (100, 120), (-30, None), (-30, -10), (490, 600), (5, 5)):
        got = [r["id"] for r in slices.row_range(df, [F.desc("id")], start, stop).collect()]
        assert got == list(range(499, -1, -1))[start:stop]


def test_quantiles_count_without_sorting(spark, monkeypatch):
    """Values per bucket are counted by hash: a sort of every value would grow with the input."""
    kind = type(spark.range(1))
    plans, collect = [], kind.collect

    def kept(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return collect(df)

    monkeypatch.setattr(kind, "collect", kept)
    df = spark.range(4000).select(F.col("id"), (F.col("id") * 0.5).alias("x"))
    found = ordering.exact_quantiles(df, {"id": F.col("id"), "x": F.col("x")}, [0.0, 0.5, 1.0])
    assert found == {"id": [0.0, 1999.5, 3999.0], "x": [0.0, 999.75, 1999.5]}
    counted = [p for p in plans if "bucket" in p]
    assert counted and not any("SortAggregate" in p for p in counted)
