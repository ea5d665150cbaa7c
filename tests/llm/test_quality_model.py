"""The quality score: kernel approximation, sums, calibration, held-out accuracy."""

import zlib

import numpy as np
import pytest

from featmart.llm import quality_model, queries, words


def test_cosines_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality_model, "FEATURES", 20_000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 5))
    model = quality_model.Model(np.zeros(5), np.ones(5), rng.normal(size=(5, 20_000)) / 3, rng.uniform(0, 2 * np.pi, 20_000), None, None, None)
    z = model.features(x)[:, 1:]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 9))
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_pooling_gives_the_least_squares_rising_levels():
    x = np.arange(8.0)
    y = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8, 1.0, 0.2])
    knots, levels = quality_model.pool(x, y, np.ones(8))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    assert np.allclose(np.interp(x, knots, levels), [0.1, 1.1 / 3, 1.1 / 3, 1.1 / 3, 0.725, 0.725, 0.725, 0.725])


def test_sums_of_partitions_equal_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(2)
    count = len(quality_model.STATISTICS)
    rows = [(list(map(float, rng.normal(size=count))), float(rng.integers(0, 2))) for _ in range(200)]
    df = spark.createDataFrame(rows, "stats array<double>, y double").repartition(7)
    turns = rng.normal(size=(count, quality_model.FEATURES))
    model = quality_model.Model(np.zeros(count), np.ones(count), turns, np.zeros(quality_model.FEATURES), None, None, None)
    z = model.features(np.array([r[0] for r in rows]))
    want = z.T @ np.column_stack([z, [r[1] for r in rows]])
    assert np.allclose(quality_model.normal_equations(df, model), want)


def test_statistics_of_odd_texts():
    texts = ["", " \n", "a", "Á | # ab ab\nab", "x " * 100_000, "same line.\nsame line.\n"]
    found = quality_model.statistics(words.chunk_of(texts))
    assert np.isfinite(found).all() and (found[:2] == 0).all()
    named = dict(zip(quality_model.STATISTICS, found[3]))
    assert named["different_words"] == pytest.approx(4 / 6) and named["upper"] == 0 and named["most_frequent_word"] == 0.5
    assert dict(zip(quality_model.STATISTICS, found[5]))["copied_lines"] == pytest.approx(1 / 3)


def auc(score, label):
    order = np.argsort(np.argsort(score))
    good, bad = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - good * (good - 1) / 2) / (good * bad)


def test_held_out_documents_are_ranked(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.PLANS["op10_quality_classifier"](spark, folder).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    seen = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    assert auc(seen["score"].to_numpy(), seen["quality"].to_numpy()) > 0.97
    assert (seen["predicted"] == seen["quality"]).mean() > 0.94


def test_held_out_labels_do_not_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - quality, quality) AS quality")
    one = {r.doc_id: r.score for r in quality_model.score(docs, labels).collect()}
    two = {r.doc_id: r.score for r in quality_model.score(docs, turned).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_nulls_clashes_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "some words", 2.0), (2, "", 3.0), (2, "", 3.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id bigint, quality int")
    rows = quality_model.score(docs, labels).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5} and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality_model.score(docs.filter("false"), labels).count() == 0
