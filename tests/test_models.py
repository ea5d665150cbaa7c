"""Folds, model facade, and streams in several triggers."""

from pyspark.sql import functions as F

from featmart.operators import modeling, sampling
from featmart.plans import model_queries
from featmart.plans import roles
from featmart.streaming import streams


def test_folds_are_balanced(spark, sf):
    rows = roles.client(spark, sf).filter("target > -1")
    sizes = sampling.assign_folds(rows, "client_id", 4, by="target").groupBy("target", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["target"] == label]
        assert max(counts) - min(counts) <= 1


def test_over_sample_equalises(spark):
    df = spark.createDataFrame([(i, 1 if i < 7 else 0) for i in range(40)], "id long, y int")
    sizes = {r["y"]: r["count"] for r in sampling.over_sample(df, "id", "y").groupBy("y").count().collect()}
    assert sizes == {0: 33, 1: 33}


def test_model_save_load_and_importances(spark, tmp_path):
    rows = [(i, float(i), float(i % 5), 1 if i > 30 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    for kind in ("logistic", "forest", "boosted"):
        model = modeling.fit(df, "y", ["a", "b"], kind)
        weights = dict(modeling.importances(model, ["a", "b"]))
        assert weights["a"] > weights["b"]
    path = modeling.save_model(model, spark, "m", str(tmp_path))
    again = modeling.score_all(modeling.load_model(path), df, "id")
    assert again.filter("score < 0 OR score > 1").isEmpty() and again.count() == 60


def test_cross_fit_scores_every_row_once(spark):
    rows = [(i, float(i), -1 if i % 10 == 0 else int(i > 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    held_out, averaged, weights = modeling.cross_fit(df, "id", "y", ["a"], "logistic", folds=3)
    assert held_out.select("id").distinct().count() == held_out.count() == 54
    assert averaged.count() == 6 and weights.count() == 3


def test_closed_runs_over_many_triggers(spark, sf, tmp_path):
    """Days fed in several files give the runs of the whole series, less the open ones."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path)
    for week in range(5):
        day = F.dayofmonth("ts")
        part = events.filter((day > week * 7) & (day <= week * 7 + 7))
        part.coalesce(1).write.parquet(f"{folder}/part{week}")
    import glob
    import os
    import shutil
    import time

    os.makedirs(f"{folder}/in")
    for week in range(5):
        file = glob.glob(f"{folder}/part{week}/*.parquet")[0]
        shutil.copyfile(file, f"{folder}/in/events{week}.parquet")
        os.utime(f"{folder}/in/events{week}.parquet", (time.time() + week, time.time() + week))
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    days = streams.last_status_per_day(stream, "user_id", "ts", F.col("event_type"), "event_id")
    got = streams.run_available(streams.closed_runs(days, "user_id"), "runs")

    from featmart.plans import catalog

    want = catalog.PLANS["stream_closed_runs"](spark, sf)
    got = got.withColumn("start", F.col("start").cast("timestamp_ntz"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_boosting_stops_on_held_rows(spark):
    rows = [(i, float(i % 97), float(i * 31 % 89), int((i % 97 > 48) != (i * 7 % 10 == 0))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = modeling.fit(df, "y", ["a", "b"], "boosted", key="id", held=0.3)
    assert 1 <= modeling.rounds(model) < modeling.ROUNDS
    assert dict(modeling.importances(model, ["a", "b"]))["a"] > 0.5
    held_out, _, _ = modeling.cross_fit(df, "id", "y", ["a", "b"], "boosted", folds=2, held=0.3)
    assert held_out.count() == 1200 and held_out.filter("score < 0 OR score > 1").isEmpty()


def test_held_rows_are_not_resampled(spark):
    rows = [(i, float(i % 10), int(i % 10 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    seen = []

    def resample(train):
        seen.append(train.count())
        return sampling.over_sample(train, "id", "y")

    modeling.fit(df, "y", ["a"], "boosted", resample, key="id", held=0.25)
    assert 250 < seen[0] < 350


def test_dummy_family(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(-i), int(i < 15)) for i in range(60)], "id long, a double, b double, y int")
    model = modeling.fit(df, "y", ["a", "b"], "dummy")
    assert modeling.importances(model, ["a", "b"]) == [("a", 0.5), ("b", 0.5)]
    again = modeling.load_model(modeling.save_model(model, spark, "dummy", str(tmp_path)))
    assert {r["score"] for r in modeling.predict(again, df).collect()} == {0.25}


def test_features_of_batch_scores_are_built_once(spark, sf, monkeypatch):
    seen, built = spark.sparkContext.accumulator(0), model_queries.training

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def training(spark, sf):
        rows = built(spark, sf)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(model_queries, "training", training)
    assert model_queries.batch_scores(spark, sf).count() == seen.value


def test_a_fit_resamples_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(100).selectExpr("id", "id % 2 AS y", "CAST(id % 7 AS DOUBLE) AS a")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    modeling.fit(df, "y", ["a"], "logistic", lambda rows: rows.mapInArrow(counted, rows.schema))
    assert seen.value == 100
