"""Neighbour-based resampling, model fits, scoring and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.operators import modeling, neighbors, sampling, scoring
from featmart.operators.ordering import HASH_MODULUS, spread, spread_sql
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.plans.score_queries import FEATURES, metrics_sql
from featmart.session import cut_lineage, scratch_path, with_row
from featmart.sources.tables import scan

VECTORS = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings),
d AS (SELECT a.id, b.id AS other, a.label AS la, b.label AS lb,
      list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM v a JOIN v b ON a.id <> b.id)"""


def vectors(spark, sf):
    return scan(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
    )


@query("nearest_neighbours", f"""
WITH {VECTORS}, r AS (SELECT id, other, d2, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM d)
SELECT id, other AS neighbour, round(d2, 9) AS d2, CAST(k - 1 AS INTEGER) AS place FROM r WHERE k <= 3""")
def nearest_neighbours(spark, sf):
    points = vectors(spark, sf)
    return neighbors.nearest(points, points, 3).withColumn("d2", F.round("d2", 9))


@query("tomek_links", f"""
WITH {VECTORS}, n AS (SELECT id, other, la, lb FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM d) r WHERE k = 1)
SELECT a.id AS minority_id, a.other AS majority_id FROM n a JOIN n b ON a.other = b.id AND b.other = a.id WHERE a.la = 1 AND a.lb = 0""")
def tomek_links(spark, sf):
    return neighbors.tomek_links(vectors(spark, sf))


@query("near_miss", f"""
WITH {VECTORS}, m AS (SELECT id, avg(sqrt(d2)) AS mean_distance FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM d WHERE la = 0 AND lb = 1) r WHERE k <= 3 GROUP BY id)
SELECT id, round(mean_distance, 9) AS mean_distance FROM m ORDER BY m.mean_distance, id LIMIT (SELECT count(*) FROM v WHERE label = 1)""")
def near_miss(spark, sf):
    return neighbors.near_miss(vectors(spark, sf)).withColumn("mean_distance", F.round("mean_distance", 9))


SMOTE = f"""{VECTORS},
n AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d2, other) - 1 AS place FROM d WHERE la = 1 AND lb = 1),
p AS (SELECT n.id, n.place, v.x AS nx, least(5, count(*) OVER (PARTITION BY n.id)) AS partners FROM n JOIN v ON n.other = v.id WHERE place < 5),
z AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS missing, count(*) FILTER (label = 1) AS few FROM v),
m AS (SELECT id, x, row_number() OVER (ORDER BY id) AS place FROM v WHERE label = 1),
c AS (SELECT id, x, unnest(range(1, CAST(missing // few + CASE WHEN place <= missing % few THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM m, z),
made AS (SELECT c.id, c.copy, list_transform(list_zip(c.x, p.nx), lambda e: e[1] + (e[2] - e[1]) * ({spread_sql('c.id * 1000003 + c.copy', 1)} / {HASH_MODULUS})) AS x
  FROM c JOIN p ON c.id = p.id AND p.place = {spread_sql('c.id * 1000003 + c.copy', 0)} % p.partners)"""


def coordinates(df, *keys):
    """One row per coordinate, from 0."""
    return df.select(*keys, F.posexplode("x").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("smote", f"""
WITH {SMOTE}
SELECT id, copy, 1 AS label, CAST(unnest(range(len(x))) AS INTEGER) AS dim, round(unnest(x), 6) AS value FROM made""")
def smote(spark, sf):
    return coordinates(neighbors.smote(vectors(spark, sf)), "id", "copy", "label")


@query("smote_tomek", f"""
WITH {SMOTE},
w AS (SELECT id, x, label FROM v UNION ALL
      SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY id, copy) AS id, x, 1 AS label FROM made),
e AS (SELECT a.id, b.id AS other, a.label AS la, b.label AS lb,
      list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM w a JOIN w b ON a.id <> b.id),
f AS (SELECT id, other, la, lb FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM e) r WHERE k = 1),
t AS (SELECT a.id, a.other FROM f a JOIN f b ON a.other = b.id AND b.other = a.id WHERE a.la = 1 AND a.lb = 0)
SELECT id, label, CAST(unnest(range(len(x))) AS INTEGER) AS dim, round(unnest(x), 6) AS value FROM w
WHERE id NOT IN (SELECT id FROM t UNION ALL SELECT other FROM t)""")
def smote_tomek(spark, sf):
    return coordinates(neighbors.smote_tomek(vectors(spark, sf)), "id", "label")


def training(spark, sf):
    """Labelled and unlabelled clients with a few mart features."""
    loans = roles.loan(spark, sf).groupBy("client_id").agg(
        F.count("*").cast("double").alias("n_loans"), F.round(F.sum("amount"), 2).alias("amount"),
        F.max("loan_day").cast("double").alias("first_day"),
    )
    late = roles.installment(spark, sf).groupBy("client_id").agg(
        F.avg((F.col("due_day") > F.col("paid_day")).cast("int")).alias("late_share"),
        F.count_if(F.col("paid").isNull()).cast("double").alias("unpaid"),
    )
    clients = roles.client(spark, sf).select("client_id", "target", "balance")
    # Balance decides the label of these clients, so it enters coarsely only.
    coarse = clients.withColumn("balance", F.floor(F.col("balance") / 3000).cast("double"))
    return coarse.join(loans, "client_id", "left").join(late, "client_id", "left").fillna(0)


TRAINED = [*FEATURES, "late_share", "unpaid"]


@query("kfold_oof")
def kfold_oof(spark, sf):
    held_out, averaged, _ = modeling.cross_fit(training(spark, sf), "client_id", "target", TRAINED, "logistic", folds=3)
    return held_out.select("client_id", "score", F.lit("held_out").alias("part")).unionByName(
        averaged.select("client_id", "score", F.lit("unlabelled").alias("part"))
    )


@query("kfold_scores")
def kfold_scores(spark, sf):
    held_out, _, _ = modeling.cross_fit(training(spark, sf), "client_id", "target", TRAINED, "logistic", folds=3)
    return modeling.fold_scores(held_out, "target", 3)


@query("importance_mean")
def importance_mean(spark, sf):
    _, _, weights = modeling.cross_fit(training(spark, sf), "client_id", "target", TRAINED, "forest", folds=2)
    return modeling.mean_importance(weights)


@query("importances")
def importances(spark, sf):
    rows = cut_lineage(training(spark, sf))
    found = []
    for kind in ("logistic", "forest", "boosted"):
        model = modeling.fit(rows.filter("target > -1"), "target", TRAINED, kind)
        found += [(kind, name, value) for name, value in modeling.importances(model, TRAINED)]
    return spark.createDataFrame(found, "family string, feature string, importance double")


HELD = 0.25
PICKED = f"{spread_sql('client_id', 101)} < {int(HELD * HASH_MODULUS)}"


@query("early_stopping", f"""
SELECT count(*) FILTER ({PICKED}) AS held, count(*) FILTER (NOT {PICKED}) AS trained, true AS bounded, true AS better
FROM client WHERE target > -1""")
def early_stopping(spark, sf):
    """Rows that stop the boosting and rows that it learns from; whether its rounds keep
    within their limit, and whether it ranks the held rows better than the dummy family."""
    rows = cut_lineage(training(spark, sf).filter("target > -1"))
    marked = rows.withColumn("held", spread("client_id", 101) < int(HELD * HASH_MODULUS))
    model = modeling.fit(rows, "target", TRAINED, "boosted", key="client_id", held=HELD)
    dummy = modeling.fit(marked.filter("NOT held"), "target", TRAINED, "dummy")
    picked = marked.filter("held")
    aucs = [scoring.auc(modeling.predict(m, picked), "target", "score").first()[0] for m in (model, dummy)]
    return marked.agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("trained")).withColumns(
        {"bounded": F.lit(1 <= modeling.rounds(model) <= modeling.ROUNDS), "better": F.lit(aucs[0] > aucs[1])}
    )


@query("dummy_family", f"""
SELECT client_id, round((SELECT avg(target) FROM client WHERE target > -1), 9) AS score, round(CAST(1 AS DOUBLE) / {len(TRAINED)}, 9) AS importance
FROM client""")
def dummy_family(spark, sf):
    """Every client's score by the dummy family, and the importance it gives each feature."""
    rows = cut_lineage(training(spark, sf))
    model = modeling.fit(rows.filter("target > -1"), "target", TRAINED, "dummy")
    (share,) = {value for _, value in modeling.importances(model, TRAINED)}
    return modeling.predict(model, rows).select("client_id", F.round("score", 9).alias("score"), F.lit(round(share, 9)).alias("importance"))


def balanced_model(spark, sf, rows):
    def resample(df):
        return sampling.under_sample(df, "client_id", "target")

    return modeling.fit(rows.filter("target > -1"), "target", TRAINED, "logistic", resample)


@query("resampled_fit")
def resampled_fit(spark, sf):
    """Metrics of scores from folds that the balanced fit did not see."""
    scores, _, _ = modeling.cross_fit(
        training(spark, sf), "client_id", "target", TRAINED, "logistic", folds=3, resample=lambda df: sampling.under_sample(df, "client_id", "target")
    )
    return with_row(scoring.binary_metrics(scores, "target", F.col("score") >= 0.5), scoring.auc(scores, "target", "score"))


@query("batch_scores")
def batch_scores(spark, sf):
    # Fitted on and scored: the features are built once.
    rows = cut_lineage(training(spark, sf))
    path = modeling.save_model(balanced_model(spark, sf, rows), spark, "balanced", scratch_path(spark, "saved"))
    return modeling.score_all(modeling.load_model(path), rows, "client_id", 0.5)


LIMITS = (0.45, 0.4)
METRICS = ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "jaccard", *[f"f{b}" for b in scoring.BETAS])


def logged_sql(i: int, limit: float) -> str:
    metrics = metrics_sql().replace("FROM scored", f"FROM (SELECT target, CAST(score >= {limit} AS INTEGER) AS predicted FROM scored)")
    return " UNION ALL ".join(
        f"SELECT 'threshold-{limit}' AS run, '{{\"threshold\": {limit}}}' AS params, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({metrics}) l{i}"
        for m in METRICS
    )


@query("run_metrics", " UNION ALL ".join(logged_sql(i, limit) for i, limit in enumerate(LIMITS)))
def run_metrics(spark, sf):
    path = scratch_path(spark, "runs")
    scores = roles.scored(spark, sf)
    for limit in LIMITS:
        row = scoring.binary_metrics(scores, "target", F.col("score") >= limit).first().asDict()
        modeling.log_run(spark, path, f"threshold-{limit}", {"threshold": limit}, row)
    return spark.read.parquet(path).select("run", "params", "metric", "value")
