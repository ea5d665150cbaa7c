"""Association, sampling, scoring and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.operators import association, drift, modeling, sampling, scoring
from featmart.operators.ordering import spread_sql
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.sources.tables import scan

CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]


@query("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in PAIRS))
def corr_pearson(spark, sf):
    return association.correlation_table(scan(spark, sf, "lineitem"), CORR)


RANKED = "ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in CORR) + " FROM lineitem)"


@query("corr_spearman", f"WITH {RANKED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM ranked" for a, b in PAIRS))
def corr_spearman(spark, sf):
    return association.spearman_table(scan(spark, sf, "lineitem"), CORR)


FEATURES = ("balance", "n_loans", "amount", "first_day")
PROFILE = """profile AS (SELECT c.client_id, c.target, c.balance, CAST(l.n_loans AS DOUBLE) AS n_loans, l.amount, CAST(l.first_day AS DOUBLE) AS first_day
  FROM client c JOIN (SELECT client_id, count(*) AS n_loans, round(sum(amount), 2) AS amount, max(loan_day) AS first_day FROM loan GROUP BY 1) l
  ON c.client_id = l.client_id WHERE c.target > -1)"""


def profile(spark, sf):
    loans = roles.loan(spark, sf).groupBy("client_id").agg(
        F.count("*").cast("double").alias("n_loans"), F.round(F.sum("amount"), 2).alias("amount"),
        F.max("loan_day").cast("double").alias("first_day"),
    )
    clients = roles.client(spark, sf).filter("target > -1").select("client_id", "target", "balance")
    return clients.join(loans, "client_id")


@query("target_corrs", f"WITH {PROFILE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, target), 9) AS r FROM profile" for c in FEATURES))
def target_corrs(spark, sf):
    return association.target_correlations(profile(spark, sf), FEATURES, "target")


@query("top_correlated", f"WITH {PROFILE}, t AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, target), 9) AS r FROM profile" for c in FEATURES) + ") SELECT * FROM t ORDER BY abs(r) DESC, column_name LIMIT 2")
def top_correlated(spark, sf):
    return association.target_correlations(profile(spark, sf), FEATURES, "target").limit(2)


@query("class_weights", "SELECT toxic, count(*) AS n, sum(count(*)) OVER () / (1 + count(*)) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf):
    return association.class_weights(scan(spark, sf, "labels"), "toxic")


@query("sample_weights", """
SELECT l.doc_id, l.toxic, w.weight FROM labels l JOIN (
  SELECT toxic, sum(count(*)) OVER () / (1 + count(*)) AS weight FROM labels GROUP BY toxic) w ON l.toxic = w.toxic""")
def sample_weights(spark, sf):
    return association.sample_weights(scan(spark, sf, "labels").select("doc_id", "toxic"), "toxic")


FLAGS = ("low", "many")
FLAGGED = f"{PROFILE}, flagged AS (SELECT target, CAST(balance < 1000 AS INTEGER) AS low, CAST(n_loans > 9 AS INTEGER) AS many FROM profile)"


@query("weighted_mcc", f"WITH {FLAGGED}, " + """w AS (SELECT count(*) / (1.0 + count(*) FILTER (target = 1)) AS w1, count(*) / (1.0 + count(*) FILTER (target = 0)) AS w0 FROM flagged)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM (
  SELECT w1 * count(*) FILTER (target = 1 AND {c} = 1) AS tp, w0 * count(*) FILTER (target = 0 AND {c} = 1) AS fp,
         w1 * count(*) FILTER (target = 1 AND {c} = 0) AS fn, w0 * count(*) FILTER (target = 0 AND {c} = 0) AS tn FROM flagged, w GROUP BY w1, w0) s{c}""" for c in FLAGS))
def weighted_mcc(spark, sf):
    flagged = profile(spark, sf).select(
        "target", (F.col("balance") < 1000).cast("int").alias("low"), (F.col("n_loans") > 9).cast("int").alias("many")
    )
    return association.weighted_mcc(flagged, "target", FLAGS)


@query("kendall_tau_contingency", f"""
WITH {PROFILE}, w AS (SELECT count(*) / (1.0 + count(*) FILTER (target = 1)) AS w1, count(*) / (1.0 + count(*) FILTER (target = 0)) AS w0 FROM profile),
c AS (SELECT target, n_loans AS x, count(*) * (CASE WHEN target = 1 THEN max(w1) ELSE max(w0) END) AS m FROM profile, w GROUP BY 1, 2)
SELECT round(sum(a.m * b.m * sign(a.target - b.target) * sign(a.x - b.x))
  / sqrt(sum(a.m * b.m * abs(sign(a.target - b.target))) * sum(a.m * b.m * abs(sign(a.x - b.x)))), 9) AS tau FROM c a, c b""")
def kendall_tau_contingency(spark, sf):
    return association.weighted_kendall(profile(spark, sf), "target", "n_loans")


@query("density_by_class", f"""
WITH {PROFILE}, s AS (SELECT min(balance) AS lo, max(balance) AS hi FROM profile),
b AS (SELECT target, greatest(CAST(ceil(round((balance - lo) / (hi - lo) * 20, 9)) AS BIGINT), 1) AS bin, (hi - lo) / 20 AS width FROM profile, s),
g AS (SELECT target, bin, count(*) AS n, max(width) AS width FROM b GROUP BY 1, 2)
SELECT target, bin, n, round(n / (sum(n) OVER (PARTITION BY target) * width), 9) AS density FROM g""")
def density_by_class(spark, sf):
    return association.density_by_class(profile(spark, sf).select("target", "balance"), "balance", "target", 20)


def hash_order(key: str, seed: int) -> str:
    return f"{spread_sql(key, seed)}, {key}"


@query("named_samples", f"""
WITH l AS (SELECT client_id, target, row_number() OVER (ORDER BY {hash_order('client_id', 5)}) AS r, count(*) OVER () AS n FROM client WHERE target > -1)
SELECT client_id, target, '500' AS sample FROM l WHERE r <= 500
UNION ALL SELECT client_id, target, '20p' AS sample FROM l WHERE r <= floor(0.2 * n)""")
def named_samples(spark, sf):
    clients = roles.client(spark, sf).select("client_id", "target")
    return sampling.named_samples(clients, "client_id", "target", {"500": 500, "20p": 0.2}, seed=5)


@query("under_sample", f"""
SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hash_order('doc_id', 3)}) AS r FROM labels) s
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic) m)""")
def under_sample(spark, sf):
    return sampling.under_sample(scan(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", seed=3)


@query("over_sample", f"""
WITH s AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hash_order('doc_id', 3)}) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels),
m AS (SELECT max(n) AS most FROM s)
SELECT doc_id, toxic, unnest(range(1, CAST(most // n + CASE WHEN r <= most % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM s, m""")
def over_sample(spark, sf):
    return sampling.over_sample(scan(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", seed=3)


@query("kfold_assign", f"""
SELECT client_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY {hash_order('client_id', 0)}) - 1) % 5 AS INTEGER) AS fold
FROM client WHERE target > -1""")
def kfold_assign(spark, sf):
    clients = roles.client(spark, sf).filter("target > -1").select("client_id", "target")
    return sampling.assign_folds(clients, "client_id", 5, by="target")


def metrics_sql(cond="true") -> str:
    counts = f"""SELECT count(*) FILTER (target = 1 AND predicted = 1) AS tp, count(*) FILTER (target = 0 AND predicted = 1) AS fp,
    count(*) FILTER (target = 1 AND predicted = 0) AS fn, count(*) FILTER (target = 0 AND predicted = 0) AS tn FROM scored WHERE {cond}"""

    def m(top, bottom, name):
        return f"round(coalesce(({top}) / nullif({bottom}, 0), 0), 9) AS {name}"

    cols = [m("tp + tn", "tp + fp + fn + tn", "accuracy"), m("tp", "tp + fp", "precision"), m("tp", "tp + fn", "recall"),
            m("tp", "tp + fp + fn", "jaccard"),
            *[m(f"{1 + b * b} * tp", f"{1 + b * b} * tp + {b * b} * fn + fp", f"f{b}") for b in scoring.BETAS]]
    return f"SELECT tp, fp, fn, tn, {', '.join(cols)} FROM ({counts}) c"


@query("binary_metrics", f"SELECT tp, fp, fn, tn, accuracy, precision, recall, jaccard FROM ({metrics_sql()}) m")
def binary_metrics(spark, sf):
    metrics = scoring.binary_metrics(roles.scored(spark, sf), "target", F.col("predicted") == 1)
    return metrics.select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "jaccard")


@query("fbeta_suite", f"SELECT f1, f2, f4, f8, f16 FROM ({metrics_sql()}) m")
def fbeta_suite(spark, sf):
    return scoring.binary_metrics(roles.scored(spark, sf), "target", F.col("predicted") == 1).select("f1", "f2", "f4", "f8", "f16")


SUBSETS = {"full": "true", "training": "client_id % 5 <> 0", "complement": "client_id % 5 = 0", "rich": "score < 0.3"}


@query("metrics_by_subset", " UNION ALL ".join(f"SELECT '{n}' AS subset, * FROM ({metrics_sql(c)}) m{n}" for n, c in SUBSETS.items()))
def metrics_by_subset(spark, sf):
    return scoring.metrics_by_subset(
        roles.scored(spark, sf), "target", F.col("predicted") == 1, {n: F.expr(c) for n, c in SUBSETS.items()}
    )


@query("auc_exact", """
WITH r AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored),
s AS (SELECT sum(rk) FILTER (target = 1) AS rs, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM r)
SELECT (rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n) AS auc FROM s""")
def auc_exact(spark, sf):
    return scoring.auc(roles.scored(spark, sf), "target", "score")


@query("roc_points", """
WITH g AS (SELECT score AS threshold, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM scored GROUP BY 1)
SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER w / sum(p) OVER () AS tpr,
       sum(n) OVER w / sum(n) OVER () AS fpr FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark, sf):
    return scoring.roc_points(roles.scored(spark, sf), "target", "score")


LIMITS = (0.45, 0.4, 0.35)


def sweep_sql() -> str:
    return " UNION ALL ".join(f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (target = 1 AND score >= {t}) AS tp, count(*) FILTER (target = 0 AND score >= {t}) AS fp,
    count(*) FILTER (target = 1 AND score < {t}) AS fn, count(*) FILTER (target = 0 AND score < {t}) AS tn FROM scored""" for t in LIMITS)


@query("threshold_sweep", f"SELECT *, fn / nullif(fn + tp, 0) AS fnr, fp / nullif(fp + tn, 0) AS fpr FROM ({sweep_sql()}) s")
def threshold_sweep(spark, sf):
    return scoring.threshold_sweep(roles.scored(spark, sf), "target", "score", LIMITS)


@query("business_gain", f"""
WITH g AS (SELECT threshold, CAST(-10 * fn + tn - fp AS DOUBLE) AS gain FROM ({sweep_sql()}) s)
SELECT threshold, gain, gain = max(gain) OVER () AS best FROM g""")
def business_gain(spark, sf):
    sweep = scoring.threshold_sweep(roles.scored(spark, sf), "target", "score", LIMITS)
    return scoring.business_gain(sweep, tp=0, fn=-10, tn=1, fp=-1)


@query("confusion_matrix", """
SELECT target, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1 FROM scored GROUP BY 1""")
def confusion_matrix(spark, sf):
    return scoring.confusion_matrix(roles.scored(spark, sf), "target", "predicted", [0, 1])


GUESS = """guess AS (SELECT segment AS label, CASE WHEN balance < 2000 THEN 'BUILDING' WHEN region_key > 12 THEN 'MACHINERY' ELSE segment END AS guess FROM client)"""


def guesses(spark, sf):
    return roles.client(spark, sf).select(
        F.col("segment").alias("label"),
        F.when(F.col("balance") < 2000, "BUILDING").when(F.col("region_key") > 12, "MACHINERY").otherwise(F.col("segment")).alias("guess"),
    )


@query("class_report", f"""
WITH {GUESS}, a AS (SELECT label, count(*) AS support, count(*) FILTER (label = guess) AS hits FROM guess GROUP BY 1),
g AS (SELECT guess, count(*) AS guessed FROM guess GROUP BY 1)
SELECT label AS class, round(coalesce(hits / nullif(guessed, 0), 0), 9) AS precision, round(hits / support, 9) AS recall,
       round(2 * hits / (support + coalesce(guessed, 0)), 9) AS f1, support FROM a LEFT JOIN g ON label = guess""")
def class_report(spark, sf):
    return scoring.class_report(guesses(spark, sf), "label", "guess")


@query("adjusted_rand", f"""
WITH {GUESS}, c AS (SELECT label, guess, count(*) AS n FROM guess GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS both_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS l,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY guess)) AS r, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT (both_ - l * r / t) / ((l + r) / 2 - l * r / t) AS adjusted_rand FROM s""")
def adjusted_rand(spark, sf):
    return scoring.adjusted_rand(guesses(spark, sf), "label", "guess")


@query("cluster_class_contingency", f"""
WITH {GUESS}, c AS (SELECT guess AS cluster, label AS class, count(*) AS n FROM guess GROUP BY 1, 2)
SELECT cluster, class, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, class DESC) = 1 AS best FROM c""")
def cluster_class_contingency(spark, sf):
    return scoring.class_contingency(guesses(spark, sf), "guess", "label")


START = "2024-01-01"
SPLIT = "2024-01-15"


def stream_rows(spark, sf):
    return scan(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double"))


def is_current():
    return F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")


CUR = f"ts >= TIMESTAMP '{SPLIT}'"


@query("drift_ks", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(max(abs(a / nullif(ta, 0) - b / nullif(tb, 0))), 9) AS ks FROM (
  SELECT sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (
    SELECT {x} AS v, count(*) FILTER ({CUR}) AS a, count(*) FILTER (NOT ({CUR})) AS b FROM events GROUP BY 1) g
  WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) d""" for c, x in (("value", "value"), ("hour", "hour(ts)"))))
def drift_ks(spark, sf):
    return drift.ks_statistics(stream_rows(spark, sf), ["value", "hour"], is_current())


@query("drift_psi", " UNION ALL ".join(f"""(WITH e AS (SELECT DISTINCT unnest(quantile_cont(CAST({x} AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FILTER (NOT ({CUR}))) AS e FROM events),
  b AS (SELECT {CUR} AS cur, (SELECT count(*) FROM e WHERE e.e < {x}) AS bin FROM events),
  g AS (SELECT bin, count(*) FILTER (cur) AS c, count(*) FILTER (NOT cur) AS r FROM b GROUP BY 1),
  s AS (SELECT greatest(c / sum(c) OVER (), 0.0001) AS c, greatest(r / sum(r) OVER (), 0.0001) AS r FROM g)
  SELECT '{c}' AS column_name, round(sum((c - r) * ln(c / r)), 9) AS psi FROM s)""" for c, x in (("value", "value"), ("hour", "hour(ts)"))))
def drift_psi(spark, sf):
    return drift.psi(stream_rows(spark, sf), ["value", "hour"], is_current())


@query("drift_chi2", " UNION ALL ".join(f"""(WITH g AS (SELECT {x} AS v, count(*) FILTER ({CUR}) AS a, count(*) FILTER (NOT ({CUR})) AS b FROM events GROUP BY 1),
  t AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g), x AS (SELECT *, (a + b) * ta / (ta + tb) AS ea, (a + b) * tb / (ta + tb) AS eb FROM t)
  SELECT '{c}' AS column_name, round(sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb), 6) AS chi2, count(*) - 1 AS dof FROM x)"""
    for c, x in (("event_type", "event_type"), ("user", "CAST(user_id AS VARCHAR)"))))
def drift_chi2(spark, sf):
    rows = stream_rows(spark, sf).select("ts", "event_type", F.col("user_id").cast("string").alias("user"))
    return drift.chi_square(rows, ["event_type", "user"], is_current())


WEEK = f"CAST(floor(epoch(date_trunc('second', ts) - TIMESTAMP '{START}') / 604800) AS BIGINT)"


@query("period_slices", f"SELECT {WEEK} AS week, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def period_slices(spark, sf):
    return scan(spark, sf, "events").groupBy(drift.slice_number("ts", START, 7).alias("week")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("regression_report", f"""
WITH p AS (SELECT event_type, round(avg(value), 6) AS predicted FROM events WHERE NOT ({CUR}) GROUP BY 1),
e AS (SELECT {WEEK} AS week, e.value, p.predicted FROM events e JOIN p ON e.event_type = p.event_type)
SELECT week, count(*) AS n, round(avg(predicted - value), 6) AS me, round(avg(abs(predicted - value)), 6) AS mae,
       round(100 * avg(abs((predicted - value) / nullif(value, 0))), 6) AS mape FROM e GROUP BY 1""")
def regression_report(spark, sf):
    rows = scan(spark, sf, "events")
    means = rows.filter(~is_current()).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("predicted"))
    sliced = rows.join(means, "event_type").withColumn("week", drift.slice_number("ts", START, 7))
    return drift.regression_report(sliced, "week", "value", "predicted")


@query("train_preproc", f"""
WITH {PROFILE}, x AS (SELECT client_id, target, nullif(balance, 0) AS balance, n_loans, CASE WHEN amount > 100000 THEN amount END AS amount, first_day FROM profile),
m AS (SELECT quantile_cont(amount, 0.5) AS amount FROM x), i AS (SELECT x.* REPLACE (coalesce(x.amount, m.amount) AS amount) FROM x, m),
s AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES)} FROM i)
SELECT target, {", ".join(f"round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 9) AS {c}" for c in FEATURES)} FROM i, s""")
def train_preproc(spark, sf):
    rows = profile(spark, sf).withColumn("amount", F.when(F.col("amount") > 100000, F.col("amount")))
    scaled = modeling.prepare_training(rows, "target", ["client_id"], FEATURES)
    return scaled.select("target", *[F.round(c, 9).alias(c) for c in FEATURES])
