"""Streams run to the end of their input; the oracles state the batch result they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.plans import roles
from featmart.plans.registry import query
from featmart.sources.tables import scan
from featmart.streaming import streams

WATERMARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("stream_window_errors", f"""
WITH p AS (SELECT event_type, round(avg(value), 6) AS predicted FROM events GROUP BY 1)
SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", count(*) AS n,
       round(avg(predicted - value), 6) AS me, round(avg(abs(predicted - value)), 6) AS mae
FROM events e JOIN p ON e.event_type = p.event_type
GROUP BY 1, 2 HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= {WATERMARK}""")
def stream_window_errors(spark, sf):
    means = scan(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("predicted"))
    rows = streams.table_stream(spark, sf, "events", "ts").join(means, "event_type")
    done = streams.run_available(streams.windowed_errors(rows, "ts", "value", "predicted"), "window-errors")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_closed_runs", f"""
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, max_by(event_type, event_id) AS status FROM events GROUP BY 1, 2),
c AS (SELECT * FROM d WHERE day + INTERVAL 1 DAY <= {WATERMARK}),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w OR day > lag(day) OVER w + INTERVAL 7 DAYS
      THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM f),
r AS (SELECT user_id, run, min(day) AS start, max(day) AS last, max(status) AS value, count(*) AS length FROM n GROUP BY 1, 2)
SELECT user_id, start, value, length FROM r
QUALIFY run < max(run) OVER (PARTITION BY user_id) OR last + INTERVAL 8 DAYS <= {WATERMARK}""")
def stream_closed_runs(spark, sf):
    rows = streams.table_stream(spark, sf, "events", "ts")
    days = streams.last_status_per_day(rows, "user_id", "ts", F.col("event_type"), "event_id")
    done = streams.run_available(streams.closed_runs(days, "user_id"), "closed-runs")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_enriched", """
SELECT e.event_id, e.user_id, e.event_type, coalesce(c.target, -1) AS target
FROM events e LEFT JOIN client c ON e.user_id = c.client_id""")
def stream_enriched(spark, sf):
    labels = roles.client(spark, sf).select(F.col("client_id").alias("user_id"), "target")
    rows = streams.table_stream(spark, sf, "events").select("event_id", "user_id", "event_type")
    return streams.run_available(streams.enrich(rows, labels, "user_id"), "enriched")


@query("stream_category_counts", f"""
SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 7 DAYS, max(ts), TIMESTAMP '1970-01-01') + INTERVAL 7 DAYS <= {WATERMARK}""")
def stream_category_counts(spark, sf):
    rows = streams.table_stream(spark, sf, "events", "ts")
    done = streams.run_available(streams.windowed_shares(rows, "ts", "event_type"), "category-counts")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


#: A share of drift from which on a window is reported.
KS_LIMIT = 0.25
WEEK_START = "time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01')"


def week_drift_sql(column: str, x: str) -> str:
    """Distance of each week's distribution from that of all rows, over all values."""
    return f"""SELECT start, '{column}' AS column_name, max(n) AS n, max(abs(a / n - b / t)) >= {KS_LIMIT} AS drifted FROM (
  SELECT w.start, w.n, sum(coalesce(c.k, 0)) OVER q AS a, sum(v.k) OVER q AS b, sum(v.k) OVER (PARTITION BY w.start) AS t
  FROM (SELECT {WEEK_START} AS start, count({x}) AS n FROM events GROUP BY 1) w
  CROSS JOIN (SELECT {x} AS v, count(*) AS k FROM events WHERE {x} IS NOT NULL GROUP BY 1) v
  LEFT JOIN (SELECT {WEEK_START} AS start, {x} AS v, count(*) AS k FROM events GROUP BY 1, 2) c ON c.start = w.start AND c.v = v.v
  WHERE w.start + INTERVAL 7 DAYS <= {WATERMARK} WINDOW q AS (PARTITION BY w.start ORDER BY v.v)) d GROUP BY start"""


@query("stream_numeric_drift", " UNION ALL ".join(week_drift_sql(c, x) for c, x in (("value", "value"), ("hour", "hour(ts)"))))
def stream_numeric_drift(spark, sf):
    rows = streams.table_stream(spark, sf, "events", "ts").withColumn("hour", F.hour("ts"))
    reference = scan(spark, sf, "events").withColumn("hour", F.hour("ts"))
    done = streams.run_available(streams.windowed_ks(rows, "ts", ["value", "hour"], reference, threshold=KS_LIMIT), "numeric-drift")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "column_name", "n", "drifted")


def shares(spark, sf):
    """Reference shares of the event types, exact counts over the whole table."""
    rows = scan(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()
    total = sum(r["n"] for r in rows)
    return {r["event_type"]: r["n"] / total for r in rows}


@query("stream_drift", f"""
WITH t AS (SELECT event_type, greatest(count(*) / sum(count(*)) OVER (), 0.0001) AS q FROM events GROUP BY 1),
w AS (SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, max(ts) AS last, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT w.start, w.n, t.event_type, t.q,
             greatest((SELECT count(*) FROM events e WHERE e.event_type = t.event_type
                       AND time_bucket(INTERVAL 7 DAYS, e.ts, TIMESTAMP '1970-01-01') = w.start) / w.n, 0.0001) AS p
      FROM w CROSS JOIN t WHERE w.start + INTERVAL 7 DAYS <= {WATERMARK}),
s AS (SELECT start, max(n) AS n, round(sum((p - q) * ln(p / q)), 6) AS psi FROM c GROUP BY 1)
SELECT start, n, psi, psi >= 0.2 AS drifted FROM s""")
def stream_drift(spark, sf):
    rows = streams.table_stream(spark, sf, "events", "ts")
    done = streams.run_available(streams.windowed_drift(rows, "ts", "event_type", shares(spark, sf)), "drift")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))
