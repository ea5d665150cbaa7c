"""Occurrence numbers, lags, runs, supports, pivots and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions import runs
from featmart.operators import credit, sequence
from featmart.operators.ordering import occurrence_index
from featmart.plans import roles
from featmart.plans.aggregate_queries import pivot_sums
from featmart.plans.credit_queries import KNOWN, known
from featmart.plans.registry import query
from featmart.session import with_row
from featmart.sources.tables import scan


@query("occurrence_index", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS occurrence FROM events""")
def occurrence_index_(spark, sf):
    return occurrence_index(scan(spark, sf, "events").select("event_id", "event_type"), ["event_type"], [F.col("event_id")])


@query("occurrence_index_nd", """
SELECT o_orderkey, o_custkey, o_orderstatus,
       row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS occurrence FROM orders""")
def occurrence_index_nd(spark, sf):
    orders = scan(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return occurrence_index(orders, ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")])


CLIENT_MONTH = "cm AS (SELECT client_id, month, round(sum(payment), 4) AS payment FROM account GROUP BY 1, 2)"


def client_month(spark, sf):
    return roles.account(spark, sf).groupBy("client_id", "month").agg(*pivot_sums("payment"))


@query("lag_diff", f"""
WITH {CLIENT_MONTH} SELECT client_id, month, payment, lag(payment) OVER w AS payment_before,
  round(payment - lag(payment) OVER w, 4) AS payment_diff FROM cm WINDOW w AS (PARTITION BY client_id ORDER BY month)""")
def lag_diff(spark, sf):
    return sequence.lag_diff(client_month(spark, sf), ["client_id"], "month", "payment")


@query("last_per_key", """
SELECT user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) e WHERE rk = 1""")
def last_per_key(spark, sf):
    return sequence.last_per_key(scan(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("ewm_mean", f"""
WITH {CLIENT_MONTH}, p AS (SELECT *, power(0.9, -(row_number() OVER w - 1)) AS wt FROM cm WINDOW w AS (PARTITION BY client_id ORDER BY month))
SELECT client_id, month, round(sum(payment * wt) OVER v / sum(wt) OVER v, 5) AS ewm FROM p
WINDOW v AS (PARTITION BY client_id ORDER BY month ROWS UNBOUNDED PRECEDING)""")
def ewm_mean(spark, sf):
    means = sequence.ewm_mean(client_month(spark, sf), ["client_id"], "month", "payment", 0.1)
    return means.select("client_id", "month", F.round("ewm", 5).alias("ewm"))


MARKED = """flagged AS (SELECT loan_id, month, status, CASE WHEN row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w
  THEN 1 ELSE 0 END AS new FROM ({source}) q WINDOW w AS (PARTITION BY loan_id ORDER BY month)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY loan_id ORDER BY month) AS run FROM flagged),
runs AS (SELECT loan_id, run, min(month) AS start, max(status) AS value, count(*) AS len FROM numbered GROUP BY 1, 2)"""
RUNS = MARKED.format(source="SELECT loan_id, month, status FROM monthly")
GAPPED = "SELECT loan_id, month, nullif(status, 'X') AS status FROM monthly"
TEXT = "string_agg(coalesce(CAST(value AS VARCHAR), '-') || '*' || len, ',' ORDER BY start)"


def series(spark, sf):
    return roles.monthly(spark, sf).select("loan_id", "month", "status")


def gapped(spark, sf):
    return series(spark, sf).withColumn("status", F.when(F.col("status") != "X", F.col("status")))


@query("rle_runs", f"WITH {MARKED.format(source=GAPPED)} SELECT loan_id, start, value, len FROM runs")
def rle_runs(spark, sf):
    return sequence.rle_runs(gapped(spark, sf), ["loan_id"], "month", "status")


@query("rle_string", f"WITH {MARKED.format(source=GAPPED)} SELECT loan_id, {TEXT} AS text FROM runs GROUP BY loan_id")
def rle_string(spark, sf):
    collected = sequence.collect_runs(sequence.rle_runs(gapped(spark, sf), ["loan_id"], "month", "status"), ["loan_id"])
    return collected.select("loan_id", runs.runs_text("runs").alias("text"))


RLE_COLUMNS = {"n_prev": "CAST(n_prev AS VARCHAR)", "paid_any": "CAST(paid_any AS VARCHAR)", "level": "level"}
CARD_SERIES = """cs AS (SELECT client_id, month, count(*) AS n_prev, sum(payment) > 0 AS paid_any,
  CASE WHEN sum(drawn) < 0 THEN NULL WHEN sum(drawn) > 50000 THEN 'high' ELSE 'low' END AS level FROM account GROUP BY 1, 2)"""


@query("rle_all_columns", f"WITH {CARD_SERIES} " + " UNION ALL ".join(
    f"""(WITH f AS (SELECT client_id, month, {c}, CASE WHEN row_number() OVER w = 1 OR {c} IS DISTINCT FROM lag({c}) OVER w THEN 1 ELSE 0 END AS new
       FROM cs WINDOW w AS (PARTITION BY client_id ORDER BY month)), n AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY month) AS run FROM f)
     SELECT client_id, '{c}' AS column_name, min(month) AS start, max({x}) AS value, count(*) AS len FROM n GROUP BY client_id, run)"""
    for c, x in RLE_COLUMNS.items()))
def rle_all_columns(spark, sf):
    drawn = F.sum("drawn")
    table = roles.account(spark, sf).groupBy("client_id", "month").agg(
        F.count("*").alias("n_prev"),
        (F.sum("payment") > 0).alias("paid_any"),
        F.when(drawn < 0, None).when(drawn > 50000, "high").otherwise("low").alias("level"),
    )
    return sequence.rle_all_columns(table, ["client_id"], "month", list(RLE_COLUMNS))


def jumps_sql(keys: str, source: str) -> str:
    return f"""gaps AS (SELECT {keys}, month, month - coalesce(lag(month) OVER w, -1) AS jump FROM (SELECT DISTINCT {keys}, month FROM {source}) d
  WINDOW w AS (PARTITION BY {keys} ORDER BY month)),
gflag AS (SELECT *, CASE WHEN lag(jump) OVER w IS DISTINCT FROM jump THEN 1 ELSE 0 END AS new FROM gaps WINDOW w AS (PARTITION BY {keys} ORDER BY month)),
gnum AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY month) AS run FROM gflag),
jumps AS (SELECT {keys}, run, min(month) AS start, max(jump) AS jump, count(*) AS len FROM gnum GROUP BY {keys}, run)"""


JUMP_TEXT = "string_agg(jump || '*' || len, ',' ORDER BY start) AS support"


@query("rle_jumps", f"WITH {jumps_sql('loan_id', 'monthly')} SELECT loan_id, start, jump, len FROM jumps")
def rle_jumps(spark, sf):
    return sequence.rle_jumps(series(spark, sf), ["loan_id"], "month")


def supports(spark, sf, key="loan_id"):
    periods = sequence.tracking_period(roles.monthly(spark, sf), [key], "month")
    return sequence.collect_runs(periods, [key], "jump", "support")


@query("tracking_period_loan", f"WITH {jumps_sql('loan_id', 'monthly')} SELECT loan_id, {JUMP_TEXT} FROM jumps GROUP BY loan_id")
def tracking_period_loan(spark, sf):
    return supports(spark, sf).select("loan_id", runs.runs_text("support", "jump").alias("support"))


@query("tracking_period_client", f"WITH {jumps_sql('client_id', 'monthly')} SELECT client_id, {JUMP_TEXT} FROM jumps GROUP BY client_id")
def tracking_period_client(spark, sf):
    return supports(spark, sf, "client_id").select("client_id", runs.runs_text("support", "jump").alias("support"))


@query("tracking_period_card", f"WITH {jumps_sql('loan_id', 'account')} SELECT loan_id, {JUMP_TEXT} FROM jumps GROUP BY loan_id")
def tracking_period_card(spark, sf):
    periods = sequence.tracking_period(roles.account(spark, sf), ["loan_id"], "month")
    collected = sequence.collect_runs(periods, ["loan_id"], "jump", "support")
    return collected.select("loan_id", runs.runs_text("support", "jump").alias("support"))


@query("variation_by_loan", f"""
WITH {KNOWN}, {MARKED.format(source="SELECT loan_id, month, CASE WHEN status = 'C' THEN 0 ELSE CAST(status AS INTEGER) END AS status FROM known")}
SELECT loan_id, {TEXT} AS variation FROM runs GROUP BY loan_id""")
def variation_by_loan(spark, sf):
    statuses = known(spark, sf).withColumn("status", credit.status_number("status"))
    collected = sequence.collect_runs(sequence.rle_runs(statuses, ["loan_id"], "month", "status"), ["loan_id"])
    return collected.select("loan_id", runs.runs_text("runs").alias("variation"))


@query("variation_by_client", f"""
WITH {KNOWN}, {MARKED.format(source="SELECT client_id AS loan_id, month, CAST(sum(CASE WHEN status <> 'C' THEN 1 ELSE 0 END) AS BIGINT) AS status FROM known GROUP BY 1, 2")}
SELECT loan_id AS client_id, {TEXT} AS variation FROM runs GROUP BY loan_id""")
def variation_by_client(spark, sf):
    active = credit.active_loans(known(spark, sf))
    found = sequence.rle_runs(active, ["client_id"], "month", "active_loans")
    return sequence.collect_runs(found, ["client_id"]).select("client_id", runs.runs_text("runs").alias("variation"))


@query("support_measures", """
WITH g AS (SELECT loan_id, month, month - coalesce(lag(month) OVER (PARTITION BY loan_id ORDER BY month), -1) AS jump FROM monthly)
SELECT loan_id, count(*) AS size, min(month) AS first, max(month) AS last, count(*) FILTER (jump > 1) AS holes FROM g GROUP BY 1""")
def support_measures(spark, sf):
    return supports(spark, sf).select(
        "loan_id",
        runs.support_size("support").alias("size"),
        runs.support_min("support").alias("first"),
        runs.support_max("support").alias("last"),
        runs.support_holes("support").alias("holes"),
    )


def encoded(spark, sf):
    """Support and frame of each loan side by side."""
    frame = sequence.collect_runs(
        sequence.rle_runs(gapped(spark, sf), ["loan_id"], "month", "status"), ["loan_id"], name="frame"
    )
    return supports(spark, sf).join(frame, "loan_id")


def full_width(spark, sf):
    """Encoded loans with the `width` that holds every one of their months."""
    frames = encoded(spark, sf)
    return with_row(frames, frames.agg((F.max(runs.support_max("support")) + 1).alias("width")))


@query("rle_expand", GAPPED)
def rle_expand(spark, sf):
    return sequence.expand_runs(encoded(spark, sf), ["loan_id"], "support", "frame", "month", "status")


@query("rle_dense_rows", """
WITH m AS (SELECT unnest(range(0, (SELECT max(month) + 1 FROM monthly))) AS month), l AS (SELECT DISTINCT loan_id FROM monthly)
SELECT l.loan_id, string_agg(coalesce(nullif(s.status, 'X'), '-'), '' ORDER BY m.month) AS cells
FROM l CROSS JOIN m LEFT JOIN monthly s ON s.loan_id = l.loan_id AND s.month = m.month GROUP BY 1""")
def rle_dense_rows(spark, sf):
    dense = full_width(spark, sf).withColumn("cells", runs.dense_row("support", "frame", F.col("width")))
    return dense.select("loan_id", F.array_join("cells", "", "-").alias("cells"))


@query("rle_size_check", """
SELECT loan_id, count(*) AS frame_size, count(DISTINCT month) AS support_size FROM monthly GROUP BY 1""")
def rle_size_check(spark, sf):
    return encoded(spark, sf).select(
        "loan_id", runs.total("frame").alias("frame_size"), runs.support_size("support").alias("support_size")
    )


@query("rle_divide", f"""
WITH m AS (SELECT unnest(range(0, (SELECT max(month) + 1 FROM monthly))) AS month), l AS (SELECT DISTINCT loan_id FROM monthly),
{MARKED.format(source="SELECT l.loan_id, m.month, nullif(s.status, 'X') AS status FROM l CROSS JOIN m LEFT JOIN monthly s ON s.loan_id = l.loan_id AND s.month = m.month")},
o AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY start) AS up, row_number() OVER (PARTITION BY loan_id ORDER BY start DESC) AS down,
      coalesce(value, 'C') = 'C' AS shut FROM runs)
SELECT loan_id, coalesce(CAST(sum(len) FILTER (up = 1 AND shut) AS BIGINT), 0) AS n_closed,
       coalesce(CAST(sum(len) FILTER (NOT (up = 1 AND shut) AND NOT (down = 1 AND shut)) AS BIGINT), 0) AS n_tracked,
       coalesce(CAST(sum(len) FILTER (down = 1 AND shut) AS BIGINT), 0) AS n_notrack,
       coalesce({TEXT} FILTER (NOT (up = 1 AND shut) AND NOT (down = 1 AND shut)), '') AS core
FROM o GROUP BY loan_id""")
def rle_divide(spark, sf):
    dense = full_width(spark, sf).select("loan_id", runs.array_runs(runs.dense_row("support", "frame", F.col("width"))).alias("runs"))
    parts = dense.select("loan_id", runs.divide("runs").alias("d")).select("loan_id", "d.*")
    return parts.withColumn("core", runs.runs_text("core"))


#: Months of the status series' calendar, and of the accounts'; rows of others are counted.
STATUS_MONTHS, ACCOUNT_MONTHS = range(30), range(96)


def pivot_sql(keys: str, source: str, months: range, columns: dict[str, str]) -> str:
    """A column for each month and each of `columns` (name behind the month: aggregate)."""
    cells = [f"{agg.format(f'FILTER (month = {m})')} AS m_{m}{name}" for m in months for name, agg in columns.items()]
    outside = f"count(*) FILTER (month IS NULL OR month < {months[0]} OR month > {months[-1]}) AS outside"
    return f"SELECT {keys}, {', '.join(cells)}, {outside} FROM {source} GROUP BY {keys}"


@query("pivot_months", pivot_sql("loan_id", "monthly", STATUS_MONTHS, {"": "max(status) {}"}))
def pivot_months(spark, sf):
    return sequence.pivot_values(series(spark, sf), ["loan_id"], "month", [F.max("status")], "m_", STATUS_MONTHS, "outside")


@query("pivot_months_multi", pivot_sql(
    "client_id", "account", ACCOUNT_MONTHS, {f"_{c}": f"round(sum({c}) {{}}, 4)" for c in ("balance", "payment")}))
def pivot_months_multi(spark, sf):
    sums = pivot_sums("balance", "payment")
    return sequence.pivot_values(roles.account(spark, sf), ["client_id"], "month", sums, "m_", ACCOUNT_MONTHS, "outside")


@query("pivot_counts", pivot_sql("status", "monthly", STATUS_MONTHS, {"": "nullif(count(*) {}, 0)"}))
def pivot_counts(spark, sf):
    return sequence.pivot_values(series(spark, sf), ["status"], "month", [F.count(F.lit(1))], "m_", STATUS_MONTHS, "outside")


@query("count_peaks", """
WITH c AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS BIGINT) AS x, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT *, max(n) OVER (ORDER BY x RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS before,
             max(n) OVER (ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS after FROM c)
SELECT x, n, x - lag(x) OVER (ORDER BY x) AS spacing FROM b WHERE n > before AND n >= after""")
def count_peaks(spark, sf):
    return sequence.count_peaks(roles.loan(spark, sf), "loan_day", 30)


@query("peak_distance", """
WITH RECURSIVE c AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS BIGINT) AS x, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS pos FROM c),
r AS (SELECT *, sum(fresh) OVER (ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN n IS DISTINCT FROM lag(n) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM s) q),
g AS (SELECT run, min(pos) AS a, max(pos) AS b, min(n) AS n FROM r GROUP BY run),
p AS (SELECT (a + b) // 2 AS pos, n FROM (SELECT *, lag(n) OVER (ORDER BY run) AS l, lead(n) OVER (ORDER BY run) AS h FROM g) q WHERE n > l AND n > h),
o AS (SELECT pos, row_number() OVER (ORDER BY n DESC, pos DESC) AS k FROM p),
t AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT t.k + 1, CASE WHEN len(list_filter(t.kept, lambda y: abs(y - o.pos) < 30)) = 0 THEN list_append(t.kept, o.pos) ELSE t.kept END
  FROM t JOIN o ON o.k = t.k + 1),
f AS (SELECT unnest(kept) AS pos FROM t WHERE k = (SELECT count(*) FROM o))
SELECT s.x, s.n, s.x - lag(s.x) OVER (ORDER BY s.x) AS spacing FROM f JOIN s ON f.pos = s.pos""")
def peak_distance(spark, sf):
    return sequence.value_count_peaks(roles.loan(spark, sf), "loan_day", 30)


@query("continuous_tracking", f"WITH {jumps_sql('loan_id', 'monthly')}, k AS (SELECT loan_id, count(*) AS n FROM jumps GROUP BY 1) SELECT n = 1 AS continuous, count(*) AS loans FROM k GROUP BY 1")
def continuous_tracking(spark, sf):
    return supports(spark, sf).groupBy((F.size("support") == 1).alias("continuous")).agg(F.count("*").alias("loans"))


HISTORY = ("drawn", "drawn_atm", "drawn_pos", "drawn_other", "balance", "payment")


@query("account_transposed", "WITH u AS (" + " UNION ALL ".join(
    f"SELECT loan_id, month, '{c}' AS variable, {c} AS value FROM account" for c in HISTORY) + """),
k AS (SELECT loan_id, variable FROM u GROUP BY 1, 2 HAVING max(abs(value)) > 0)
SELECT u.loan_id, u.variable, u.month, u.value FROM u JOIN k ON u.loan_id = k.loan_id AND u.variable = k.variable""")
def account_transposed(spark, sf):
    return sequence.transposed_history(roles.account(spark, sf), ["loan_id"], "month", HISTORY)


@query("status_month_support", f"""
WITH {jumps_sql('status, loan_id', 'monthly')}
SELECT status, loan_id, min(start) AS first, CAST(sum(jump * len) - 1 AS BIGINT) AS last, CAST(sum(len) AS BIGINT) AS n, {JUMP_TEXT}
FROM jumps GROUP BY 1, 2""")
def status_month_support(spark, sf):
    keys = ["status", "loan_id"]
    periods = sequence.tracking_period(roles.monthly(spark, sf), keys, "month")
    collected = sequence.collect_runs(periods, keys, "jump", "support")
    return collected.select(
        *keys, runs.support_min("support").alias("first"), runs.support_max("support").alias("last"),
        runs.support_size("support").alias("n"), runs.runs_text("support", "jump").alias("support"),
    )


@query("sorted_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sorted_rows(spark, sf):
    orders = scan(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.orderBy(F.asc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey"))
