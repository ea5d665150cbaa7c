"""Sentinels, casts, fills, repairs, imputation, and the per-table cleaning chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions import scalars
from featmart.operators import cleaning, keys
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.sources.tables import scan


@query("nullify_values", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_returnflag END AS l_returnflag,
       CASE WHEN l_linestatus NOT IN ('A', 'N') THEN l_linestatus END AS l_linestatus FROM lineitem""")
def nullify_values(spark, sf):
    lines = scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return cleaning.nullify(lines, ["A", "N"], ["l_returnflag", "l_linestatus"])


NULLED = """SELECT client_id, nullif(days_employed, 365243) AS days_employed,
       nullif(segment, 'XNA') AS segment, area FROM sentinel"""


@query("nullify_sentinels", NULLED)
def nullify_sentinels(spark, sf):
    return cleaning.nullify_sentinels(roles.sentinel(spark, sf), exclude=["client_id"])


@query("fill_constants", f"""
SELECT client_id, CASE WHEN days_employed = 365243 THEN 0 ELSE days_employed END AS days_employed,
       coalesce(nullif(segment, 'XNA'), 'missing') AS segment, CASE WHEN area = -1 THEN 2 ELSE area END AS area
FROM sentinel""")
def fill_constants(spark, sf):
    replaced = cleaning.replace_sentinels(
        roles.sentinel(spark, sf), {"days_employed": {cleaning.MISSING_DAYS: 0}, "area": {-1: 2}}
    )
    return cleaning.nullify(replaced, "XNA", ["segment"]).fillna({"segment": "missing"})


@query("negate_numeric", "SELECT -n_nationkey AS n_nationkey, -c_acctbal AS c_acctbal, c_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def negate_numeric(spark, sf):
    joined = scan(spark, sf, "customer").join(
        scan(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return cleaning.negate(joined.select("n_nationkey", "c_acctbal", "c_name"))


@query("encode_maps", """
SELECT o_orderkey, CASE dayname(o_orderdate) WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2
       WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 WHEN 'Sunday' THEN 6 END AS weekday,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status
FROM orders""")
def encode_maps(spark, sf):
    orders = scan(spark, sf, "orders").select(
        "o_orderkey", F.upper(F.date_format("o_orderdate", "EEEE")).alias("weekday"),
        F.col("o_orderstatus").alias("status"),
    )
    weekdays = {name: i for i, name in enumerate(scalars.WEEKDAYS)}
    return cleaning.encode_maps(orders, {"weekday": weekdays, "status": {"F": 0, "O": 1}})


@query("checked_cast", """
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, CAST(o_custkey AS BIGINT) AS client FROM orders""")
def checked_cast(spark, sf):
    orders = scan(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"),
        F.col("o_custkey").cast("string").alias("client"),
    )
    return cleaning.checked_cast(orders, {"level": "int", "client": "bigint"})


@query("cast_report", """
SELECT 'status' AS column_name, count(*) FILTER (TRY_CAST(status AS INTEGER) IS NULL) AS failures FROM monthly
UNION ALL SELECT 'loan_id', count(*) FILTER (TRY_CAST(loan_id AS INTEGER) IS NULL) FROM monthly""")
def cast_report(spark, sf):
    return cleaning.cast_report(roles.monthly(spark, sf), {"status": "int", "loan_id": "int"})


@query("ffill_status", """
SELECT loan_id, month, last_value(nullif(status, 'X') IGNORE NULLS) OVER (
  PARTITION BY loan_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status FROM monthly""")
def ffill_status(spark, sf):
    series = cleaning.nullify(roles.monthly(spark, sf).select("loan_id", "month", "status"), "X", ["status"])
    return cleaning.forward_fill(series, ["loan_id"], "month", ["status"])


@query("rows_complete", """
SELECT client_id, loan_id, month, drawn_atm, drawn_pos, drawn_other FROM account
WHERE drawn_atm IS NOT NULL AND drawn_pos IS NOT NULL""")
def rows_complete(spark, sf):
    account = roles.account(spark, sf).select("client_id", "loan_id", "month", "drawn_atm", "drawn_pos", "drawn_other")
    return account.dropna("any", subset=["drawn_atm", "drawn_pos"])


@query("rows_incomplete", """
SELECT client_id, loan_id, month, drawn_atm, drawn_pos, drawn_other FROM account
WHERE drawn_atm IS NULL OR drawn_pos IS NULL OR drawn_other IS NULL""")
def rows_incomplete(spark, sf):
    account = roles.account(spark, sf).select("client_id", "loan_id", "month", "drawn_atm", "drawn_pos", "drawn_other")
    return cleaning.rows_with_missing(account)


@query("repair_zero_amount", """
SELECT client_id, loan_id, month, CASE WHEN drawn_open = 0 THEN payment ELSE drawn_open END AS drawn_open, payment
FROM (SELECT client_id, loan_id, month, CASE WHEN cnt_pos > 0 THEN 0 ELSE drawn END AS drawn_open, payment FROM account) a""")
def repair_zero_amount(spark, sf):
    account = roles.account(spark, sf).select(
        "client_id", "loan_id", "month",
        F.when(F.col("cnt_pos") > 0, 0.0).otherwise(F.col("drawn")).alias("drawn_open"), "payment",
    )
    return cleaning.zero_takes(account, "drawn_open", "payment")


@query("month_bucket", """
SELECT loan_id, number, paid_day, CAST(floor(paid_day / 30.436875) AS BIGINT) AS month_down,
       CAST(ceil(paid_day / 30.436875) AS BIGINT) AS month_up FROM installment""")
def month_bucket(spark, sf):
    return roles.installment(spark, sf).select(
        "loan_id", "number", "paid_day",
        scalars.month_of_days("paid_day").alias("month_down"),
        scalars.month_of_days("paid_day", "up").alias("month_up"),
    )


@query("repair_breakdown", """
WITH g AS (SELECT *, round(drawn - (drawn_atm + drawn_pos + drawn_other), 2) AS gap FROM account),
k AS (SELECT *, coalesce(gap <> 0, false) AND (drawn < 0 OR (drawn > 0 AND drawn % 1 = 0)) AS whole,
             coalesce(gap <> 0, false) AND drawn > 0 AND drawn % 1 <> 0 AS frac FROM g)
SELECT loan_id, month, drawn, CASE WHEN whole OR frac THEN 1 ELSE cnt_drawn END AS cnt_drawn,
       CASE WHEN whole THEN drawn ELSE coalesce(drawn_atm, 0) END AS drawn_atm,
       CASE WHEN whole THEN 1 ELSE cnt_atm END AS cnt_atm,
       CASE WHEN frac THEN drawn ELSE coalesce(drawn_pos, 0) END AS drawn_pos,
       CASE WHEN frac THEN 1 ELSE cnt_pos END AS cnt_pos,
       coalesce(drawn_other, 0) AS drawn_other, cnt_other
FROM k""")
def repair_breakdown(spark, sf):
    account = roles.account(spark, sf).drop("client_id", "balance", "receivable", "payment")
    return cleaning.repair_breakdown(
        account, ("drawn", "cnt_drawn"), ("drawn_atm", "cnt_atm"), ("drawn_pos", "cnt_pos"),
        ("drawn_other", "cnt_other"),
    )


@query("impute_median", f"""
WITH n AS ({NULLED}), t AS (SELECT n.*, c.target FROM n JOIN client c ON n.client_id = c.client_id)
SELECT client_id, target, segment,
       coalesce(CAST(days_employed AS DOUBLE), (SELECT quantile_cont(CAST(days_employed AS DOUBLE), 0.5) FROM t WHERE target > -1)) AS days_employed,
       coalesce(CAST(nullif(area, -1) AS DOUBLE), (SELECT quantile_cont(CAST(nullif(area, -1) AS DOUBLE), 0.5) FROM t WHERE target > -1)) AS area
FROM t""")
def impute_median(spark, sf):
    rows = cleaning.nullify_sentinels(roles.sentinel(spark, sf), exclude=["client_id"])
    rows = cleaning.nullify(rows, -1, ["area"])
    labelled = keys.attach_target(rows, roles.client(spark, sf), "client_id")
    return cleaning.impute_median(labelled, ["days_employed", "area"], "target")


@query("orphan_rows", """
SELECT m.loan_id, m.month, m.status FROM monthly m WHERE m.loan_id NOT IN (SELECT loan_id FROM loan_map)""")
def orphan_rows(spark, sf):
    series = roles.monthly(spark, sf).select("loan_id", "month", "status")
    return series.join(roles.loan_map(spark, sf), "loan_id", "left_anti")


@query("unpaid_installments", "SELECT client_id, loan_id, number, version, due FROM installment WHERE paid IS NULL")
def unpaid_installments(spark, sf):
    return roles.installment(spark, sf).filter("paid IS NULL").select("client_id", "loan_id", "number", "version", "due")


@query("clean_monthly", """
WITH f AS (SELECT loan_id, month, last_value(nullif(status, 'X') IGNORE NULLS) OVER (
  PARTITION BY loan_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status FROM monthly)
SELECT f.loan_id, f.month, f.status, x.client_id, c.target
FROM f JOIN loan_map x ON f.loan_id = x.loan_id LEFT JOIN client c ON x.client_id = c.client_id
WHERE f.status IS NOT NULL""")
def clean_monthly(spark, sf):
    series = roles.monthly(spark, sf).drop("client_id")
    return (
        series.transform(cleaning.nullify, "X", ["status"])
        .transform(cleaning.forward_fill, ["loan_id"], "month", ["status"])
        .dropna(subset=["status"])
        .transform(keys.attach_client, roles.loan_map(spark, sf), "loan_id", "client_id")
        .transform(keys.attach_target, roles.client(spark, sf), "client_id")
    )


@query("clean_installments", """
SELECT i.client_id, i.loan_id, i.number, i.version, i.due_day, i.paid_day, i.due, i.paid,
       CAST(floor(i.paid_day / 30.436875) AS BIGINT) AS month, c.target
FROM installment i LEFT JOIN client c ON i.client_id = c.client_id WHERE i.paid IS NOT NULL""")
def clean_installments(spark, sf):
    return (
        roles.installment(spark, sf)
        .dropna(subset=["paid"])
        .transform(cleaning.zero_takes, "due", "paid")
        .withColumn("month", scalars.month_of_days("paid_day"))
        .transform(keys.attach_target, roles.client(spark, sf), "client_id")
    )


@query("clean_loan", """
SELECT l.loan_id, l.client_id, CASE l.status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status,
       CAST(substr(l.priority, 1, 1) AS INTEGER) AS priority, l.amount, -l.loan_day AS loan_day, coalesce(c.target, -1) AS target
FROM loan l LEFT JOIN client c ON l.client_id = c.client_id""")
def clean_loan(spark, sf):
    return (
        roles.loan(spark, sf)
        .withColumn("priority", F.substring("priority", 1, 1))
        .transform(cleaning.encode_maps, {"status": {"F": 0, "O": 1, "P": 2}})
        .transform(cleaning.checked_cast, {"priority": "int"})
        .transform(cleaning.negate, ["loan_day"])
        .transform(keys.attach_target, roles.client(spark, sf), "client_id")
    )


@query("clean_client", f"""
WITH n AS ({NULLED})
SELECT n.client_id, coalesce(n.days_employed, 0) AS days_employed, coalesce(n.segment, 'NONE') AS segment,
       CASE WHEN n.area = -1 THEN 2 ELSE n.area END AS area, c.target
FROM n JOIN client c ON n.client_id = c.client_id""")
def clean_client(spark, sf):
    return (
        cleaning.nullify_sentinels(roles.sentinel(spark, sf), exclude=["client_id"])
        .fillna({"days_employed": 0, "segment": "NONE"})
        .transform(cleaning.replace_sentinels, {"area": {-1: 2}})
        .transform(keys.attach_target, roles.client(spark, sf), "client_id")
    )
