"""Roll-ups to loan and client grain, and the feature mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions.scalars import mapped, status_by_priority
from featmart.operators import aggregate
from featmart.operators.keys import join_parts
from featmart.plans import mart, roles
from featmart.plans.registry import query
from featmart.sources.tables import scan

STAT_SQL = {
    "min": "min({x})", "max": "max({x})", "mean": "avg({x})", "sum": "sum({x})", "var": "var_samp({x})",
    "count": "count({x})", "nunique": "count(DISTINCT {x})", "size": "count({x})",
}
WHOLE = {"month_min", "month_max", "month_size", "worst", "loan_day", "dpd", "dbd", "paid_day", "version", "month", "level"}


def rules_sql(rules, prefix, where=None, decimals=None) -> str:
    out = []
    for c, stats in rules.items():
        x = c if where is None else f"CASE WHEN {where} THEN {c} END"
        for s in stats:
            sql = STAT_SQL[s].format(x=x if s != "size" else ("1" if where is None else f"CASE WHEN {where} THEN 1 END"))
            if decimals is not None and s == "mean":
                sql = f"round(sum({x}), {decimals}) / nullif(count({x}), 0)"
            elif decimals is not None and s in ("sum", "var"):
                sql = f"round({sql}, {decimals if s == 'sum' else 1})"
            if s == "sum" and c in WHOLE:
                sql = f"CAST({sql} AS BIGINT)"
            out.append(f"{sql} AS {prefix.lower()}_{c}_{s}")
    return ", ".join(out)


SIMPLE = {"amount": ("min", "max", "mean", "sum", "var"), "loan_day": ("mean", "nunique"), "priority": ("nunique", "count", "size")}


@query("rule_agg", f"SELECT client_id, {rules_sql(SIMPLE, 'prev', decimals=4)} FROM loan GROUP BY client_id")
def rule_agg(spark, sf):
    return aggregate.rule_agg(roles.loan(spark, sf), ["client_id"], SIMPLE, "prev", 4)


EXTERNAL = """ext AS (SELECT client_id, loan_id, min(month) AS month_min, max(month) AS month_max, count(*) AS month_size,
  max(CASE WHEN status NOT IN ('X', 'C') THEN CAST(status AS INTEGER) END) AS worst,
  min_by(CASE WHEN status = 'C' THEN 1 ELSE 0 END, month) AS closed, """ + ", ".join(
    f"count(*) FILTER (status = '{v}') / count(*) AS {name}_mean" for name, v in mart.MONTH_DUMMIES.items()) + """
  FROM monthly GROUP BY client_id, loan_id)"""


@query("monthly_to_loan", f"""
WITH {EXTERNAL} SELECT x.loan_id, x.client_id, e.month_min, e.month_max, e.month_size, e.worst, e.closed,
  {", ".join(f"e.{name}_mean" for name in mart.MONTH_DUMMIES)}
FROM loan_map x LEFT JOIN ext e ON x.loan_id = e.loan_id""")
def monthly_to_loan(spark, sf):
    rolled = mart.external_loans(spark, sf).drop("client_id")
    return roles.loan_map(spark, sf).join(rolled, "loan_id", "left")


EXT_CLIENT = f"""SELECT client_id, {rules_sql(mart.EXTERNAL_RULES, 'ext', decimals=6)},
{rules_sql(mart.EXTERNAL_RULES, 'active', 'closed = 0', 6)}, {rules_sql(mart.EXTERNAL_RULES, 'closed', 'closed = 1', 6)}
FROM ext GROUP BY client_id"""
LOAN_CLIENT = f"""SELECT client_id, {rules_sql(mart.LOAN_RULES, 'prev', decimals=6)},
{rules_sql(mart.LOAN_RULES, 'approved', "status = 'F'", 6)}, {rules_sql(mart.LOAN_RULES, 'refused', "status = 'P'", 6)}
FROM (SELECT *, {", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {name}" for c, d in mart.LOAN_DUMMIES.items() for name, v in d.items())}
  FROM loan) l GROUP BY client_id"""
INST_CLIENT = f"""SELECT client_id, {rules_sql(mart.INSTALMENT_RULES, 'inst', decimals=4)}, count(*) AS inst_count FROM (
  SELECT *, paid / nullif(due, 0) AS payment_perc, due - paid AS payment_diff, greatest(due_day - paid_day, 0) AS dpd,
         greatest(paid_day - due_day, 0) AS dbd FROM installment) i GROUP BY client_id"""
CARD_CLIENT = f"SELECT client_id, {rules_sql(mart.CARD_RULES, 'card', decimals=4)}, count(*) AS card_count FROM account GROUP BY client_id"


@query("loan_to_client_subsets", f"WITH {EXTERNAL} {EXT_CLIENT}")
def loan_to_client_subsets(spark, sf):
    return mart.external_to_client(spark, sf)


@query("application_to_client_subsets", LOAN_CLIENT)
def application_to_client_subsets(spark, sf):
    return mart.loans_to_client(spark, sf)


@query("installments_to_client", INST_CLIENT)
def installments_to_client(spark, sf):
    return mart.installments_to_client(spark, sf)


POS_CLIENT = f"""
SELECT a.client_id, {rules_sql(mart.POS_RULES, 'pos', decimals=4)},
       {', '.join(f"round(avg(CASE WHEN l.status = '{s}' THEN 1.0 ELSE 0.0 END), 6) AS pos_status_{s.lower()}_mean" for s in mart.STATUSES)},
       count(*) AS pos_count
FROM account a JOIN loan l ON a.loan_id = l.loan_id GROUP BY a.client_id"""


@query("pos_to_client", POS_CLIENT)
def pos_to_client(spark, sf):
    return mart.pos_to_client(spark, sf)


CARD_ALL = {c: ("min", "max", "mean", "sum", "var") for c in ("drawn", "balance", "receivable", "payment")}


@query("all_stats_to_client", f"SELECT client_id, {rules_sql(CARD_ALL, 'card', decimals=4)}, count(*) AS card_count FROM account GROUP BY 1")
def all_stats_to_client(spark, sf):
    account = roles.account(spark, sf).select("client_id", "loan_id", "drawn", "balance", "receivable", "payment")
    return aggregate.agg_all_stats(account, "client_id", "card", ["loan_id"], 4)


NUMERIC = {c: ("count", "mean", "max", "min", "sum") for c in ("amount", "loan_day")}


@query("agg_numeric", f"SELECT client_id, {rules_sql(NUMERIC, 'prev', decimals=4)} FROM loan GROUP BY 1")
def agg_numeric(spark, sf):
    return aggregate.agg_numeric(roles.loan(spark, sf), "client_id", "prev", ["loan_id"], 4)


@query("agg_categorical", "SELECT client_id, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS prev_status_{s.lower()}_count, count(*) FILTER (status = '{s}') / count(*) AS prev_status_{s.lower()}_norm"
    for s in mart.STATUSES) + " FROM loan GROUP BY 1")
def agg_categorical(spark, sf):
    return aggregate.agg_categorical(roles.loan(spark, sf), "client_id", ["status"], "prev")


LOAN_LEVEL = {"month": ("count", "mean", "max", "min", "sum"), "level": ("count", "mean", "max", "min", "sum")}
LOAN_LEVEL_NAMES = [f"m_{c}_{s}" for c, stats in LOAN_LEVEL.items() for s in stats] + [
    f"m_status_{v}_{k}" for v in ("0", "1", "5", "c", "x") for k in ("count", "norm")]


@query("two_level_agg", f"""
WITH s AS (SELECT *, CASE WHEN status NOT IN ('X', 'C') THEN CAST(status AS INTEGER) END AS level FROM monthly),
l AS (SELECT client_id, loan_id, {rules_sql(LOAN_LEVEL, 'm')}, {", ".join(
    f"count(*) FILTER (status = '{v}') AS m_status_{v.lower()}_count, count(*) FILTER (status = '{v}') / count(*) AS m_status_{v.lower()}_norm"
    for v in ("0", "1", "5", "C", "X"))} FROM s GROUP BY 1, 2)
SELECT client_id, {", ".join(
    f"count({c}) AS client_{c}_count, round(sum({c}), 6) / nullif(count({c}), 0) AS client_{c}_mean, max({c}) AS client_{c}_max, min({c}) AS client_{c}_min, "
    + (f"round(sum({c}), 6)" if c.endswith(("mean", "norm")) else f"CAST(sum({c}) AS BIGINT)") + f" AS client_{c}_sum"
    for c in LOAN_LEVEL_NAMES)} FROM l GROUP BY 1""")
def two_level_agg(spark, sf):
    number = F.when(~F.col("status").isin("X", "C"), F.col("status").cast("int"))
    child = roles.monthly(spark, sf).withColumn("level", number)
    return aggregate.two_level(child, "loan_id", "client_id", "m", category="status", decimals=6)


def pivot_sums(*columns_):
    return [F.round(F.sum(c), 4).alias(c) for c in columns_]


def card_rows(spark, sf):
    names = roles.loan(spark, sf).select("loan_id", mapped("status", mart.STATUS_NAMES).alias("contract"))
    account = roles.account(spark, sf).select("client_id", "loan_id", "month", "balance", "payment")
    return account.join(names, "loan_id")


CONTRACTS = tuple(mart.STATUS_NAMES.values())
CARD_ROWS = """card AS (SELECT a.client_id, a.loan_id, a.month, a.balance, a.payment,
  CASE l.status WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Active' ELSE 'Refused' END AS contract
  FROM account a JOIN loan l ON a.loan_id = l.loan_id)"""
CONTRACT = "CASE WHEN bool_or(contract = 'Active') THEN 'Active' WHEN bool_or(contract = 'Completed') THEN 'Completed' ELSE 'Refused' END"


@query("client_month_agg", f"""
WITH {CARD_ROWS} SELECT client_id, month, count(*) AS n_prev, round(sum(balance), 4) AS balance,
  round(sum(payment), 4) AS payment, {CONTRACT} AS contract FROM card GROUP BY 1, 2""")
def client_month_agg(spark, sf):
    return aggregate.client_pivot_agg(
        card_rows(spark, sf), "month", pivot_sums("balance", "payment"), status="contract", statuses=CONTRACTS
    )


@query("client_month_agg_multi", f"""
WITH {CARD_ROWS}, s AS (SELECT client_id, min(loan_id) = max(loan_id) AS single FROM card GROUP BY 1)
SELECT c.client_id, month, count(*) AS n_prev, round(sum(balance), 4) AS balance, round(sum(payment), 4) AS payment, {CONTRACT} AS contract
FROM card c JOIN s ON c.client_id = s.client_id WHERE NOT single GROUP BY 1, 2
UNION ALL
SELECT c.client_id, month, 1, balance, payment, contract FROM card c JOIN s ON c.client_id = s.client_id WHERE single""")
def client_month_agg_multi(spark, sf):
    return aggregate.client_pivot_agg(
        card_rows(spark, sf), "month", pivot_sums("balance", "payment"), status="contract", statuses=CONTRACTS, include_uniques=False,
        columns=["balance", "payment"],
    )


@query("client_number_agg", """
SELECT client_id, number, count(*) AS n_prev, round(sum(due), 4) AS due, round(sum(paid), 4) AS paid
FROM installment GROUP BY 1, 2""")
def client_number_agg(spark, sf):
    return aggregate.client_pivot_agg(roles.installment(spark, sf), "number", pivot_sums("due", "paid"))


@query("status_priority", """
SELECT client_id, both_status, CASE WHEN contains(both_status, 'Active') THEN 'Active' WHEN contains(both_status, 'Signed') THEN 'Signed'
  WHEN contains(both_status, 'Completed') THEN 'Completed' WHEN contains(both_status, 'Demand') THEN 'Demand' ELSE both_status END AS status
FROM (SELECT client_id, min(s) || ' and ' || max(s) AS both_status FROM (
  SELECT client_id, CASE status WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Active' ELSE 'Refused' END AS s FROM loan) n GROUP BY 1) b""")
def status_priority(spark, sf):
    names = roles.loan(spark, sf).select("client_id", mapped("status", mart.STATUS_NAMES).alias("s"))
    both = names.groupBy("client_id").agg(F.concat_ws(" and ", F.min("s"), F.max("s")).alias("both_status"))
    return both.withColumn("status", status_by_priority("both_status"))


REGIONS = f"""regions AS (SELECT region_key, count(*) AS clients, count(*) FILTER (target = -1) AS label_unknown,
  count(*) FILTER (target = 0) AS label_repaid, count(*) FILTER (target = 1) AS label_default,
  {", ".join(f"count(*) FILTER (segment = '{s}') AS segment_{s.lower()}" for s in mart.SEGMENTS)},
  count(*) FILTER (balance < 0) AS in_debt FROM client GROUP BY region_key)"""


def regions(spark, sf):
    return aggregate.region_table(
        roles.client(spark, sf), "region_key", "target", "segment", mart.SEGMENTS, {"in_debt": F.col("balance") < 0}
    )


@query("region_table", f"WITH {REGIONS} SELECT *, row_number() OVER (ORDER BY clients DESC, region_key) AS region_id FROM regions")
def region_table(spark, sf):
    return regions(spark, sf)


@query("region_label_share", f"WITH {REGIONS} SELECT region_key, label_default / nullif(label_default + label_repaid, 0) AS default_share FROM regions")
def region_label_share(spark, sf):
    return aggregate.label_share(regions(spark, sf), "region_key")


@query("region_area_bridge", """
SELECT DISTINCT c.region_key, s.s_nationkey AS area FROM orders o JOIN client c ON o.o_custkey = c.client_id
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def region_area_bridge(spark, sf):
    client = roles.client(spark, sf).select(F.col("client_id").alias("o_custkey"), "region_key")
    area = scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    sales = scan(spark, sf, "orders").join(
        scan(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    ).select("o_custkey", "l_suppkey").distinct()
    return aggregate.bridge(client, sales, area, "o_custkey", "l_suppkey", ["region_key", "area"])


@query("area_profile", """
SELECT s_nationkey AS area, count(*) AS size, count(*) FILTER (l_returnflag = 'A') / count(*) AS l_returnflag_a,
       count(*) FILTER (l_returnflag = 'N') / count(*) AS l_returnflag_n, count(*) FILTER (l_returnflag = 'R') / count(*) AS l_returnflag_r
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def area_profile(spark, sf):
    sales = scan(spark, sf, "lineitem").join(scan(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = sales.select(F.col("s_nationkey").alias("area"), "l_returnflag")
    return aggregate.category_profile(rows, "area", "l_returnflag", ("A", "N", "R"), normalize=True)


SUMS = """sums AS (SELECT loan_id, client_id, count(month) AS n_months, round(sum(balance), 4) AS sum_balance, round(sum(drawn), 4) AS sum_drawn,
  round(sum(receivable), 4) AS sum_receivable, round(sum(payment), 4) AS sum_payment FROM account GROUP BY 1, 2)"""


@query("account_sums", f"WITH {SUMS} SELECT * FROM sums")
def account_sums(spark, sf):
    return aggregate.account_sums(roles.account(spark, sf))


# Accounts seen net of what they carry over, so that idle and uneven ones exist.
NET = """net AS (SELECT loan_id, client_id, month, CASE WHEN drawn < 0 THEN 0 ELSE greatest(drawn - balance, 0) END AS balance,
  CASE WHEN drawn < 0 THEN 0 ELSE drawn END AS drawn, receivable, CASE WHEN drawn < 0 THEN 0 ELSE payment END AS payment FROM account)"""


def net_sums(spark, sf):
    account = roles.account(spark, sf)
    idle = F.col("drawn") < 0
    net = account.withColumns({
        "balance": F.when(idle, 0.0).otherwise(F.greatest(F.col("drawn") - F.col("balance"), F.lit(0.0))),
        "drawn": F.when(idle, 0.0).otherwise(F.col("drawn")),
        "payment": F.when(idle, 0.0).otherwise(F.col("payment")),
    })
    return aggregate.account_sums(net)


NET_SUMS = f"{NET}, " + SUMS.replace("FROM account", "FROM net")


@query("null_accounts", f"WITH {NET_SUMS} SELECT * FROM sums WHERE sum_balance = 0 AND sum_drawn = 0 AND sum_payment = 0")
def null_accounts(spark, sf):
    return aggregate.null_accounts(net_sums(spark, sf))


@query("unbalanced_accounts", f"WITH {NET_SUMS} SELECT * FROM sums WHERE sum_balance = 0 AND NOT (sum_drawn = 0 AND sum_payment = 0)")
def unbalanced_accounts(spark, sf):
    return aggregate.unbalanced_accounts(net_sums(spark, sf))


@query("account_first_last", """
SELECT loan_id, count(*) AS n_months, max_by(balance, month) AS first, min_by(balance, month) AS last,
       round(min_by(balance, month) - max_by(balance, month), 4) AS movement FROM account GROUP BY 1""")
def account_first_last(spark, sf):
    return aggregate.first_last(roles.account(spark, sf), ["loan_id"], "month", "balance")


@query("value_counts_map", """
SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS counts, count(*) AS n_distinct
FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) c GROUP BY 1""")
def value_counts_map(spark, sf):
    counts = aggregate.value_count_map(scan(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")
    return counts.withColumn("counts", aggregate.map_text("counts"))


MART = f"""
WITH {EXTERNAL}, e AS ({EXT_CLIENT}), p AS ({LOAN_CLIENT}), i AS ({INST_CLIENT}), k AS ({CARD_CLIENT}), o AS ({POS_CLIENT})
SELECT c.client_id, c.target, c.region_key, c.balance,
       {", ".join(f"CASE WHEN c.segment = '{s}' THEN 1 ELSE 0 END AS segment_{s}" for s in mart.SEGMENTS)},
       e.* EXCLUDE (client_id), p.* EXCLUDE (client_id), i.* EXCLUDE (client_id), k.* EXCLUDE (client_id), o.* EXCLUDE (client_id)
FROM client c LEFT JOIN e ON c.client_id = e.client_id LEFT JOIN p ON c.client_id = p.client_id
LEFT JOIN i ON c.client_id = i.client_id LEFT JOIN k ON c.client_id = k.client_id LEFT JOIN o ON c.client_id = o.client_id"""


@query("feature_mart", MART)
def feature_mart(spark, sf):
    return mart.feature_mart(spark, sf)


@query("feature_mart_bucketed", MART)
def feature_mart_bucketed(spark, sf):
    """The mart from stored tables, bucketed by client; as many buckets as shuffle partitions."""
    client, *parts = mart.bucketed_star(spark, sf, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return join_parts(client, parts, "client_id")
