"""Role views: the given tables read as clients, loans, instalments and monthly series.

Each role is a DataFrame builder, and an SQL text that DuckDB runs over the same tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.sources.tables import nan_to_null
from featmart.sources.tables import scan as scan_raw

SQL: dict[str, str] = {}

# Fixed values shared by the builders and the SQL texts.
LEDGER_DATE = "2001-12-31"
SERIES_DATE = "2024-01-30"
DAYS_PER_MONTH = 30.436875  # 365.2425 / 12


def mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b(?!\s*\.|\s*AS\s*\()", text) is not None


def days_before(date: str, col: str):
    return F.datediff(F.lit(date).cast("date"), F.col(col))


def scan(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A raw table whose NaN are missing values."""
    return nan_to_null(scan_raw(spark, sf, name))


SQL["client"] = """
SELECT c_custkey AS client_id,
       CASE WHEN c_custkey % 7 = 0 THEN -1 WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target,
       c_mktsegment AS segment, c_nationkey AS region_key, c_acctbal AS balance
FROM customer"""


def client(spark: SparkSession, sf: str) -> DataFrame:
    """Applications: one row per client with a label, -1 where it is unknown."""
    return scan(spark, sf, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.when(F.col("c_custkey") % 7 == 0, -1).when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("target"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("region_key"),
        F.col("c_acctbal").alias("balance"),
    )


SQL["loan"] = f"""
SELECT o_orderkey AS loan_id, o_custkey AS client_id, o_orderstatus AS status,
       o_orderpriority AS priority, o_totalprice AS amount,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '{LEDGER_DATE}') AS loan_day
FROM orders"""


def loan(spark: SparkSession, sf: str) -> DataFrame:
    """Previous applications: one row per loan."""
    return scan(spark, sf, "orders").select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"),
        days_before(LEDGER_DATE, "o_orderdate").cast("long").alias("loan_day"),
    )


SQL["installment"] = f"""
SELECT o_custkey AS client_id, l_orderkey AS loan_id, l_linenumber AS number,
       l_suppkey % 3 AS version,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '{LEDGER_DATE}') - 30 * l_linenumber AS due_day,
       date_diff('day', CAST(l_shipdate AS DATE), DATE '{LEDGER_DATE}') AS paid_day,
       l_extendedprice AS due,
       CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN NULL
            ELSE l_extendedprice * (1 - l_discount) END AS paid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def installment(spark: SparkSession, sf: str) -> DataFrame:
    """Instalment payments; days count back from the ledger date, `paid` may be missing.

    Each side takes its final columns before the join, so that it moves no more than the
    query reads of them.
    """
    lines = scan(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("loan_id"),
        F.col("l_linenumber").alias("number"),
        (F.col("l_suppkey") % 3).alias("version"),
        days_before(LEDGER_DATE, "l_shipdate").cast("long").alias("paid_day"),
        F.col("l_extendedprice").alias("due"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0), None)
        .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .alias("paid"),
    )
    loans = scan(spark, sf, "orders").select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("client_id"), days_before(LEDGER_DATE, "o_orderdate").alias("_day")
    )
    return lines.join(loans, "loan_id").select(
        "client_id", "loan_id", "number", "version",
        (F.col("_day") - 30 * F.col("number")).cast("long").alias("due_day"), "paid_day", "due", "paid",
    )


SQL["monthly"] = f"""
SELECT client_id, loan_id, month, max_by(status, event_id) AS status FROM (
  SELECT event_id, user_id AS client_id, user_id * 2 + event_id % 2 AS loan_id,
         CAST(date_diff('day', CAST(ts AS DATE), DATE '{SERIES_DATE}') AS BIGINT) AS month,
         CASE event_type WHEN 'signup' THEN 'X' WHEN 'purchase' THEN 'C'
                         WHEN 'view' THEN '0' WHEN 'click' THEN '1' ELSE '5' END AS status
  FROM events) e GROUP BY client_id, loan_id, month"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Status series: the last event of each (loan, month); month 0 is now.

    The status travels as a small integer while grouping, so the aggregate stays a hash
    aggregate with map-side combine; a hot loan shrinks to one row per month per task.
    """
    events = scan(spark, sf, "events").select(
        F.col("user_id").alias("client_id"),
        (F.col("user_id") * 2 + F.col("event_id") % 2).alias("loan_id"),
        days_before(SERIES_DATE, "ts").cast("long").alias("month"),
        F.when(F.col("event_type") == "signup", -1)
        .when(F.col("event_type") == "purchase", -2)
        .when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "click", 1)
        .otherwise(5)
        .alias("code"),
        "event_id",
    )
    last = events.groupBy("client_id", "loan_id", "month").agg(F.max_by("code", "event_id").alias("code"))
    return last.select(
        "client_id",
        "loan_id",
        "month",
        F.when(F.col("code") == -1, "X")
        .when(F.col("code") == -2, "C")
        .otherwise(F.col("code").cast("string"))
        .alias("status"),
    )


SQL["loan_map"] = "SELECT DISTINCT loan_id, client_id FROM monthly WHERE month = 0"


def loan_map(spark: SparkSession, sf: str) -> DataFrame:
    """External-loan headers: only loans still reported now have one, so orphans exist."""
    return monthly(spark, sf).filter("month = 0").select("loan_id", "client_id").distinct()


SQL["account"] = f"""
SELECT client_id, loan_id, month,
       CASE WHEN closed AND total >= 0 THEN floor(total) ELSE total END AS drawn,
       cnt AS cnt_drawn, atm AS drawn_atm, cnt_atm, pos AS drawn_pos, cnt_pos,
       oth AS drawn_other, cnt_oth AS cnt_other, balance, receivable, payment
FROM (
  SELECT o_custkey AS client_id, l_orderkey AS loan_id,
         CAST(floor(date_diff('day', CAST(l_shipdate AS DATE), DATE '{LEDGER_DATE}') / {DAYS_PER_MONTH}) AS BIGINT) AS month,
         round(sum(l_extendedprice * (1 - 15 * l_discount)), 4) AS total,
         count(*) AS cnt,
         round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 4) AS atm,
         count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS cnt_atm,
         round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 4) AS pos,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS cnt_pos,
         round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 4) AS oth,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS cnt_oth,
         round(sum(l_extendedprice), 4) AS balance,
         round(sum(l_extendedprice * (1 + l_tax)), 4) AS receivable,
         round(sum(CASE WHEN l_discount > 0.02 THEN l_extendedprice * l_discount ELSE 0 END), 4) AS payment,
         min(l_linestatus) = 'O' AS closed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3) a"""


def account(spark: SparkSession, sf: str) -> DataFrame:
    """Card accounts by month: drawings in total and by kind, some totals not adding up.

    Lines are grouped before the order's client is attached: a hot order reaches the join
    as one row per month.
    """
    rows = scan(spark, sf, "lineitem")
    price = F.col("l_extendedprice")

    def part(flag: str):
        return F.round(F.sum(F.when(F.col("l_returnflag") == flag, price)), 4)

    def part_count(flag: str):
        return F.count_if(F.col("l_returnflag") == flag)

    grouped = rows.groupBy(
        F.col("l_orderkey").alias("loan_id"),
        F.floor(days_before(LEDGER_DATE, "l_shipdate") / F.lit(DAYS_PER_MONTH)).alias("month"),
    ).agg(
        F.round(F.sum(price * (1 - 15 * F.col("l_discount"))), 4).alias("total"),
        F.count("*").alias("cnt_drawn"),
        part("A").alias("drawn_atm"),
        part_count("A").alias("cnt_atm"),
        part("R").alias("drawn_pos"),
        part_count("R").alias("cnt_pos"),
        part("N").alias("drawn_other"),
        part_count("N").alias("cnt_other"),
        F.round(F.sum(price), 4).alias("balance"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 4).alias("receivable"),
        F.round(
            F.sum(F.when(F.col("l_discount") > 0.02, price * F.col("l_discount")).otherwise(0.0)), 4
        ).alias("payment"),
        F.bool_and(F.col("l_linestatus") != "F").alias("closed"),
    )
    drawn = F.when(F.col("closed") & (F.col("total") >= 0), F.floor("total").cast("double")).otherwise(F.col("total"))
    owners = scan(spark, sf, "orders").select(F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("client_id"))
    return grouped.join(owners, "loan_id").select(
        "client_id", "loan_id", "month", drawn.alias("drawn"), "cnt_drawn",
        "drawn_atm", "cnt_atm", "drawn_pos", "cnt_pos", "drawn_other", "cnt_other",
        "balance", "receivable", "payment",
    )


SQL["labelled_docs"] = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a really missing label: documents left-joined to their labels."""
    return scan(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        scan(spark, sf, "labels"), "doc_id", "left"
    )


SQL["sentinel"] = """
SELECT c_custkey AS client_id,
       CASE WHEN c_acctbal < 0 THEN 365243 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS days_employed,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'XNA' ELSE c_mktsegment END AS segment,
       CASE WHEN c_acctbal > 9000 THEN -1 ELSE c_nationkey END AS area
FROM customer"""


def sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """Clients with missing values coded as sentinels."""
    return scan(spark, sf, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(365243).cast("long"))
        .otherwise(F.floor("c_acctbal"))
        .alias("days_employed"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "XNA").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 9000, -1).otherwise(F.col("c_nationkey")).alias("area"),
    )


SQL["scored"] = """
SELECT client_id, target, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM (
  SELECT c.client_id, c.target,
         round(least(greatest(0.5 - c.balance / 20000.0 + coalesce(n.late, 0) * 0.01, 0), 1), 3) AS score
  FROM client c LEFT JOIN (
    SELECT client_id, count(*) AS late FROM loan WHERE status = 'F' GROUP BY client_id) n
  ON c.client_id = n.client_id WHERE c.target > -1) s"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled clients with a deterministic score, rounded so that ties occur."""
    late = loan(spark, sf).filter("status = 'F'").groupBy("client_id").agg(F.count("*").alias("late"))
    joined = client(spark, sf).filter("target > -1").join(late, "client_id", "left")
    score = F.round(
        F.least(
            F.greatest(
                # Hundredths by division: 7 * 0.01 is not 0.07, and a score near half a unit would turn.
                0.5 - F.col("balance") / 20000.0 + F.coalesce(F.col("late"), F.lit(0)) / 100, F.lit(0.0)
            ),
            F.lit(1.0),
        ),
        3,
    )
    return joined.select("client_id", "target", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )
