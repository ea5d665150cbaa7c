"""Value counts, statistics, reports and rates by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.operators import profiling
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.plans.source_queries import COLUMNS
from featmart.sources.tables import scan


def rounded(df, *columns, decimals=6):
    return df.withColumns({c: F.round(c, decimals) for c in columns})


TAIL = """c AS (SELECT {col} AS value, count(*) AS n FROM {table} GROUP BY 1),
o AS (SELECT value, n, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS upto,
      row_number() OVER (ORDER BY n DESC, value) AS place FROM c),
{mark},
r AS (SELECT *, in_tail AND count(*) FILTER (in_tail) OVER () > 1 AS merged FROM t)"""
BY_SHARE = "t AS (SELECT *, (total - upto + n) / total < {tail} AS in_tail FROM o)"
BY_WEIGHT = """w AS (SELECT *, n > total - upto AND total > upto AS outweighs FROM o),
f AS (SELECT coalesce(min(place) FILTER (outweighs), 1) AS first FROM w),
s AS (SELECT min(place) AS start FROM w, f WHERE place >= first AND NOT outweighs),
t AS (SELECT w.*, place >= start AS in_tail FROM w, s)"""
COUNTED = """SELECT CAST(value AS VARCHAR) AS value, n, n / total AS proportion FROM r WHERE NOT merged
UNION ALL SELECT min(value) || ':' || max(value), CAST(sum(n) AS BIGINT), sum(n) / max(total) FROM r WHERE merged HAVING count(*) > 0"""


@query("value_counts", """
SELECT p_type AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS proportion FROM part GROUP BY 1""")
def value_counts(spark, sf):
    return profiling.value_counts(scan(spark, sf, "part"), "p_type")


@query("value_counts_tail", f"WITH {TAIL.format(col='p_brand', table='part', mark=BY_SHARE.format(tail=0.15))} {COUNTED}")
def value_counts_tail(spark, sf):
    return profiling.value_counts(scan(spark, sf, "part"), "p_brand", 0.15)


@query("value_counts_auto", f"WITH {TAIL.format(col='l_suppkey % 7 * (l_suppkey % 3)', table='lineitem', mark=BY_WEIGHT)} {COUNTED}")
def value_counts_auto(spark, sf):
    lines = scan(spark, sf, "lineitem").select((F.col("l_suppkey") % 7 * (F.col("l_suppkey") % 3)).alias("v"))
    return profiling.value_counts(lines, "v", True)


@query("reduce_long_tail", f"""
WITH {TAIL.format(col='p_brand', table='part', mark=BY_SHARE.format(tail=0.3))},
l AS (SELECT min(value) || ':' || max(value) AS label FROM r WHERE merged)
SELECT p.p_partkey, CASE WHEN r.merged THEN l.label ELSE p.p_brand END AS p_brand
FROM part p JOIN r ON p.p_brand = r.value, l""")
def reduce_long_tail(spark, sf):
    return profiling.reduce_long_tail(scan(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 0.3)


def stats_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count({column}) AS n, count(DISTINCT {column}) AS n_unique,
    count(*) - count({column}) AS n_missing, count({column}) / nullif(count(*), 0) AS fill_rate,
    count(DISTINCT {column}) / nullif(count({column}), 0) AS diversity FROM {table}"""


@query("discrete_stats", " UNION ALL ".join(
    stats_sql("labelled_docs", c) for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def discrete_stats(spark, sf):
    return profiling.discrete_stats(roles.labelled_docs(spark, sf))


# Vectors have no discrete values; all other tables are profiled.
STAT_TABLES = tuple(t for t in COLUMNS if t != "embeddings")


@query("db_discrete_stats", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, * FROM ({stats_sql(t, c)}) s{i}{t}"
    for t in STAT_TABLES for i, c in enumerate(COLUMNS[t].split())))
def db_discrete_stats(spark, sf):
    return profiling.discrete_stats_of({t: scan(spark, sf, t) for t in STAT_TABLES})


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


def moments_sql(c: str, d: int = 4) -> str:
    return f"""count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    round(avg({c}), {d}) AS mean, round(var_samp({c}), {d}) AS var, round(stddev_samp({c}), {d}) AS std,
    round(skewness({c}), {d}) AS skew, round(kurtosis({c}), {d}) AS kurt"""


@query("data_report_numeric", " UNION ALL ".join(
    f"""(WITH q AS (SELECT {moments_sql(c, 3)}, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
         round(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS iqr,
         count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing FROM lineitem),
    o AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) AS p FROM lineitem),
    v AS (SELECT {c} AS x, count(*) AS k FROM lineitem GROUP BY 1),
    m AS (SELECT CAST(min(x) AS DOUBLE) AS first_mode, count(*) AS n_modes FROM v WHERE k = (SELECT max(k) FROM v))
    SELECT '{c}' AS column_name, q.*, m.*,
      round((SELECT avg(x) FROM o, q WHERE p > floor(0.1 * n) AND p <= n - floor(0.1 * n)), 6) AS trim_mean,
      (SELECT round(quantile_cont(abs({c} - median), 0.5) / 0.6744897501960817, 6) FROM lineitem, q) AS mad,
      '{'int' if c == 'l_linenumber' else 'double'}' AS type FROM q, m)""" for c in NUMBERS))
def data_report_numeric(spark, sf):
    report = profiling.numeric_report(scan(spark, sf, "lineitem").select(*NUMBERS), list(NUMBERS))
    return rounded(report, "trim_mean", "median", "iqr", "mad")


@query("data_report_categorical", " UNION ALL ".join(
    f"""(WITH v AS (SELECT {c} AS value, count(*) AS n FROM part GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS p, sum(n) OVER () AS total FROM v)
    SELECT '{c}' AS column_name, value, n, n / total AS freq FROM o WHERE p <= 20
    UNION ALL SELECT '{c}', '...', CAST(sum(n) AS BIGINT), sum(n) / max(total) FROM o WHERE p > 20 HAVING count(*) > 0)"""
    for c in ("p_brand", "p_type")))
def data_report_categorical(spark, sf):
    return profiling.category_report(scan(spark, sf, "part"), ["p_brand", "p_type"], 20)


@query("expl_analysis", " UNION ALL ".join(
    f"""(WITH v AS (SELECT {c} AS x, count(*) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT '{c}' AS column_name, {moments_sql(c)}, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
    (SELECT count(*) FROM v WHERE k = (SELECT max(k) FROM v)) AS n_modes
    FROM customer JOIN orders ON c_custkey = o_custkey)""" for c in ("c_acctbal", "o_totalprice", "c_nationkey")))
def expl_analysis(spark, sf):
    rows = scan(spark, sf, "customer").join(scan(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    columns = ["c_acctbal", "o_totalprice", "c_nationkey"]
    modes = profiling.modes(rows, columns).groupBy("column_name").agg(F.count("*").alias("n_modes"))
    medians = rounded(profiling.quantile_table(rows, columns, {"median": 0.5}), "median")
    return profiling.moments(rows, columns).join(medians, "column_name").join(modes, "column_name")


@query("all_modes", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS mode, count(*) AS n FROM lineitem GROUP BY {c}
    HAVING count(*) = (SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY {c}) g)"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def all_modes(spark, sf):
    return profiling.modes(scan(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


LABELLED = "SELECT balance, segment, target FROM client WHERE target > -1"


@query("target_rate_bins", f"""
WITH l AS ({LABELLED}), s AS (SELECT min(balance) AS lo, max(balance) AS hi FROM l)
SELECT greatest(CAST(ceil(round((balance - lo) / (hi - lo) * 10, 9)) AS BIGINT), 1) AS bin, count(*) AS n, avg(target) AS target_rate
FROM l, s GROUP BY 1""")
def target_rate_bins(spark, sf):
    return profiling.target_rate(roles.client(spark, sf), "balance")


@query("target_rate_quantiles", f"""
WITH l AS ({LABELLED}), e AS (SELECT DISTINCT unnest(quantile_cont(balance, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM l),
b AS (SELECT l.target, greatest((SELECT count(*) FROM e WHERE e.e < l.balance), 1) AS bin FROM l)
SELECT bin, count(*) AS n, avg(target) AS target_rate FROM b GROUP BY bin""")
def target_rate_quantiles(spark, sf):
    return profiling.target_rate(roles.client(spark, sf), "balance", quantiles=True)


@query("target_rate_category", f"""
SELECT segment, count(*) AS n, avg(target) AS target_rate FROM ({LABELLED}) l GROUP BY segment""")
def target_rate_category(spark, sf):
    return profiling.target_rate(roles.client(spark, sf), "segment")


@query("weighted_freqs", """
SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS count_share,
       round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 9) AS o_totalprice_share
FROM orders GROUP BY 1""")
def weighted_freqs(spark, sf):
    shares = profiling.weighted_freqs(scan(spark, sf, "orders"), "o_orderpriority", ["o_totalprice"])
    return shares.withColumn("o_totalprice_share", F.round("o_totalprice_share", 9))


ACCOUNT_PARTS = ["drawn", "drawn_atm", "drawn_pos", "drawn_other", "balance"]


@query("missing_table", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, 100 * (count(*) - count({c})) / count(*) AS percent FROM account"""
    for c in ACCOUNT_PARTS) + ") m WHERE missing > 0")
def missing_table(spark, sf):
    return profiling.missing_table(roles.account(spark, sf).select(*ACCOUNT_PARTS))


@query("na_profile", "SELECT profile, count(*) AS n FROM (SELECT " + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '◻' ELSE '◼' END" for c in ACCOUNT_PARTS) + " AS profile FROM account) p GROUP BY 1")
def na_profile(spark, sf):
    account = roles.account(spark, sf)
    return account.groupBy(profiling.na_profile(ACCOUNT_PARTS).alias("profile")).agg(F.count("*").alias("n"))


@query("missing_pattern_cube", """
SELECT no_atm, no_pos, no_other, count(*) AS n FROM (
  SELECT drawn_atm IS NULL AS no_atm, drawn_pos IS NULL AS no_pos, drawn_other IS NULL AS no_other FROM account) f
GROUP BY CUBE (no_atm, no_pos, no_other)""")
def missing_pattern_cube(spark, sf):
    flags = {f"no_{k}": F.col(f"drawn_{k}").isNull() for k in ("atm", "pos", "other")}
    return profiling.pattern_cube(roles.account(spark, sf), flags)


@query("constant_groups", """
SELECT loan_id, number, min(due) = max(due) AS constant FROM installment GROUP BY 1, 2""")
def constant_groups(spark, sf):
    return profiling.constant_groups(roles.installment(spark, sf), ["loan_id", "number"], "due")


DESCRIBED = ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("describe_all", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS type, count({c}) AS n, count(DISTINCT {c}) AS n_unique,
    round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM orders"""
    for c, k in (("o_orderkey", "bigint"), ("o_totalprice", "double"))) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', 'string', (SELECT count({c}) FROM orders), (SELECT count(DISTINCT {c}) FROM orders), NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, top, n FROM (SELECT {c} AS top, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, top DESC LIMIT 1) t{c}"""
    for c in DESCRIBED[2:]))
def describe_all(spark, sf):
    return rounded(profiling.describe_all(scan(spark, sf, "orders").select(*DESCRIBED)), "q25", "q50", "q75")


@query("with_total_row", """
SELECT region_key, sum(n) AS n, sum(target_1) AS target_1 FROM (
  SELECT CAST(region_key AS VARCHAR) AS region_key, count(*) AS n, count(*) FILTER (target = 1) AS target_1 FROM client GROUP BY 1
  UNION ALL SELECT 'total', count(*), count(*) FILTER (target = 1) FROM client) u GROUP BY 1""".replace("sum(n)", "CAST(sum(n) AS BIGINT)").replace(
    "sum(target_1)", "CAST(sum(target_1) AS BIGINT)"))
def with_total_row(spark, sf):
    grouped = roles.client(spark, sf).groupBy(F.col("region_key").cast("string").alias("region_key")).agg(
        F.count("*").alias("n"), F.count_if(F.col("target") == 1).alias("target_1")
    )
    return profiling.with_total(grouped, "region_key", ["n", "target_1"])


@query("distinct_values", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, value, row_number() OVER (ORDER BY value) AS place FROM (SELECT DISTINCT {c} AS value FROM part) v"
    for c in ("p_brand", "p_type")))
def distinct_values(spark, sf):
    return profiling.distinct_values(scan(spark, sf, "part"), ["p_brand", "p_type"])


@query("label_medians", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(corr({c}, target), 9) AS corr, round(quantile_cont({c}, 0.5) FILTER (target = 0), 6) AS median_0,
    round(quantile_cont({c}, 0.5) FILTER (target = 1), 6) AS median_1 FROM (SELECT balance, CAST(region_key AS DOUBLE) AS region_key, target FROM client WHERE target > -1) l"""
    for c in ("balance", "region_key")))
def label_medians(spark, sf):
    rows = roles.client(spark, sf).filter("target > -1")
    return profiling.label_summary(rows, ["balance", "region_key"], "target").transform(
        rounded, "median_0", "median_1"
    ).withColumn("corr", F.round("corr", 9))


@query("label_of_missing", """
WITH t AS (SELECT a.drawn_atm, c.target FROM account a JOIN client c ON a.client_id = c.client_id WHERE c.target > -1),
g AS (SELECT target, count(*) FILTER (drawn_atm IS NULL) AS missing_rows, count(*) AS all_rows FROM t GROUP BY target)
SELECT target, missing_rows, all_rows, missing_rows / sum(missing_rows) OVER () AS missing_share, all_rows / sum(all_rows) OVER () AS all_share FROM g""")
def label_of_missing(spark, sf):
    rows = roles.account(spark, sf).join(roles.client(spark, sf), "client_id")
    return profiling.label_of_missing(rows, "drawn_atm", "target")
