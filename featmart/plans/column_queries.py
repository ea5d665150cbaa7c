"""Projections, predicates, naming, encodings and column pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions import scalars
from featmart.operators import columns as cols
from featmart.operators import profiling
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.sources.tables import scan


@query("datablock_regex", "SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem")
def datablock_regex(spark, sf):
    return cols.datablock(scan(spark, sf, "lineitem"), r"l_(orderkey|ext|disc)")


@query("labeled_datablock", """
SELECT c.target, o.o_orderkey, o.o_orderstatus, o.o_orderpriority
FROM orders o LEFT JOIN client c ON o.o_custkey = c.client_id""")
def labeled_datablock(spark, sf):
    labels = roles.client(spark, sf).select(F.col("client_id").alias("o_custkey"), "target")
    joined = scan(spark, sf, "orders").join(labels, "o_custkey", "left")
    return cols.datablock(joined, r"o_order(key|status|priority)", keep=["target"])


# A small group configuration: nested groups, an interleaved pair, and short names.
LINE_GROUPS = cols.ColumnGroups(
    {
        "key": ["l_orderkey", "l_linenumber"],
        "amounts": ["l_extendedprice", "l_tax"],
        "rates": ["l_quantity", "l_discount"],
        "core": ["key", ["amounts", "rates"]],
    },
    {"l_orderkey": "oid", ("l_{i}key", ("part", "supp")): "{i}_id", "l_linenumber": "num"},
)


@query("column_group", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax, l_discount FROM lineitem""")
def column_group(spark, sf):
    return LINE_GROUPS.select(scan(spark, sf, "lineitem"), "core")


@query("renamed_columns", """
SELECT l_orderkey AS oid, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS num FROM lineitem""")
def renamed_columns(spark, sf):
    lines = scan(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return LINE_GROUPS.rename(lines)


@query("categorical_vars", """
SELECT * FROM (
  SELECT 'p_name' AS column_name, count(DISTINCT p_name) AS n_unique FROM part UNION ALL
  SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL
  SELECT 'p_type', count(DISTINCT p_type) FROM part) v WHERE n_unique <= 25""")
def categorical_vars(spark, sf):
    return cols.categorical_columns(scan(spark, sf, "part"), kind="string", max_modalities=25)


@query("feature_roles", """
SELECT column_name, n_unique,
       CASE WHEN n_unique = n THEN 'key' WHEN n_unique <= 50 THEN 'categorical' ELSE 'numeric' END AS role
FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) AS n FROM part"
    for c in "p_partkey p_name p_brand p_type p_size p_retailprice".split()) + ") r")
def feature_roles(spark, sf):
    return cols.feature_roles(scan(spark, sf, "part"), 50)


@query("derived_ratios", """
SELECT client_id, loan_id, number, version, due_day, paid_day,
       paid / nullif(due, 0) AS payment_perc, due - paid AS payment_diff,
       CASE WHEN due_day - paid_day > 0 THEN due_day - paid_day ELSE 0 END AS dpd,
       CASE WHEN paid_day - due_day > 0 THEN paid_day - due_day ELSE 0 END AS dbd
FROM installment""")
def derived_ratios(spark, sf):
    return cols.derive(
        roles.installment(spark, sf),
        """
        payment_perc = try_divide(paid, due)      # share paid
        payment_diff = due - paid                 # left to pay
        dpd = @where(due_day - paid_day > 0, due_day - paid_day, 0L)
        dbd = @where(paid_day - due_day > 0, paid_day - due_day, 0L)
        """,
    ).drop("due", "paid")


@query("safe_names", """
SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS total_price_2,
       o_orderpriority AS priority FROM orders""")
def safe_names(spark, sf):
    raw = ["order key", "total: price", "total/price", "(priority)"]
    orders = scan(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return orders.toDF(*cols.safe_names(raw))


@query("drop_flagged_rows", """
SELECT loan_id, last_flag, day_flag FROM (
  SELECT loan_id, CASE WHEN status = 'F' THEN 'N' WHEN status = 'O' THEN 'Y' END AS last_flag,
         CASE WHEN priority = '5-LOW' THEN 0 WHEN priority <> '1-URGENT' THEN 1 END AS day_flag FROM loan) f
WHERE NOT (coalesce(last_flag = 'N', false) OR coalesce(day_flag = 0, false))""")
def drop_flagged_rows(spark, sf):
    flagged = roles.loan(spark, sf).select(
        "loan_id",
        F.when(F.col("status") == "F", "N").when(F.col("status") == "O", "Y").alias("last_flag"),
        F.when(F.col("priority") == "5-LOW", 0).when(F.col("priority") != "1-URGENT", 1).alias("day_flag"),
    )
    return cols.drop_flagged(flagged, "last_flag", "day_flag")


@query("drop_category", "SELECT client_id, segment FROM sentinel WHERE segment <> 'XNA'")
def drop_category(spark, sf):
    return cols.drop_category(roles.sentinel(spark, sf).select("client_id", "segment"), "segment", "XNA")


@query("align_columns", """
SELECT client_id, segment, balance FROM client WHERE target > -1
UNION ALL SELECT client_id, segment, balance FROM client WHERE target = -1""")
def align_columns(spark, sf):
    client = roles.client(spark, sf)
    train = client.filter("target > -1").drop("region_key")
    test = client.filter("target = -1").drop("target")
    left, right = cols.align_columns(train, test)
    return left.unionByName(right)


@query("align_rows", """
SELECT s.client_id, s.score, c.segment, c.balance FROM scored s JOIN client c ON s.client_id = c.client_id""")
def align_rows(spark, sf):
    reference = roles.scored(spark, sf).select("client_id", "score")
    table = roles.client(spark, sf).select("client_id", "segment", "balance")
    return cols.align_rows(table, reference, "client_id", position="score")


@query("composite_key", """
SELECT l_orderkey || '-' || l_linenumber AS line_key, l_quantity FROM lineitem""")
def composite_key(spark, sf):
    keyed = cols.composite_key(scan(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "line_key")
    return keyed.select("line_key", "l_quantity")


@query("name_words", """
SELECT p_partkey, p_name, """ + ", ".join(
    f"nullif(split_part(p_name, ' ', {i + 1}), '') AS word_{i}" for i in range(5)) + " FROM part")
def name_words(spark, sf):
    return cols.name_words(scan(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 5, " ")


@query("account_view", """
SELECT loan_id AS pid, month AS m, balance AS bal, drawn AS drw, payment AS pyt
FROM account WHERE loan_id = (SELECT min(loan_id) FROM account)""")
def account_view(spark, sf):
    account = roles.account(spark, sf)
    first = account.agg(F.min("loan_id").alias("loan_id"))
    return (
        account.join(F.broadcast(first), "loan_id", "left_semi")
        .select(
            F.col("loan_id").alias("pid"), F.col("month").alias("m"), F.col("balance").alias("bal"),
            F.col("drawn").alias("drw"), F.col("payment").alias("pyt"),
        )
        .orderBy("m")
    )


@query("applicant_profile", """
SELECT c.client_id, c.segment, round(l.first_day / 365.243, 6) AS years_known,
       round(l.total / nullif(c.balance, 0), 6) AS debt_ratio,
       ceil((l.first_day - l.last_day) / 30.436875) AS term_months,
       CASE WHEN c.balance > 0 THEN '✓' ELSE '✗' END AS in_credit,
       CASE WHEN l.open_loans > 0 THEN '✓' ELSE '✗' END AS has_open
FROM client c LEFT JOIN (
  SELECT client_id, max(loan_day) AS first_day, min(loan_day) AS last_day, sum(amount) AS total,
         count(CASE WHEN status = 'O' THEN 1 END) AS open_loans
  FROM loan GROUP BY client_id) l ON c.client_id = l.client_id""")
def applicant_profile(spark, sf):
    history = roles.loan(spark, sf).groupBy("client_id").agg(
        F.max("loan_day").alias("first_day"),
        F.min("loan_day").alias("last_day"),
        F.sum("amount").alias("total"),
        F.count_if(F.col("status") == "O").alias("open_loans"),
    )
    joined = roles.client(spark, sf).join(history, "client_id", "left")
    return joined.select(
        "client_id",
        "segment",
        F.round(scalars.years_of_days("first_day"), 6).alias("years_known"),
        F.round(scalars.ratio("total", "balance"), 6).alias("debt_ratio"),
        scalars.month_of_days(F.col("first_day") - F.col("last_day"), "up").cast("double").alias("term_months"),
        scalars.flag_symbol(F.col("balance") > 0).alias("in_credit"),
        scalars.flag_symbol(F.col("open_loans") > 0).alias("has_open"),
    )


@query("one_hot", """
SELECT doc_id, """ + ", ".join(
    f"CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS lang_{v}" for v in ("de", "en", "es", "fr")) + """,
       CASE WHEN quality = 0 THEN 1 ELSE 0 END AS quality_0,
       CASE WHEN quality = 1 THEN 1 ELSE 0 END AS quality_1,
       CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS quality_nan
FROM labelled_docs""")
def one_hot(spark, sf):
    docs = roles.labelled_docs(spark, sf).select("doc_id", "lang", "quality")
    return cols.one_hot(docs, ["lang", "quality"])


@query("factorize_codes", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code, t.type_code
FROM part JOIN (
  SELECT p_type, row_number() OVER (ORDER BY first_key) - 1 AS type_code
  FROM (SELECT p_type, min(p_partkey) AS first_key FROM part GROUP BY p_type) f) t USING (p_type)""")
def factorize_codes(spark, sf):
    part = scan(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    sorted_codes = cols.factorize(part, "p_brand", "brand_code")
    return cols.factorize(sorted_codes, "p_type", "type_code", first_seen="p_partkey").select(
        "p_partkey", "brand_code", "type_code"
    )


@query("compact_types", """
SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(quality AS BOOLEAN) AS quality,
       CAST(toxic AS BOOLEAN) AS toxic FROM labelled_docs""")
def compact_types(spark, sf):
    docs = roles.labelled_docs(spark, sf).select("doc_id", "n_chars", "quality", "toxic")
    return cols.compact_types(docs, keys=["doc_id"])


@query("drop_sparse_columns", """
SELECT doc_id, lang, n_chars FROM labelled_docs WHERE source = (SELECT min(source) FROM documents)
UNION ALL
SELECT doc_id, lang, n_chars FROM labelled_docs WHERE source <> (SELECT min(source) FROM documents)""")
def drop_sparse_columns(spark, sf):
    docs = roles.labelled_docs(spark, sf)
    first = scan(spark, sf, "documents").agg(F.min("source").alias("source"))
    left, right = cols.drop_sparse(
        docs.join(F.broadcast(first), "source", "left_semi"), docs.join(F.broadcast(first), "source", "left_anti"), 50
    )
    return left.unionByName(right).select("doc_id", "lang", "n_chars")


@query("drop_collinear", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def drop_collinear(spark, sf):
    lines = scan(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    ).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return cols.drop_collinear(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"])


@query("drop_duplicate_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem""")
def drop_duplicate_columns(spark, sf):
    lines = scan(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.col("l_quantity").alias("qty_copy"), "l_discount", (F.col("l_quantity") * 1.0).alias("qty_again"),
    )
    return cols.drop_duplicate_columns(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("polynomial_features", """
SELECT client_id, 1.0::DOUBLE AS one, bal, reg, tgt, bal * bal AS bal_x_bal, bal * reg AS bal_x_reg, bal * tgt AS bal_x_tgt,
       reg * reg AS reg_x_reg, reg * tgt AS reg_x_tgt, tgt * tgt AS tgt_x_tgt,
       bal * bal * bal AS bal_x_bal_x_bal, bal * bal * reg AS bal_x_bal_x_reg, bal * bal * tgt AS bal_x_bal_x_tgt,
       bal * reg * reg AS bal_x_reg_x_reg, bal * reg * tgt AS bal_x_reg_x_tgt, bal * tgt * tgt AS bal_x_tgt_x_tgt,
       reg * reg * reg AS reg_x_reg_x_reg, reg * reg * tgt AS reg_x_reg_x_tgt, reg * tgt * tgt AS reg_x_tgt_x_tgt,
       tgt * tgt * tgt AS tgt_x_tgt_x_tgt
FROM (SELECT client_id, balance / 1000.0 AS bal, CAST(region_key AS DOUBLE) AS reg, CAST(target AS DOUBLE) AS tgt FROM client) c""")
def polynomial_features(spark, sf):
    client = roles.client(spark, sf).select(
        "client_id", (F.col("balance") / 1000.0).alias("bal"),
        F.col("region_key").cast("double").alias("reg"), F.col("target").cast("double").alias("tgt"),
    )
    return cols.polynomial_features(client, ["bal", "reg", "tgt"], 3)


@query("string_functions", """
SELECT p_partkey, regexp_matches(p_name, '^s') AS starts_s, contains(p_name, 'ring') AS has_ring,
       starts_with(p_brand, 'Brand#1') AS brand_1x, ends_with(p_name, 't') AS ends_t,
       regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_digits, replace(p_type, 'ECONOMY', 'ECO') AS short_type,
       lower(p_type) AS type_lower, trim('  ' || p_type || ' ') AS type_trimmed,
       split_part(p_name, ' ', 2) AS second_word, left(p_name, length(p_name) - 4) AS without_last4,
       p_brand || '/' || p_type AS brand_type
FROM part""")
def string_functions(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return scan(spark, sf, "part").select(
        "p_partkey",
        name.rlike("^s").alias("starts_s"),
        name.contains("ring").alias("has_ring"),
        brand.startswith("Brand#1").alias("brand_1x"),
        name.endswith("t").alias("ends_t"),
        F.regexp_replace(brand, "[^0-9]", "").alias("brand_digits"),
        F.replace(kind, F.lit("ECONOMY"), F.lit("ECO")).alias("short_type"),
        F.lower(kind).alias("type_lower"),
        F.trim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("type_trimmed"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
        F.expr("left(p_name, length(p_name) - 4)").alias("without_last4"),
        F.concat_ws("/", brand, kind).alias("brand_type"),
    )


@query("math_functions", """
SELECT l_orderkey, l_linenumber, l_partkey, round(exp(l_discount), 9) AS e, round(ln(l_extendedprice), 9) AS l,
       round(l_extendedprice / 7, 3) AS r, CAST(floor(-l_quantity / 4) AS BIGINT) AS fd,
       l_extendedprice % 1 AS frac, abs(-l_tax) AS a, -l_quantity AS neg, sign(l_discount - 0.05) AS s
FROM lineitem""")
def math_functions(spark, sf):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return scan(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.exp("l_discount"), 9).alias("e"),
        F.round(F.ln(price), 9).alias("l"),
        F.round(price / 7, 3).alias("r"),
        F.floor(-quantity / 4).alias("fd"),
        F.pmod(price, F.lit(1.0)).alias("frac"),
        F.abs(-F.col("l_tax")).alias("a"),
        (-quantity).alias("neg"),
        F.signum(F.col("l_discount") - 0.05).cast("tinyint").alias("s"),
    )


@query("date_functions", """
SELECT o_orderkey, isodow(o_orderdate) - 1 AS weekday,
       CAST(o_orderdate AS DATE) + to_hours(o_orderkey % 24) AS stamped,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') / 365.243 AS years,
       CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') / 30.436875) AS BIGINT) AS months
FROM orders""")
def date_functions(spark, sf):
    days = roles.days_before(roles.LEDGER_DATE, "o_orderdate")
    return scan(spark, sf, "orders").select(
        "o_orderkey",
        F.weekday("o_orderdate").cast("long").alias("weekday"),
        scalars.timestamp_of("o_orderdate", F.col("o_orderkey") % 24).cast("timestamp_ntz").alias("stamped"),
        scalars.years_of_days(days).alias("years"),
        scalars.month_of_days(days).alias("months"),
    )


@query("equal_width_bins", """
SELECT c_custkey, greatest(CAST(ceil(round((c_acctbal - lo) / (hi - lo) * 10, 9)) AS BIGINT), 1) AS bin
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) s""")
def equal_width_bins(spark, sf):
    clients = scan(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return cols.equal_width_bins(clients, "c_acctbal", 10, decimals=9).drop("c_acctbal")


@query("quantile_bins", """
SELECT c.c_custkey, (SELECT count(*) FROM (
    SELECT DISTINCT unnest(quantile_cont(c_acctbal, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM customer) q
  WHERE q.e < c.c_acctbal OR (q.e = c.c_acctbal AND q.e = (SELECT min(c_acctbal) FROM customer))) AS bin
FROM customer c""")
def quantile_bins(spark, sf):
    return profiling.quantile_bins(scan(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).drop("c_acctbal")
