"""Scans, slices, sinks, and the data dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.ordering import HASH_MODULUS, spread_sql
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.session import scratch_path
from featmart.sources import sinks, slices
from featmart.sources.tables import (
    TABLES, data_dictionary, default_loaders, filter_by_values, main_map, register_tables, scan, scan_checked,
    target_map, union_labelled,
)

# The columns of the given tables.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
                "l_tax l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
}


def filled_sql(names=COLUMNS) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS filled FROM {t}"
        for t in names for c in COLUMNS[t].split()
    )


def filled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Non-null count of every column of every table, one pass per table."""
    parts = [
        df.agg(*[F.count(c).alias(c) for c in df.columns])
        .unpivot([], df.columns, "column_name", "filled")
        .select(F.lit(name).alias("table_name"), "column_name", "filled")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def star(spark, sf):
    return {name: scan(spark, sf, name) for name in COLUMNS}


@query("scan_table", "SELECT * FROM lineitem")
def scan_table(spark, sf):
    return scan(spark, sf, "lineitem")


@query("union_labeled", "SELECT client_id, target, segment, region_key, balance FROM client")
def union_labeled(spark, sf):
    client = roles.client(spark, sf)
    return union_labelled(client.filter("target > -1"), client.filter("target = -1").drop("target"))


@query("registry_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def registry_counts(spark, sf):
    tables = register_tables(spark, default_loaders(spark, sf))
    parts = [spark.table(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name in tables]
    return reduce(DataFrame.unionByName, parts)


@query("target_map", "SELECT client_id, target FROM client")
def target_map_(spark, sf):
    return target_map(roles.client(spark, sf))


@query("main_map", """
SELECT e.client_id, e.loan_id AS external_id, p.loan_id AS previous_id, c.target
FROM loan_map e JOIN loan p ON e.client_id = p.client_id JOIN client c ON e.client_id = c.client_id""")
def main_map_(spark, sf):
    return main_map(
        roles.client(spark, sf).select("client_id", "target"),
        roles.loan_map(spark, sf).withColumnRenamed("loan_id", "external_id"),
        roles.loan(spark, sf).select("client_id", F.col("loan_id").alias("previous_id")),
    )


@query("data_dictionary", f"""
SELECT CASE WHEN table_name = 'customer' THEN 'application' ELSE table_name END AS table_name,
       column_name, filled FROM ({filled_sql()}) f""")
def data_dictionary_(spark, sf):
    tables = star(spark, sf)
    alias = {"customer": "application"}
    counts = filled_counts(tables).replace(alias, subset=["table_name"])
    return data_dictionary(tables, alias).join(counts, ["table_name", "column_name"]).drop("type")


@query("dictionary_lookup", f"""
SELECT table_name, column_name, filled FROM ({filled_sql()}) f
WHERE regexp_matches(table_name, '^(orders|lineitem)$') AND regexp_matches(column_name, 'key$')""")
def dictionary_lookup(spark, sf):
    counts = filled_counts({t: df for t, df in star(spark, sf).items()})
    return counts.filter(F.col("table_name").rlike("^(orders|lineitem)$") & F.col("column_name").rlike("key$"))


@query("undocumented_columns", f"""
WITH stats AS ({filled_sql(["orders"])}),
docs AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_comment', 'o_clerk']) AS column_name)
SELECT s.column_name, 'undocumented' AS kind, s.filled FROM stats s
WHERE s.column_name NOT IN (SELECT column_name FROM docs)
UNION ALL
SELECT d.column_name, 'phantom' AS kind, CAST(0 AS BIGINT) AS filled FROM docs d
WHERE d.column_name NOT IN (SELECT column_name FROM stats)""")
def undocumented_columns(spark, sf):
    stats = filled_counts({"orders": scan(spark, sf, "orders")})
    documented = ["o_orderkey", "o_custkey", "o_totalprice", "o_comment", "o_clerk"]
    docs = spark.createDataFrame([(c,) for c in documented], "column_name string")
    missing = stats.join(docs, "column_name", "left_anti").select(
        "column_name", F.lit("undocumented").alias("kind"), "filled"
    )
    phantom = docs.join(stats, "column_name", "left_anti").select(
        "column_name", F.lit("phantom").alias("kind"), F.lit(0).cast("long").alias("filled")
    )
    return missing.unionByName(phantom)


@query("parquet_roundtrip", "SELECT * FROM orders")
def parquet_roundtrip(spark, sf):
    paths = sinks.convert_tables({"orders": scan(spark, sf, "orders")}, scratch_path(spark, "tables"), "zstd")
    return spark.read.parquet(paths["orders"])


@query("mart_roundtrip", """
SELECT c.client_id, c.target, count(l.loan_id) AS n_loans
FROM client c LEFT JOIN loan l ON c.client_id = l.client_id GROUP BY 1, 2""")
def mart_roundtrip(spark, sf):
    counts = roles.loan(spark, sf).groupBy("client_id").agg(F.count("*").alias("n_loans"))
    mart = roles.client(spark, sf).select("client_id", "target").join(counts, "client_id", "left").fillna(0)
    folder = scratch_path(spark, "mart")
    sinks.save_mart(mart, folder, "v1")
    return sinks.load_mart(spark, folder, "v1")


@query("submission_csv", "SELECT client_id, score FROM scored")
def submission_csv(spark, sf):
    path = sinks.save_submission(roles.scored(spark, sf), scratch_path(spark, "submission"), "client_id", "score")
    return spark.read.schema("client_id bigint, score double").option("header", True).csv(path)


@query("damaged_rows", """
SELECT 'good' AS part, o_orderkey AS orderkey, round(o_totalprice, 2) AS price, NULL AS line FROM orders WHERE o_orderkey % 50 NOT IN (0, 1)
UNION ALL
SELECT 'damaged', NULL, NULL, CASE o_orderkey % 50 WHEN 0 THEN o_orderkey || ',n/a' ELSE o_orderkey || ',1,2' END FROM orders WHERE o_orderkey % 50 IN (0, 1)""")
def damaged_rows(spark, sf):
    """Orders as CSV, some with a price that is no number and some with a value too many."""
    path = scratch_path(spark, "damaged")
    key = F.col("o_orderkey")
    price = F.when(key % 50 == 0, "n/a").when(key % 50 == 1, "1,2").otherwise(F.round("o_totalprice", 2).cast("string"))
    scan(spark, sf, "orders").select(F.concat_ws(",", key, price).alias("value")).write.text(f"{path}/orders.csv")
    good, damaged = scan_checked(spark, path, "orders", "orderkey bigint, price double", header=False)
    return good.select(F.lit("good").alias("part"), "orderkey", "price", F.lit(None).cast("string").alias("line")).unionByName(
        damaged.select(F.lit("damaged").alias("part"), F.lit(None).cast("bigint").alias("orderkey"), F.lit(None).cast("double").alias("price"), "line")
    )


@query("materialized_reuse", """
SELECT loan_id, round(sum(due), 2) AS due FROM installment GROUP BY loan_id""")
def materialized_reuse(spark, sf):
    def build():
        return roles.installment(spark, sf).groupBy("loan_id").agg(F.round(F.sum("due"), 2).alias("due"))

    root = scratch_path(spark, "materialized")
    params = {"decimals": 2, "source": sf}
    sinks.materialized(spark, "loan_due", params, build, root=root)
    return sinks.materialized(spark, "loan_due", dict(reversed(params.items())), build, root=root)


@query("filter_by_keys", """
SELECT loan_id, client_id, status, amount FROM loan
WHERE status IN ('F', 'P') AND client_id IN (SELECT client_id FROM client WHERE target = 1)""")
def filter_by_keys(spark, sf):
    defaulted = roles.client(spark, sf).filter("target = 1").select("client_id")
    loans = roles.loan(spark, sf).select("loan_id", "client_id", "status", "amount")
    return filter_by_values(loans, {"status": ["F", "P"], "client_id": defaulted})


@query("sampled_parent_child", f"""
SELECT l.loan_id, l.client_id, l.amount FROM loan l
WHERE {spread_sql('l.client_id', 11)} < {int(0.3 * HASH_MODULUS)}
  AND l.client_id IN (SELECT client_id FROM client)""")
def sampled_parent_child(spark, sf):
    parents = slices.sample_by_key(roles.client(spark, sf), "client_id", 0.3, seed=11)
    return slices.restrict_to_parents(
        roles.loan(spark, sf).select("loan_id", "client_id", "amount"), parents, "client_id"
    )


@query("page_rows", """
(SELECT o_orderkey, o_custkey, 'first' AS page FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100)
UNION ALL
(SELECT o_orderkey, o_custkey, 'last' AS page FROM orders ORDER BY o_orderkey DESC LIMIT 25)""")
def page_rows(spark, sf):
    orders = scan(spark, sf, "orders").select("o_orderkey", "o_custkey")
    first = slices.row_range(orders, [F.col("o_orderkey")], 100, 150).withColumn("page", F.lit("first"))
    last = slices.row_range(orders, [F.col("o_orderkey")], -25).withColumn("page", F.lit("last"))
    return first.unionByName(last)


@query("client_slice", """
SELECT m.loan_id, m.month, m.status, x.client_id FROM monthly m JOIN loan_map x ON m.loan_id = x.loan_id
WHERE x.client_id = 7""")
def client_slice_(spark, sf):
    series = roles.monthly(spark, sf).drop("client_id")
    return slices.client_slice(series, 7, via=roles.loan_map(spark, sf), on="loan_id")


@query("client_slice_by_key", "SELECT client_id, loan_id, number, due FROM installment WHERE client_id = (SELECT min(client_id) FROM loan)")
def client_slice_by_key(spark, sf):
    rows = roles.installment(spark, sf).select("client_id", "loan_id", "number", "due")
    path = sinks.save_by_key(rows, scratch_path(spark, "by-key"), "client_id", "loan_id")
    first = roles.loan(spark, sf).agg(F.min("client_id")).first()[0]
    return slices.client_slice(spark.read.parquet(path), first)


@query("rows_as_json", """
SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderpriority":"'
       || o_orderpriority || '"}' AS row_json FROM orders""")
def rows_as_json_(spark, sf):
    return sinks.rows_as_json(scan(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))


@query("json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_fields(spark, sf):
    return scan(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
