"""Key propagation, key sets, relations, set operations, and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.operators import cleaning, compare, keys
from featmart.plans import roles
from featmart.plans.registry import query
from featmart.sources.tables import scan


def bare_series(spark, sf):
    return roles.monthly(spark, sf).select("loan_id", "month", "status")


@query("attach_client", """
SELECT m.loan_id, m.month, m.status, x.client_id FROM monthly m JOIN loan_map x ON m.loan_id = x.loan_id""")
def attach_client(spark, sf):
    return keys.attach_client(bare_series(spark, sf), roles.loan_map(spark, sf))


@query("attach_target", """
SELECT l.loan_id, l.client_id, coalesce(c.target, -1) AS target
FROM loan l LEFT JOIN (SELECT client_id, target FROM client WHERE target > -1) c ON l.client_id = c.client_id""")
def attach_target(spark, sf):
    known = roles.client(spark, sf).filter("target > -1")
    return keys.attach_target(roles.loan(spark, sf).select("loan_id", "client_id"), known)


@query("attach_all", """
SELECT m.loan_id, m.month, m.status, x.client_id, coalesce(c.target, -1) AS target
FROM monthly m JOIN loan_map x ON m.loan_id = x.loan_id LEFT JOIN client c ON x.client_id = c.client_id""")
def attach_all(spark, sf):
    return keys.attach_all(bare_series(spark, sf), roles.loan_map(spark, sf), roles.client(spark, sf))


@query("extended_loans", """
WITH risk AS (SELECT loan_id, count(*) AS n_months FROM monthly GROUP BY loan_id),
closed AS (SELECT loan_id, count(*) AS n_closed FROM monthly WHERE status = 'C' GROUP BY loan_id)
SELECT x.loan_id, x.client_id, n_months, n_closed
FROM loan_map x LEFT JOIN risk ON x.loan_id = risk.loan_id LEFT JOIN closed ON x.loan_id = closed.loan_id""")
def extended_loans(spark, sf):
    series = roles.monthly(spark, sf)
    months = series.groupBy("loan_id").agg(F.count("*").alias("n_months"))
    closed = series.filter("status = 'C'").groupBy("loan_id").agg(F.count("*").alias("n_closed"))
    return keys.join_parts(roles.loan_map(spark, sf), [months, None, closed], "loan_id")


@query("key_overlap", """
WITH a AS (SELECT DISTINCT loan_id FROM monthly), b AS (SELECT DISTINCT o_orderkey AS loan_id FROM orders)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
       (SELECT count(*) FROM a WHERE loan_id NOT IN (SELECT loan_id FROM b)) AS a_only,
       (SELECT count(*) FROM b WHERE loan_id NOT IN (SELECT loan_id FROM a)) AS b_only""")
def key_overlap(spark, sf):
    return keys.key_overlap(roles.monthly(spark, sf), roles.loan(spark, sf), "loan_id")


def client_tables(spark, sf):
    return {
        "application": roles.client(spark, sf).filter("balance > 0"),
        "external": roles.monthly(spark, sf),
        "previous": roles.loan(spark, sf).filter("status = 'P'"),
        "paid": roles.installment(spark, sf),
    }


CLIENT_KEYS = """k AS (
  SELECT client_id, max(application) AS application, max(external) AS external, max(previous) AS previous, max(paid) AS paid FROM (
    SELECT client_id, 1 AS application, 0 AS external, 0 AS previous, 0 AS paid FROM client WHERE balance > 0
    UNION ALL SELECT client_id, 0, 1, 0, 0 FROM monthly
    UNION ALL SELECT client_id, 0, 0, 1, 0 FROM loan WHERE status = 'P'
    UNION ALL SELECT client_id, 0, 0, 0, 1 FROM installment) u GROUP BY client_id)"""


@query("key_overlap_matrix", f"WITH {CLIENT_KEYS} " + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 0) AS only_a,
    count(*) FILTER ({a} = 1 AND {b} = 0) / nullif(count(*) FILTER ({a} = 1 OR {b} = 1), 0) AS share,
    count(*) FILTER ({a} = 1 AND {b} = 1) AS "both", count(*) FILTER ({a} = 1 OR {b} = 1) AS either FROM k"""
    for a in ("application", "external", "previous", "paid") for b in ("application", "external", "previous", "paid")))
def key_overlap_matrix(spark, sf):
    return keys.key_overlap_matrix(client_tables(spark, sf), "client_id")


@query("membership_flags", """
SELECT client_id, client_id IN (SELECT client_id FROM monthly) AS in_external,
       client_id IN (SELECT client_id FROM loan WHERE status = 'P') AS in_previous,
       client_id IN (SELECT client_id FROM installment WHERE paid IS NULL) AS in_unpaid FROM client""")
def membership_flags(spark, sf):
    return keys.membership_flags(
        roles.client(spark, sf).select("client_id"),
        {
            "in_external": roles.monthly(spark, sf),
            "in_previous": roles.loan(spark, sf).filter("status = 'P'"),
            "in_unpaid": roles.installment(spark, sf).filter("paid IS NULL"),
        },
        "client_id",
    )


@query("relation_arity", """
WITH a AS (SELECT client_id, count(*) AS n FROM client WHERE target = 1 GROUP BY 1),
b AS (SELECT client_id, count(*) AS n FROM loan GROUP BY 1),
f AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.client_id = b.client_id),
s AS (SELECT min(na) FILTER (nb > 0) AS a_min, max(na) FILTER (nb > 0) AS a_max,
             min(nb) FILTER (na > 0) AS b_min, max(nb) FILTER (na > 0) AS b_max FROM f)
SELECT *, '[A](' || a_min || '..' || a_max || ')--(' || b_min || '..' || b_max || ')[B]' AS arity FROM s""")
def relation_arity(spark, sf):
    return keys.relation_arity(roles.client(spark, sf).filter("target = 1"), roles.loan(spark, sf), "client_id")


@query("outer_merge", """
SELECT coalesce(a.client_id, b.client_id) AS client_id, a.n_external, b.n_open FROM
  (SELECT client_id, count(*) AS n_external FROM monthly GROUP BY 1) a FULL JOIN
  (SELECT client_id, count(*) AS n_open FROM loan WHERE status = 'O' GROUP BY 1) b ON a.client_id = b.client_id""")
def outer_merge(spark, sf):
    a = roles.monthly(spark, sf).groupBy("client_id").agg(F.count("*").alias("n_external"))
    b = roles.loan(spark, sf).filter("status = 'O'").groupBy("client_id").agg(F.count("*").alias("n_open"))
    return a.join(b, "client_id", "full_outer")


SEVERAL = """SELECT loan_id, number FROM installment GROUP BY loan_id, number HAVING count(*) > 1"""


def several(spark, sf):
    return keys.duplicate_keys(roles.installment(spark, sf), ["loan_id", "number"])


@query("semi_composite", f"""
SELECT i.loan_id, i.number, i.version, i.due FROM installment i WHERE (i.loan_id, i.number) IN ({SEVERAL})""")
def semi_composite(spark, sf):
    rows = roles.installment(spark, sf).select("loan_id", "number", "version", "due")
    return rows.join(several(spark, sf), ["loan_id", "number"], "left_semi")


@query("anti_composite", f"""
SELECT i.loan_id, i.number, i.version, i.due FROM installment i WHERE (i.loan_id, i.number) NOT IN ({SEVERAL})""")
def anti_composite(spark, sf):
    rows = roles.installment(spark, sf).select("loan_id", "number", "version", "due")
    return rows.join(several(spark, sf), ["loan_id", "number"], "left_anti")


@query("distinct_pairs", "SELECT DISTINCT client_id, loan_id FROM monthly")
def distinct_pairs(spark, sf):
    return roles.monthly(spark, sf).select("client_id", "loan_id").distinct()


@query("except_keys", "SELECT client_id FROM client EXCEPT SELECT client_id FROM loan")
def except_keys(spark, sf):
    return roles.client(spark, sf).select("client_id").join(roles.loan(spark, sf), "client_id", "left_anti").distinct()


@query("union_keys", "SELECT count(*) AS n FROM (SELECT client_id FROM client UNION SELECT loan_id FROM monthly) u")
def union_keys(spark, sf):
    a = roles.client(spark, sf).select("client_id")
    b = roles.monthly(spark, sf).select(F.col("loan_id").alias("client_id"))
    return a.union(b).distinct().agg(F.count("*").alias("n"))


@query("intersect_keys", "SELECT client_id FROM loan INTERSECT SELECT client_id FROM monthly")
def intersect_keys(spark, sf):
    return roles.loan(spark, sf).select("client_id").intersect(roles.monthly(spark, sf).select("client_id"))


@query("concat_columns", """
SELECT coalesce(a.client_id, b.client_id) AS client_id, a.amount, b.due FROM
  (SELECT client_id, round(sum(amount), 2) AS amount FROM loan GROUP BY 1) a FULL JOIN
  (SELECT client_id, round(sum(due), 2) AS due FROM installment GROUP BY 1) b ON a.client_id = b.client_id""")
def concat_columns(spark, sf):
    a = roles.loan(spark, sf).groupBy("client_id").agg(F.round(F.sum("amount"), 2).alias("amount"))
    b = roles.installment(spark, sf).groupBy("client_id").agg(F.round(F.sum("due"), 2).alias("due"))
    return keys.join_parts(a, [b], "client_id", "full")


@query("children_distribution", """
SELECT n_children, count(*) AS n_parents, count(*) / sum(count(*)) OVER () AS freq
FROM (SELECT client_id, count(*) AS n_children FROM loan GROUP BY 1) c GROUP BY n_children""")
def children_distribution(spark, sf):
    return keys.children_distribution(roles.loan(spark, sf), "client_id")


@query("fk_count_describe", """
SELECT count(*) AS n_keys, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
       quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c""")
def fk_count_describe(spark, sf):
    return keys.occurrences_described(scan(spark, sf, "lineitem"), "l_orderkey")


@query("uniqueness_report", """
WITH p AS (SELECT DISTINCT loan_id, client_id FROM installment),
c AS (SELECT loan_id, count(*) AS n FROM p GROUP BY 1), q AS (SELECT client_id, count(*) AS n FROM p GROUP BY 1)
SELECT 'children' AS measure, count(*) AS n FROM c UNION ALL
SELECT 'children_with_one', count(*) FROM c WHERE n = 1 UNION ALL
SELECT 'children_with_many', count(*) FROM c WHERE n > 1 UNION ALL
SELECT 'parents', count(*) FROM q UNION ALL
SELECT 'parents_with_one', count(*) FROM q WHERE n = 1 UNION ALL
SELECT 'parents_with_many', count(*) FROM q WHERE n > 1 UNION ALL
SELECT 'pairs', count(*) FROM p""")
def uniqueness_report(spark, sf):
    return keys.uniqueness_report(roles.installment(spark, sf), "loan_id", "client_id")


@query("client_selector", """
SELECT c.client_id, l.loans, m.months FROM client c
JOIN (SELECT client_id, count(*) AS loans FROM loan GROUP BY 1 HAVING count(*) >= 3) l ON c.client_id = l.client_id
JOIN (SELECT client_id, count(*) AS months FROM monthly GROUP BY 1 HAVING count(*) >= 10) m ON c.client_id = m.client_id
WHERE c.target = 0""")
def client_selector(spark, sf):
    tables = {"loans": (roles.loan(spark, sf), 3), "months": (roles.monthly(spark, sf), 10)}
    return keys.select_clients(roles.client(spark, sf), tables, "client_id", "target", 0)


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return keys.duplicate_keys(scan(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("child_counts", """
SELECT c.client_id, c.segment, coalesce(n.n_open, 0) AS n_open FROM client c LEFT JOIN
  (SELECT client_id, count(*) AS n_open FROM loan WHERE status = 'O' GROUP BY 1) n ON c.client_id = n.client_id""")
def child_counts(spark, sf):
    open_loans = roles.loan(spark, sf).filter("status = 'O'")
    return keys.child_counts(roles.client(spark, sf).select("client_id", "segment"), open_loans, "client_id", "n_open")


VERSIONS = """a AS (SELECT client_id, days_employed, segment, area FROM sentinel),
b AS (SELECT client_id, nullif(days_employed, 365243) AS days_employed, nullif(segment, 'XNA') AS segment,
             CASE WHEN area = -1 THEN 2 ELSE area END AS area FROM sentinel)"""


def two_versions(spark, sf):
    before = roles.sentinel(spark, sf)
    after = cleaning.replace_sentinels(
        cleaning.nullify_sentinels(before, exclude=["client_id"]), {"area": {-1: 2}}
    )
    return before, after


@query("frame_diff", f"""
WITH {VERSIONS}
SELECT coalesce(a.client_id, b.client_id) AS client_id,
       CASE WHEN b.client_id IS NULL THEN 'left' WHEN a.client_id IS NULL THEN 'right' ELSE 'both' END AS present,
       a.client_id = b.client_id IS TRUE AND a.days_employed IS NOT DISTINCT FROM b.days_employed AS days_employed_same,
       b.days_employed - a.days_employed AS days_employed_diff,
       a.client_id = b.client_id IS TRUE AND a.segment IS NOT DISTINCT FROM b.segment AS segment_same, replace(b.segment, a.segment, '') AS segment_diff,
       a.client_id = b.client_id IS TRUE AND a.area IS NOT DISTINCT FROM b.area AS area_same, b.area - a.area AS area_diff
FROM a FULL JOIN b ON a.client_id = b.client_id""")
def frame_diff(spark, sf):
    before, after = two_versions(spark, sf)
    return compare.frame_diff(before, after, ["client_id"])


@query("frame_diff_counts", f"""
WITH {VERSIONS}, j AS (SELECT a.days_employed IS NOT DISTINCT FROM b.days_employed AS d, a.segment IS NOT DISTINCT FROM b.segment AS s,
  a.area IS NOT DISTINCT FROM b.area AS r, a.client_id = b.client_id IS TRUE AS k FROM a FULL JOIN b ON a.client_id = b.client_id)
SELECT 'days_employed' AS column_name, count(*) FILTER (k AND d) AS same, count(*) FILTER (NOT (k AND d)) AS different FROM j UNION ALL
SELECT 'segment', count(*) FILTER (k AND s), count(*) FILTER (NOT (k AND s)) FROM j UNION ALL
SELECT 'area', count(*) FILTER (k AND r), count(*) FILTER (NOT (k AND r)) FROM j""")
def frame_diff_counts(spark, sf):
    before, after = two_versions(spark, sf)
    return compare.diff_counts(before, after, ["client_id"])


@query("dtype_alignment", """
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice, o_orderstatus FROM orders""")
def dtype_alignment(spark, sf):
    model = scan(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    loose = model.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"),
                         F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus")
    return compare.align_types(loose, model)
