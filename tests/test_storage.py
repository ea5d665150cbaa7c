"""Tables bucketed by key, and CSV rows that do not fit their schema."""

import re

import pytest
from pyspark.sql import functions as F

from featmart.operators.keys import join_parts
from featmart.plans import mart
from featmart.sources import sinks
from featmart.sources.tables import MissingTable, scan_checked


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[0]))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_star_joins_without_a_shuffle(spark, sf, no_broadcast):
    client, *parts = mart.bucketed_star(spark, sf, 8)
    stored = join_parts(client, parts, "client_id")
    plain = mart.feature_mart(spark, sf)
    assert shuffles(stored) == 0 < shuffles(plain)
    assert stored.columns == plain.columns
    assert stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()


def test_bucketed_keeps_hot_null_and_repeated_keys(spark, no_broadcast):
    keys = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id"))
    rows = spark.range(3000).select(keys.cast("bigint").alias("k"), "id")
    stored = sinks.bucketed(rows, "k", 4)
    assert stored.exceptAll(rows).isEmpty() and rows.exceptAll(stored).isEmpty()
    counts = stored.groupBy("k").count()
    assert shuffles(counts) == 0
    assert {r["k"]: r["count"] for r in counts.collect()} == {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    empty = sinks.bucketed(rows.filter("id < 0"), "k", 4)
    assert empty.columns == ["k", "id"] and empty.isEmpty()


def test_damaged_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x,note\n1,1.5,a\n2,n/a,b\n3,,\n4,2.5,"c,d"\nfive,1,e\n6,1\n7,1,f,g\n\n')
    good, damaged = scan_checked(spark, str(tmp_path), "t", "id bigint, x double, note string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 1.5, "a"), (3, None, None), (4, 2.5, "c,d")]
    lines = damaged.collect()
    assert sorted(r["line"] for r in lines) == ["2,n/a,b", "6,1", "7,1,f,g", "five,1,e"]
    assert all(r["file"].endswith("t.csv") for r in lines)


def test_checked_scan_of_an_empty_and_a_missing_table(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,x\n")
    good, damaged = scan_checked(spark, str(tmp_path), "e", "id bigint, x double")
    assert good.columns == ["id", "x"] and good.isEmpty() and damaged.isEmpty()
    with pytest.raises(MissingTable):
        scan_checked(spark, str(tmp_path), "none", "id bigint")


def test_the_mart_builds_accounts_once(spark, sf):
    """Lines are grouped by loan and month once for card and POS roll-ups, not once for each."""
    from featmart.plans import mart

    plan = mart.feature_mart(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_returnflag" in line and "Relation" in line for line in plan.splitlines()) == 2
