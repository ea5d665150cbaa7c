"""Role views on single odd rows."""

from datetime import datetime

from featmart.plans import roles


def test_score_counts_hundredths_exactly(spark, tmp_path):
    """57 late loans add 0.57, as in SQL: 57 * 0.01 is 0.5700000000000001 and turned this score to 0.849."""
    spark.createDataFrame(
        [(1, "a", 0, 4430.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(
        [(i, 1, "F", 1.0, datetime(2000, 1, 1), "1-URGENT") for i in range(57)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["score"] for r in roles.scored(spark, str(tmp_path)).collect()] == [0.848]
