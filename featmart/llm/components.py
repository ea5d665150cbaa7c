"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.session import cut_lineage


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`, root being the component's smallest node.

    Nodes are of any one ordered type; self-loops, repeated edges and both directions are
    fine, edges with a null end are skipped. Each round joins the edges with one smallest
    neighbour per node: neighbour lists are never gathered, so a node may touch any share
    of all edges. Edges are checkpointed per round; only two counts reach the driver.
    """
    both = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b")
    links = cut_lineage(
        both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        links = cut_lineage(_small_star(_large_star(links)))
        row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == row:
            break
        before = row
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    ways = links.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))")
    low = ways.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
    return (
        links.join(low, links["b"] == low["n"])
        .select("a", F.col("low").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them.

    An edge to the smallest neighbour stays and each other one moves, so that the join alone
    makes all edges.
    """
    low = links.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
    moved = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
    return links.join(low, links["a"] == low["n"]).select(moved.alias("a"), F.col("low").alias("b")).distinct()
