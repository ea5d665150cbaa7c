"""Key propagation, key-set comparison, relations between tables, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.session import with_row


def attach_client(
    df: DataFrame, loan_map: DataFrame, on: str = "loan_id", key: str = "client_id", keep_orphans: bool = False
) -> DataFrame:
    """Add the client key through the loan map; loans without a client are dropped."""
    return df.join(loan_map.select(on, key), on, "left" if keep_orphans else "inner")


def attach_target(
    df: DataFrame, client: DataFrame, key: str = "client_id", label: str = "target", unknown: int = -1
) -> DataFrame:
    """Add the label; clients that are not known get `unknown`."""
    labels = client.select(key, label)
    return df.join(labels, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(unknown)))


def attach_all(df: DataFrame, loan_map: DataFrame, client: DataFrame, on: str = "loan_id",
               key: str = "client_id", label: str = "target") -> DataFrame:
    """Client key if it is absent, then label if it is absent."""
    if key not in df.columns:
        df = attach_client(df, loan_map, on, key)
    return df if label in df.columns else attach_target(df, client, key, label)


def join_parts(base: DataFrame, parts: Sequence[DataFrame | None], key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join the optional parts side by side; parts grouped on the key need no new shuffle."""
    return reduce(lambda left, right: left.join(right, key, how), [p for p in parts if p is not None], base)


def key_presence(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a 0/1 flag for each table: a single shuffle for any number of tables.

    Duplicate keys collapse map-side, so a hot key costs one row per task.
    """
    names = list(tables)
    tagged = [
        df.select(key, *[F.lit(1 if n == name else 0).alias(n) for n in names])
        for name, df in tables.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.max(n).alias(n) for n in names])
    )


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of A and of B, in A only, in B only."""
    return key_presence({"a": a, "b": b}, key).agg(
        F.count_if(F.col("a") == 1).alias("n_a"),
        F.count_if(F.col("b") == 1).alias("n_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("a_only"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b_only"),
    )


def key_overlap_matrix(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """For every table pair: keys in A but not in B, its share of the union, union and common sizes."""
    names = list(tables)
    counts = key_presence(tables, key).agg(
        *[
            F.struct(
                F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"),
                F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"),
                F.count_if((F.col(a) == 1) | (F.col(b) == 1)).alias("either"),
            ).alias(f"{a}|{b}")
            for a in names
            for b in names
        ]
    )
    pairs = counts.unpivot([], counts.columns, "pair", "s")
    return pairs.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"),
        F.col("s.only_a").alias("only_a"),
        F.try_divide("s.only_a", "s.either").alias("share"),
        F.col("s.both").alias("both"),
        F.col("s.either").alias("either"),
    )


def membership_flags(main: DataFrame, tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One boolean per side table: does the main row's key occur there.

    One grouping and one join for any number of tables. A null key occurs nowhere.
    """
    joined = main.join(key_presence(tables, key), key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name) == 1, F.lit(False)) for name in tables})


def relation_arity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Least and most partners on either side, 0 where a key is unmatched."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    spans = counts.agg(
        F.min(F.when(in_b, F.col("a"))).alias("a_min"),
        F.max(F.when(in_b, F.col("a"))).alias("a_max"),
        F.min(F.when(in_a, F.col("b"))).alias("b_min"),
        F.max(F.when(in_a, F.col("b"))).alias("b_max"),
    )
    text = F.format_string("[A](%d..%d)--(%d..%d)[B]", "a_min", "a_max", "b_min", "b_max")
    return spans.withColumn("arity", text)


def children_distribution(child: DataFrame, parent_key: str) -> DataFrame:
    """How many parents have how many children."""
    per_parent = child.groupBy(parent_key).agg(F.count("*").alias("n_children"))
    counts = per_parent.groupBy("n_children").agg(F.count("*").alias("n_parents"))
    total = counts.agg(F.sum("n_parents").alias("_total"))
    return (
        counts.transform(with_row, total)
        .withColumn("freq", F.col("n_parents") / F.col("_total"))
        .drop("_total")
    )


def occurrences_described(child: DataFrame, key: str) -> DataFrame:
    """Describe the occurrences per key, from the distribution of counts.

    The distribution has few rows (k distinct counts need k²/2 child rows), so the exact
    percentiles keep a small buffer.
    """
    spread = child.groupBy(key).count().groupBy("count").agg(F.count("*").alias("keys"))
    x, w = F.col("count"), F.col("keys")
    n = F.sum(w)
    mean = F.sum(x * w) / n
    return spread.agg(
        n.alias("n_keys"),
        F.round(mean, 6).alias("mean"),
        F.round(F.sqrt((F.sum(x * x * w) - F.sum(x * w) * F.sum(x * w) / n) / (n - 1)), 6).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, F.lit(0.25), w).alias("q25"),
        F.percentile(x, F.lit(0.5), w).alias("q50"),
        F.percentile(x, F.lit(0.75), w).alias("q75"),
        F.max(x).alias("max"),
    )


def uniqueness_report(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Pairs, children and parents, split by whether a partner is unique.

    Partner counts are grouped, not windowed, so a parent with very many children stays
    spread over the tasks.
    """
    pairs = df.select(child, parent).distinct()

    def split(key: str, name: str):
        per_key = pairs.groupBy(key).agg(F.count("*").alias("n"))
        return per_key.agg(
            F.count("*").alias(f"{name}s"),
            F.count_if(F.col("n") == 1).alias(f"{name}s_with_one"),
            F.count_if(F.col("n") > 1).alias(f"{name}s_with_many"),
        )

    lines = split(child, "children").transform(with_row, split(parent, "parent")).transform(
        with_row, pairs.agg(F.count("*").alias("pairs"))
    )
    return lines.toDF(
        "children", "children_with_one", "children_with_many", "parents", "parents_with_one",
        "parents_with_many", "pairs",
    ).unpivot([], ["children", "children_with_one", "children_with_many", "parents",
                   "parents_with_one", "parents_with_many", "pairs"], "measure", "n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def child_counts(parent: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    counts = child.groupBy(key).agg(F.count("*").alias(name))
    return parent.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def select_clients(
    client: DataFrame, tables: Mapping[str, tuple[DataFrame, int]], key: str, label: str, wanted: int
) -> DataFrame:
    """Clients with the wanted label and at least the given number of rows in each table."""
    chosen = client.filter(F.col(label) == wanted).select(key)
    for name, (df, least) in tables.items():
        counts = df.groupBy(key).agg(F.count("*").alias(name)).filter(F.col(name) >= least)
        chosen = chosen.join(counts, key)
    return chosen
