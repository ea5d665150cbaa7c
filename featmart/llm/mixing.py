"""Mixing sources to target weights, with DataFrame operations only.

Weights run down a tree (domain, language, source); so does the token budget. A node that
cannot take its share, because it has too few tokens, leaves the rest to its siblings in
proportion to their weights; only what all of them cannot take goes to the ancestors'
siblings. Each leaf then fills its budget with whole passes over its documents and the
token-prefix of one more, in an order seeded per pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm.tables import written
from featmart.session import cut_lineage, with_row

#: Levels of the tree, from the root's children to the leaves.
LEVELS = ("domain", "lang", "source")
#: Leading hexadecimal digits of the order; a leaf is counted in 16^SLICE_DIGITS slices,
#: and documents are ranked only in the slice where the prefix ends.
SLICE_DIGITS = 3
#: What a null stands for in a level or in the order.
UNKNOWN = "?"
#: Words: [^\x20\x09-\x0D]+
WORD = r"[^ \t-\r]+"


def word_count(text: str) -> Column:
    """White-space separated words, none for null: the token measure of the mix."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: Column, seed: int, epoch: Column) -> Column:
    """Seeded pseudo-random order of documents in a pass, the same in any SQL engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(UNKNOWN))))


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    """The weight of a level's value, 1 where none is given."""
    out = F.lit(1).cast("long")
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(weight).cast("long")).otherwise(out)
    return out


def budgets(
    leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """`leaves` (levels, tokens) with the `budget` of each leaf, `percent` of all tokens.

    A parent's budget B among children of weight w and capacity c: children fill by rising
    c/w; with C the capacity before a child and W the weight from it on, it is full if
    c * W <= w * (B - C), and those after the last full child share what is left by
    weight. Whole tokens, rounded down. w * B and c * W must stay below 2^63. There is
    one row per node of the tree, so a window holds the children of one node and never
    documents.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    parent = nodes.agg(
        F.least(F.expr(f"coalesce(sum(tokens), 0) * {int(percent)} div 100"), F.coalesce(F.sum("capacity"), F.lit(0))).alias("budget")
    )
    path: list[str] = []
    for level in levels:
        children = nodes.groupBy(*path, level).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", weight_of(level, weights.get(level, {}))
        )
        given = children.join(parent, path) if path else with_row(children, parent)
        order = Window.partitionBy(*path).orderBy(F.col("capacity") / F.col("weight"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        placed = given.select(
            *path, level, "capacity", "weight", "budget",
            F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("c"), F.sum("weight").over(onward).alias("w"),
        ).withColumn("full", F.col("capacity") * F.col("w") <= F.col("weight") * (F.col("budget") - F.col("c")))
        whole = Window.partitionBy(*path)
        shared = placed.withColumns({
            "left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole),
            "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(whole),
        })
        path.append(level)
        parent = shared.select(
            *path, F.expr("if(full, capacity, (left * weight) div nullif(open, 0))").cast("long").alias("budget")
        )
    return leaves.join(parent, list(levels))


def documents_of(docs: DataFrame, domain: Column, id_col: str, text: str, lang: str, source: str) -> DataFrame:
    """(id, domain, lang, source, n_tokens): one row per id and leaf, without texts."""
    known = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(n) for c, n in zip((domain, F.col(lang), F.col(source)), LEVELS)]
    return (
        docs.select(F.col(id_col).alias("id"), *known, word_count(text).alias("n_tokens"))
        .groupBy("id", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    )


def cuts(units: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: `epochs` whole passes, and where its last, partial pass ends.

    `cut_key`, `cut_id` name the last document of the partial pass and `cut_take` the
    tokens that are taken of it; null where there is none. A leaf's documents are summed
    per slice of the order, so that one leaf may hold any share of all documents.
    """
    leaves = units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, weights, percent, max_epochs).select(
        *LEVELS, F.expr("budget div nullif(tokens, 0)").alias("epochs"), F.expr("budget % nullif(tokens, 0)").alias("rest")
    ).select(*LEVELS, F.coalesce("epochs", F.lit(0)).alias("epochs"), F.coalesce("rest", F.lit(0)).alias("rest"))
    plan = written(plan, "mix-plan")
    keyed = units.filter("n_tokens > 0").join(plan.filter("rest > 0"), list(LEVELS)).withColumn("key", order_key(F.col("id"), seed, F.col("epochs")))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    along = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("goal"))
    edge = (
        slices.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .filter((F.col("before") < F.col("goal")) & (F.col("before") + F.col("n") >= F.col("goal")))
        .select(*LEVELS, "slice", "before")
    )
    inside = Window.partitionBy(*LEVELS).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        keyed.join(edge, [*LEVELS, "slice"])
        .withColumn("done", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .filter((F.col("done") < F.col("rest")) & (F.col("done") + F.col("n_tokens") >= F.col("rest")))
        .select(*LEVELS, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), (F.col("rest") - F.col("done")).alias("cut_take"))
    )
    return written(plan.join(last, list(LEVELS), "left").select(*LEVELS, "epochs", "cut_key", "cut_id", "cut_take"), "mix-cuts")


def _passes(rows: DataFrame, id_col: str, tokens: str, seed: int, keep: list[str]) -> DataFrame:
    """Rows joined with their leaf's cuts, once per pass that takes them."""
    key = order_key(F.col(id_col), seed, F.col("epochs"))
    order_id, order_cut = F.struct(F.col(id_col)), F.struct(F.col("cut_id"))
    at_cut = (key == F.col("cut_key")) & F.col(id_col).eqNullSafe(F.col("cut_id"))
    partial = F.coalesce((key < F.col("cut_key")) | ((key == F.col("cut_key")) & (order_id <= order_cut)), F.lit(False))
    passes = F.expr("epochs") + F.when(partial, 1).otherwise(0)
    return (
        rows.filter(F.col(tokens) > 0)
        .withColumns({"_passes": passes, "_cut": F.coalesce(at_cut, F.lit(False))})
        .filter("_passes > 0")
        .select(*keep, "_cut", "cut_take", "epochs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)).alias("epoch"))
    )


def mixture(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(id, domain, lang, source, epoch, n_tokens, take_tokens): each taken document per pass.

    A leaf's `take_tokens` add up to its budget: the last document of its partial pass is
    cut to the tokens still wanted. Nulls in a level count as the node '?'. A null or
    empty text has no tokens and is never taken. Rows that share an id and leaf are one
    document. An empty table gives no rows.
    """
    units = cut_lineage(documents_of(docs, domain, id_col, text, lang, source))
    joined = units.join(cuts(units, weights, percent, max_epochs, seed), list(LEVELS))
    taken = _passes(joined, "id", "n_tokens", seed, ["id", *LEVELS, "n_tokens"])
    take = F.when(F.col("_cut") & (F.col("epoch") == F.col("epochs")), F.col("cut_take")).otherwise(F.col("n_tokens"))
    return taken.select(F.col("id").alias(id_col), *LEVELS, "epoch", "n_tokens", take.alias("take_tokens"))


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int = 1, seed: int = 17,
    id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The rows of `docs` in the mixture, whole and once per pass that takes them.

    Texts meet only the small table of cuts, by their leaf; they are not sorted or dealt
    out by document.
    """
    units = cut_lineage(documents_of(docs, domain, id_col, text, lang, source))
    table = cuts(units, weights, percent, max_epochs, seed)
    renamed = docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(docs.columns)})
    at = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    known = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(n) for c, n in zip((domain, F.col(lang), F.col(source)), LEVELS)]
    leaf = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in docs.columns], *known, word_count(text).alias("_tokens"))
    taken = _passes(leaf.join(table, list(LEVELS)), at[id_col], "_tokens", seed, renamed.columns)
    return taken.select(*[F.col(at[c]).alias(c) for c in docs.columns])


def mixture_sql(domain: str, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int, seed: int) -> str:
    """The same mixture of the table `documents` in SQL, where `domain` is its expression."""
    parts = [f"""units AS (
  SELECT doc_id, coalesce({domain}, '?') AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
         CAST(sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS BIGINT) AS n_tokens
  FROM documents GROUP BY ALL)""",
        f"leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS capacity FROM units GROUP BY ALL)",
        f"b0 AS (SELECT least(sum(tokens) * {percent} // 100, sum(capacity)) AS budget FROM leaves)"]
    path: list[str] = []
    for i, level in enumerate(LEVELS):
        upper = ", ".join(path)
        by = f"PARTITION BY {upper}" if path else ""
        join = f"JOIN b{i} USING ({upper})" if path else f"CROSS JOIN b{i}"
        whens = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in weights.get(level, {}).items())
        weight = f"CASE {whens} ELSE 1 END" if whens else "1"
        path.append(level)
        names = ", ".join(path)
        parts += [
            f"n{i} AS (SELECT {names}, sum(capacity) AS capacity, {weight} AS weight FROM leaves GROUP BY {names})",
            f"""p{i} AS (SELECT *, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= weight * (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM n{i} {join} WINDOW o AS ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {level}))""",
            f"""b{i + 1} AS (SELECT {names}, CASE WHEN filled THEN capacity ELSE
      (budget - coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0)) * weight // sum(weight) FILTER (NOT filled) OVER ({by}) END AS budget
  FROM p{i})""",
        ]
    leaf = ", ".join(LEVELS)
    return "WITH " + ",\n".join(parts) + f""",
plan AS (SELECT {leaf}, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN b3 USING ({leaf}) WHERE tokens > 0),
passes AS (SELECT units.*, rest, epochs, unnest(range(CAST(epochs AS BIGINT) + 1)) AS epoch FROM units JOIN plan USING ({leaf}) WHERE n_tokens > 0),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {leaf}, epoch
    ORDER BY md5('{seed}-' || epoch || '-' || coalesce(CAST(doc_id AS VARCHAR), '?')), doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM passes)
SELECT doc_id, {leaf}, epoch, n_tokens,
  CAST(CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, rest - done) END AS BIGINT) AS take_tokens
FROM ordered WHERE epoch < epochs OR done < rest"""
