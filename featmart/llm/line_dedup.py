"""Boilerplate lines by the number of different sites they stand on, with DataFrame
operations only.

One HyperLogLog sketch of sites per line is built and merged by aggregation. Lines whose
estimate is clearly above the threshold are boilerplate, those clearly below are not, and
lines near it get an exact distinct count, so the outcome is that of exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.llm.tables import kept_names, written

#: Lines on at least so many different sites are removed.
SITES = 5
#: Sketches have 2^SKETCH_BITS registers: a relative standard error of about 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold (over six standard errors) are counted exactly.
MARGIN = 0.1
#: What a null site counts as.
UNKNOWN = "?"
BLANK = " \t\n\x0b\f\r"


def lines_of(docs: DataFrame, keys: dict[str, Column], text: str, site: str) -> DataFrame:
    """(keys, site, at, a, b): each line that has a word, by position and 128-bit hash.

    Lines are compared without the white space around them.
    """
    line = F.btrim(F.col("_line"), F.lit(BLANK))
    return (
        docs.select(
            *[c.alias(n) for n, c in keys.items()], F.coalesce(F.col(site).cast("string"), F.lit(UNKNOWN)).alias("site"),
            F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "_line"),
        )
        .withColumn("_line", line).filter("_line <> ''")
        .select(*keys, "site", "at", F.xxhash64("_line").alias("a"), F.xxhash64(F.lit(1), F.col("_line")).alias("b"))
    )


def widespread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(a, b) of the lines on at least `sites` sites.

    A line shared by a third of all documents is one sketch per task after the map-side
    aggregation, and its exact count is over (line, site) pairs.
    """
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch")).select(
        "a", "b", F.hll_sketch_estimate("sketch").alias("about")
    )
    low, high = sites * (1 - MARGIN) - 1, sites * (1 + MARGIN) + 1
    placed = written(sketched.filter(F.col("about") >= low), "lines-placed")
    near = written(placed.filter(F.col("about") <= high).select("a", "b"), "lines-near")
    exact = (
        lines.join(near, ["a", "b"], "left_semi")
        .select("a", "b", "site").distinct()
        .groupBy("a", "b").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= sites).select("a", "b")
    )
    return placed.filter(F.col("about") > high).select("a", "b").unionByName(exact)


def remove_boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """`docs` without their widespread lines, with `n_lines` and `n_removed` added.

    Both count lines that have a word; blank lines stay. A null text stays null and has no
    lines; a text of which nothing is left is empty. Repeated rows are treated alike; an
    empty table gives an empty one. Columns of those two names come back with `_in` behind
    theirs.
    """
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    docs, id_col, text, site, outer = docs.toDF(*names), *(names[docs.columns.index(c)] for c in (id_col, text, site)), docs.columns
    keys = {"_k": F.xxhash64(F.col(id_col), F.col(text)), "_l": F.xxhash64(F.lit(1), F.col(text), F.col(id_col))}
    lines = lines_of(docs, keys, text, site)
    gone = written(widespread(lines, sites), "lines-gone")
    places = (
        lines.join(gone, ["a", "b"], "left_semi")
        .groupBy("_k", "_l").agg(F.collect_set("at").alias("_gone"))
    )
    parts = F.split(F.col(text), "\n", -1)
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    gone_here = F.coalesce("_gone", F.array().cast("array<int>"))
    stay = F.transform(F.array_except(every, gone_here), lambda i: F.get(parts, i))
    results = ("n_lines", "n_removed")
    return docs.withColumns(keys).join(places, ["_k", "_l"], "left").select(
        *names[:at], F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n")).alias(text), *names[at + 1 :],
        F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone_here).cast("long").alias("n_removed"),
    ).toDF(*kept_names(outer, results), *results)


BLANK_SQL = " || ".join(f"chr({ord(c)})" for c in BLANK)
SQL = f"""
WITH lines AS (SELECT trim(unnest(string_split(text, chr(10))), {BLANK_SQL}) AS line, coalesce(source, '{UNKNOWN}') AS site FROM documents),
gone AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
listed AS (SELECT coalesce(list(line), []) AS gone FROM gone)
SELECT doc_id,
  array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT list_contains(gone, trim(x, {BLANK_SQL}))], chr(10)) AS text,
  CAST(coalesce(len([x FOR x IN string_split(text, chr(10)) IF trim(x, {BLANK_SQL}) <> '']), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len([x FOR x IN string_split(text, chr(10)) IF list_contains(gone, trim(x, {BLANK_SQL}))]), 0) AS BIGINT) AS n_removed
FROM documents CROSS JOIN listed
"""
