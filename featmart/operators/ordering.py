"""Order-dependent work without one-task windows.

Three tools, picked by what bounds the data:

* `ordered_prefix` – running totals along any global or per-key order. One range sort,
  one reliable checkpoint, then per-block windows plus a small table of block totals.
* `hash_rank` / `first_n_by_hash` – ranks and exact-size samples along a uniform
  arithmetic hash. The hash range itself gives equal buckets, so no sort is needed.
* `exact_quantiles` – order statistics by selection: count per range bucket, then look
  only inside the buckets that hold the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.session import cut_lineage, with_row

HASH_MODULUS = 2147483647
HASH_MULTIPLIER = 1103515245


def ordered_prefix(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals of `sums` along `order`, restarted for each `by` key.

    A key may hold any share of the rows: the range sort on (by, order) spreads it over
    many blocks. `order` should be total, otherwise ties fall in arbitrary order.
    """
    by = list(by)
    values = {f"_v_{name}": expr for name, expr in sums.items()}
    blocks = (
        df.withColumns(values)
        .orderBy(*by, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    # Block numbers come from the sorted partitions, so they must not be recomputed.
    blocks = cut_lineage(blocks).withColumn("_block", F.shiftright("_slot", 33))
    totals = blocks.groupBy(*by, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_block").alias("_by_block"),
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    same = F.col("_block") == F.col("_by_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    local = Window.partitionBy(*by, "_block").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        blocks.join(offsets, same)
        .select(
            *df.columns,
            *[
                (F.sum(f"_v_{name}").over(local) + F.col(f"_o_{name}")).alias(name)
                for name in sums
            ],
        )
    )


def occurrence_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "occurrence") -> DataFrame:
    """0-based occurrence number of each key along `order`, null being a key of its own.

    Rows are numbered through `ordered_prefix` whatever the sizes of the keys, so a key
    may hold any share of them.
    """
    numbered = ordered_prefix(df, order, {name: F.lit(1)}, by=keys)
    return numbered.withColumn(name, (F.col(name) - 1).cast("long"))


def spread(key: str | Column, seed: int = 0) -> Column:
    """Uniform arithmetic hash of an integer key in [0, 2^31-1), reproducible in plain SQL.

    The seed enters before a square, so two seeds give unrelated orders. A null key has
    the hash 0.
    """
    col = F.col(key) if isinstance(key, str) else key
    modulus = F.lit(HASH_MODULUS).cast("long")
    first = F.pmod((F.pmod(col.cast("long"), modulus) + 1) * HASH_MULTIPLIER + _shift(seed), modulus)
    return F.coalesce(F.pmod(F.pmod(first * first, modulus) * HASH_MULTIPLIER + first, modulus), F.lit(0).cast("long"))


def _shift(seed: int) -> int:
    return (seed * 69621 + 12345) % HASH_MODULUS


def spread_sql(key: str, seed: int = 0) -> str:
    """SQL text of `spread` for non-negative keys."""
    first = f"(((CAST({key} AS BIGINT) % {HASH_MODULUS} + 1) * {HASH_MULTIPLIER} + {_shift(seed)}) % {HASH_MODULUS})"
    return f"coalesce((({first} * {first}) % {HASH_MODULUS} * {HASH_MULTIPLIER} + {first}) % {HASH_MODULUS}, 0)"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the columns of `right` follow, without its keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _hash_buckets(df: DataFrame, key: str, by: Sequence[str], seed: int, buckets: int):
    width = -(-HASH_MODULUS // buckets)
    hashed = df.withColumn("_h", spread(key, seed)).withColumn(
        "_bucket", F.floor(F.col("_h") / F.lit(width)).cast("int")
    )
    counts = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_bucket", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return hashed, offsets


def hash_rank(
    df: DataFrame,
    key: str,
    by: Sequence[str] = (),
    seed: int = 0,
    buckets: int = 65_536,
    name: str = "rank",
) -> DataFrame:
    """1-based rank of each row along (hash of `key`, `key`), within `by`.

    `key` must identify a row. A `by` class of any size is cut into `buckets` equal hash
    ranges, so no window task sees more than about 1/buckets of it. A null class is a
    class, and null keys rank with the hash 0, before other keys of that hash.
    """
    by = list(by)
    hashed, offsets = _hash_buckets(df, key, by, seed, buckets)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    return null_safe_join(hashed, offsets, [*by, "_bucket"]).select(
        *df.columns, (F.row_number().over(inside) + F.col("_before")).alias(name)
    )


def first_n_by_hash(
    df: DataFrame,
    key: str,
    n: DataFrame | int,
    by: Sequence[str] = (),
    seed: int = 0,
    buckets: int = 65_536,
) -> DataFrame:
    """Exactly the first `n` rows of each `by` class along the hash order.

    `n` is a number, or a table (by…, n). Buckets wholly below n are kept as they are;
    only the bucket where n falls is ranked, so almost no row is shuffled. Nulls count as
    in `hash_rank`.
    """
    by = list(by)
    hashed, offsets = _hash_buckets(df, key, by, seed, buckets)
    if isinstance(n, int):
        offsets = offsets.withColumn("_want", F.lit(n))
    elif by:
        offsets = null_safe_join(offsets, n.withColumnRenamed("n", "_want"), by)
    else:
        offsets = with_row(offsets, n.select(F.col("n").alias("_want")))
    placed = null_safe_join(hashed, offsets, [*by, "_bucket"])
    end = F.col("_before") + F.col("_n")
    whole = placed.filter(end <= F.col("_want")).select(*df.columns)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    edge = (
        placed.filter((F.col("_before") < F.col("_want")) & (end > F.col("_want")))
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_rank") <= F.col("_want"))
        .select(*df.columns)
    )
    return whole.unionByName(edge)


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], buckets: int | None = None
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several numeric expressions.

    Nulls are skipped. The wanted ranks are selected by `order_statistics` at every size;
    only the answers reach the driver.
    """
    names = list(columns)
    wide = _wide(df, columns)
    counts = _counts(wide, len(names))
    places = [[divmod(p * (n - 1), 1) if n else None for p in probs] for n in counts]
    ranks = [
        sorted({r for low, _ in spots for r in (int(low), min(int(low) + 1, n - 1))}) if n else []
        for spots, n in zip(places, counts)
    ]
    found = _select_ranks(wide, counts, ranks, buckets)
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        if not counts[i]:
            out[name] = [None] * len(probs)
            continue
        out[name] = [
            float(found[i][int(low)] + (found[i][min(int(low) + 1, counts[i] - 1)] - found[i][int(low)]) * part)
            for low, part in places[i]
        ]
    return out


def order_statistics(
    df: DataFrame, columns: Mapping[str, Column], ranks: Mapping[str, Sequence[int]], buckets: int | None = None
) -> dict[str, dict[int, float | int]]:
    """Values at the given 0-based ranks of each expression, exact, nulls skipped.

    Integers come back as integers, whatever their size.
    """
    names = list(columns)
    wide = _wide(df, columns)
    found = _select_ranks(wide, _counts(wide, len(names)), [list(ranks[n]) for n in names], buckets)
    return dict(zip(names, found))


INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Slices that values are counted in: one per so many rows, within these bounds.
SLICE_ROWS, FEWEST_SLICES, MOST_SLICES = 1_000_000, 512, 20_000


def _wide(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Each expression as a double c0, c1, …, and as an exact integer e0, e1, … where it is one."""
    named = df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())])
    kinds = dict(named.dtypes)
    return named.select(
        *[F.col(f"v{i}").cast("double").alias(f"c{i}") for i in range(len(kinds))],
        *[(F.col(f"v{i}") if kinds[f"v{i}"] in INTEGERS else F.lit(None)).cast("bigint").alias(f"e{i}") for i in range(len(kinds))],
    )


def _counts(wide: DataFrame, columns: int) -> list[int]:
    row = wide.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(columns)]).first()
    return list(row)


def _select_ranks(wide: DataFrame, counts: list[int], ranks: list[list[int]], buckets: int | None = None) -> list[dict]:
    """Selection by counting: approximate edges, counts per bucket, then only the buckets
    that hold a wanted rank, with equal values merged before they are shuffled.

    Every edge also closes a bucket right behind itself, so a value shared by many rows
    sits alone in its bucket and is answered from the counts.
    """
    cols = [f"c{i}" for i in range(len(counts))]
    if buckets is None:
        buckets = min(max(max(counts, default=0) // SLICE_ROWS, FEWEST_SLICES), MOST_SLICES)
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edge_row = wide.agg(*[F.percentile_approx(c, steps, 10 * buckets).alias(c) for c in cols]).first()
    splits = []
    for c in cols:
        edges = {e for v in edge_row[c] or [0.0] for e in (v, math.nextafter(v, math.inf))}
        splits.append([-math.inf, *sorted(e for e in edges if math.isfinite(e)), math.inf])
    placed = Bucketizer(
        inputCols=cols,
        outputCols=[f"b{i}" for i in range(len(cols))],
        splitsArray=splits,
        handleInvalid="keep",
    ).transform(wide)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("id"), F.col(f"b{i}").cast("int").alias("bucket"), F.col(c).alias("value"), F.col(f"e{i}").alias("exact")
            )
            for i, c in enumerate(cols)
        ]
    )
    long = placed.select(F.explode(cells).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    # Both grow together. Bounds of plain numbers are kept by hash, those of structs by sorting all rows.
    low, high = (F.struct(f("value").alias("value"), f("exact").alias("exact")) for f in (F.min, F.max))
    per_bucket = long.groupBy("id", "bucket").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high")).collect()

    def answer(cell):
        return cell["value"] if cell["exact"] is None else cell["exact"]

    found: list[dict] = [{} for _ in cols]
    sliced: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for i, targets in enumerate(ranks):
        before = 0
        for row in sorted((r for r in per_bucket if r["id"] == i), key=lambda r: r["bucket"]):
            inside = [t for t in targets if before <= t < before + row["n"]]
            if inside and row["low"] == row["high"]:
                found[i] |= {t: answer(row["low"]) for t in inside}
            elif inside:
                sliced[(i, row["bucket"])] = (before, inside)
            before += row["n"]
    if not sliced:
        return found

    in_slice, is_answer = F.lit(False), F.lit(False)
    base = F.lit(None).cast("long")
    for (i, bucket), (before, inside) in sliced.items():
        hit = (F.col("id") == i) & (F.col("bucket") == bucket)
        in_slice = in_slice | hit
        base = F.when(hit, F.lit(before).cast("long")).otherwise(base)
        for t in inside:
            is_answer = is_answer | (hit & (F.col("upto") > t) & (F.col("upto") - F.col("n") <= t))
    within = Window.partitionBy("id", "bucket").orderBy("value", "exact").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    merged = (
        long.filter(in_slice)
        .groupBy("id", "bucket", "value", "exact")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(within) + base)
    )
    for r in merged.filter(is_answer).collect():
        for t in sliced[(r["id"], r["bucket"])][1]:
            if r["upto"] - r["n"] <= t < r["upto"]:
                found[r["id"]][t] = answer(r)
    return found
