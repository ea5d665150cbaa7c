"""Exact nearest neighbours, and the resampling methods built on them.

Points are cut into boxes by median splits. Every query first looks into its own box,
which bounds its k-th distance; it then visits only the boxes that can hold something
nearer. Box visits are joined by (box, slice) with both sides sliced to a fixed size, so
neither a dense box nor a popular one becomes one large task, and only the k best of each
visit leave it. In few dimensions a query visits a few boxes; in many dimensions pruning
fades and the work approaches that of comparing everything, still in bounded blocks: a
matrix product rules most pairs of a block out, the others are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmart.operators.ordering import HASH_MODULUS, ordered_prefix, spread
from featmart.operators.sampling import repeated
from featmart.session import cut_lineage, with_row

SAMPLE_ROWS = 50_000
BLOCK_CELLS = 4_000_000
#: Points of a box, about: a query moves once for each box that it visits.
BOX_ROWS = 16_384


def split_boxes(sample: np.ndarray, boxes: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, threshold, low child, high child) of a median-split tree; negative
    children are leaves, numbered -1, -2, …"""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        spans = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if wanted <= 1 or len(points) < 4 or spans.max() == 0:
            leaves += 1
            return -leaves
        dim = int(spans.argmax())
        cut = float(np.median(points[:, dim]))
        low = points[:, dim] <= cut
        if low.all():
            cut = float(points[:, dim][points[:, dim] < cut].max())
            low = points[:, dim] <= cut
        spot = len(nodes)
        nodes.append((dim, cut, 0, 0))
        left = grow(points[low], wanted // 2)
        right = grow(points[~low], wanted - wanted // 2)
        nodes[spot] = (dim, cut, left, right)
        return spot

    root = grow(sample, boxes)
    return nodes if root == 0 else []


def box_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """Leaf number (from 1) of each point."""
    if not nodes:
        return np.ones(len(points), dtype=np.int64)
    place = np.zeros(len(points), dtype=np.int64)
    active = np.arange(len(points))
    table = np.array(nodes)
    while len(active):
        node = table[place[active]]
        dims = node[:, 0].astype(int)
        low = points[active, dims] <= node[:, 1]
        place[active] = np.where(low, node[:, 2], node[:, 3]).astype(np.int64)
        active = active[place[active] >= 0]
    return -place


def _copies_cut(points: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows of `points`, by id, without all but the first `most` of equal ones."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(points[order] + 0.0)  # a zero has one sign
    _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[np.sort(by_group[place < most])]


def best_k(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray | None = None):
    """For each query the k nearest points other than itself: (query row, point id, squared
    distance). Points beyond a query's `reach`, a squared distance, may be left out.

    Distances by one matrix product, less accurate by `slack` at most, choose the pairs whose
    distances are then computed. Of equal points only k besides the query's own can count.
    """
    # No distance from a point without finite coordinates is a number.
    finite = np.isfinite(points).all(axis=1)
    points, ids = points[finite], ids[finite]
    if points.size:
        kept = _copies_cut(points, ids, k + 1)
        points, ids = points[kept], ids[kept]
    middle = points.sum(axis=0) / max(1, len(points))
    near, asked = points - middle, queries - middle
    squares, asked_squares = (near ** 2).sum(axis=1), (asked ** 2).sum(axis=1)
    # Twice the bound of the rounding of the product, of the squares and of the shifted points.
    scale = squares.max(initial=0) + asked_squares.max(initial=0, where=np.isfinite(asked_squares)) + (middle ** 2).sum()
    slack = 16 * (points.shape[1] + 8) * np.finfo(float).eps * scale
    rows, keys, dists = [], [], []
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    some = max(1, BLOCK_CELLS // max(1, points.shape[1]))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        rough = squares - 2 * (asked[part] @ near.T) + asked_squares[part, None]
        limit = np.full(len(rough), np.inf) if reach is None else reach[part]
        wide = np.flatnonzero(np.isinf(limit))
        if len(wide) and len(points) > k + 1:
            # The query itself may be one of them.
            limit = limit.copy()
            limit[wide] = np.partition(rough if len(wide) == len(rough) else rough[wide], k, axis=1)[:, k] + slack
        # What is no number is not ruled out.
        at, which = np.nonzero(~(rough > (limit * (1 + 1e-12) + slack)[:, None]))
        at += start
        other = own[at] != ids[which]
        at, which = at[other], which[other]
        d2 = np.empty(len(at))
        for low in range(0, len(at), some):
            d2[low:low + some] = ((queries[at[low:low + some]] - points[which[low:low + some]]) ** 2).sum(axis=1)
        # Equal distances are settled by the smaller id; a distance that is no number is none.
        order = np.lexsort((ids[which], d2, at))
        order = order[np.isfinite(d2[order])]
        at, which, d2 = at[order], which[order], d2[order]
        sizes = np.bincount(at - start, minlength=len(rough))
        first = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
        rows.append(at[first])
        keys.append(ids[which[first]])
        dists.append(d2[first])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(dists)


def nearest(points: DataFrame, queries: DataFrame, k: int, box_rows: int = BOX_ROWS) -> DataFrame:
    """(id, neighbour, distance², place): the k nearest points of each query, exactly.

    Both tables have `id` (unique integer) and `x` (array<double>); a query never meets
    the point with its own id.
    """
    spark = points.sparkSession
    total = points.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample_rows = points.filter(spread("id", 17) < int(share * HASH_MODULUS)).select("x").limit(2 * SAMPLE_ROWS).collect()
    sample = np.array([r["x"] for r in sample_rows], dtype=float)
    nodes = split_boxes(sample, max(1, math.ceil(total / box_rows))) if len(sample) else []

    def put_in_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(box=box_of(np.stack(batch["x"].to_numpy()), nodes))

    def placed(df: DataFrame) -> DataFrame:
        return df.select("id", "x").mapInPandas(put_in_boxes, "id bigint, x array<double>, box bigint")

    boxed = cut_lineage(placed(points))
    asked = cut_lineage(placed(queries))
    dims = F.size("x")
    width = boxed.agg(F.max(dims)).first()[0] or 0
    edges = boxed.groupBy("box").agg(
        F.count("*").alias("n"),
        F.array(*[F.min(F.get("x", F.lit(i))) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.get("x", F.lit(i))) for i in range(width)]).alias("high"),
    ).collect()
    # One row per box: bounded by total / box_rows.
    names = np.array([r["box"] for r in edges])
    lows = np.array([r["low"] for r in edges], dtype=float)
    highs = np.array([r["high"] for r in edges], dtype=float)
    sizes = spark.createDataFrame([(r["box"], r["n"]) for r in edges], "box bigint, n bigint")

    schema = "id bigint, neighbour bigint, d2 double"

    def compare(key, asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"id": [], "neighbour": [], "d2": []}).astype(
                {"id": "int64", "neighbour": "int64", "d2": "float64"}
            )
        own = asking["id"].to_numpy()
        rows, keys, dists = best_k(
            np.stack(asking["x"].to_numpy()), np.stack(there["x"].to_numpy()), there["id"].to_numpy(), own, k,
            asking["reach"].to_numpy(),
        )
        return pd.DataFrame({"id": own[rows], "neighbour": keys, "d2": dists})

    def visit(visits: DataFrame, load: DataFrame) -> DataFrame:
        """Compare queries with the points of the boxes they visit, both sides in slices;
        `load` has the number of visits, `q`, of each box."""
        plan = sizes.join(load, "box").select(
            "box",
            F.ceil(F.col("n") / box_rows).alias("p_slices"),
            F.ceil(F.col("q") / box_rows).alias("q_slices"),
        )

        def sliced(df: DataFrame, mine: str, other: str, me: str, them: str) -> DataFrame:
            return (
                df.join(F.broadcast(plan), "box")
                .withColumn(me, F.pmod(spread("id", 29), F.col(mine)))
                .withColumn(them, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
                .drop("p_slices", "q_slices")
            )

        left = sliced(visits, "q_slices", "p_slices", "qs", "ps").groupBy("box", "ps", "qs")
        right = sliced(boxed, "p_slices", "q_slices", "ps", "qs").groupBy("box", "ps", "qs")
        return left.cogroup(right).applyInPandas(compare, schema)

    def keep_best(found: DataFrame) -> DataFrame:
        # Ranks are cut before the shuffle as well as after it; a list holds k entries.
        nearest_first = Window.partitionBy("id").orderBy("d2", "neighbour")
        kept = found.withColumn("_r", F.row_number().over(nearest_first)).filter(F.col("_r") <= k)
        return kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d2", "neighbour"))).alias("best"))

    whole = asked.withColumn("reach", F.lit(float("inf")))
    first = cut_lineage(keep_best(visit(whole, asked.groupBy("box").agg(F.count("*").alias("q")))))
    reach = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))["d2"]).otherwise(float("inf"))
    bounded = cut_lineage(asked.join(first, "id", "left").select(
        "id", "x", "box", F.coalesce(reach, F.lit(float("inf"))).alias("reach")
    ))

    def near_boxes(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Other boxes that can hold something nearer, and which queries must visit them."""
        x = np.stack(batch["x"].to_numpy())
        reach_, box_ = batch["reach"].to_numpy(), batch["box"].to_numpy()
        for name, low, high in zip(names, lows, highs):
            gap = np.maximum(low - x, 0) + np.maximum(x - high, 0)
            near = ((gap ** 2).sum(axis=1) <= reach_ * (1 + 1e-12)) & (box_ != name)
            if near.any():
                yield name, near

    def other_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from (batch[near].assign(box=name) for name, near in near_boxes(batch))

    def visits_counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([(name, near.sum()) for name, near in near_boxes(batch)], columns=["box", "q"])

    # Visits are counted first and made where they are shuffled: they are never stored.
    load = cut_lineage(bounded.mapInPandas(visits_counted, "box bigint, q bigint").groupBy("box").agg(F.sum("q").alias("q")))
    more = bounded.mapInPandas(other_boxes, "id bigint, x array<double>, box bigint, reach double")
    known = first.select("id", F.explode("best").alias("b")).select("id", "b.neighbour", "b.d2")
    merged = keep_best(known.unionByName(visit(more, load)))
    return merged.select("id", F.posexplode("best").alias("place", "b")).select(
        "id", F.col("b.neighbour").alias("neighbour"), F.col("b.d2").alias("d2"), "place"
    )


def tomek_links(df: DataFrame, label: str = "label", box_rows: int = BOX_ROWS) -> DataFrame:
    """Pairs (minority 1, majority 0) that are each other's nearest neighbour."""
    near = nearest(df, df, 1, box_rows).select("id", "neighbour")
    back = near.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    mutual = near.join(back, ["id", "neighbour"])
    ones = df.filter(F.col(label) == 1).select("id")
    zeros = df.filter(F.col(label) == 0).select(F.col("id").alias("neighbour"))
    return mutual.join(ones, "id", "left_semi").join(zeros, "neighbour", "left_semi").select(
        F.col("id").alias("minority_id"), F.col("neighbour").alias("majority_id")
    )


def near_miss(df: DataFrame, label: str = "label", k: int = 3, box_rows: int = BOX_ROWS) -> DataFrame:
    """As many majority rows as there are minority rows: those closest on average to their
    k nearest minority rows."""
    minority, majority = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    near = nearest(minority, majority, k, box_rows)
    means = near.groupBy("id").agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    wanted = minority.agg(F.count("*").alias("_wanted"))
    placed = ordered_prefix(means, [F.col("mean_distance"), F.col("id")], {"_place": F.lit(1)})
    return placed.transform(with_row, wanted).filter(F.col("_place") <= F.col("_wanted")).select("id", "mean_distance")


def smote(df: DataFrame, label: str = "label", k: int = 5, seed: int = 0, box_rows: int = BOX_ROWS) -> DataFrame:
    """Synthetic minority rows up to the majority size, each on the line from a minority row
    to one of its k nearest minority neighbours; neighbour and fraction come from the hash."""
    minority = df.filter(F.col(label) == 1).select("id", "x")
    sizes = df.agg(F.count_if(F.col(label) == 0).alias("most"), F.count_if(F.col(label) == 1).alias("few")).first()
    missing, few = sizes["most"] - sizes["few"], sizes["few"]
    near = nearest(minority, minority, k, box_rows).join(
        minority.select(F.col("id").alias("neighbour"), F.col("x").alias("nx")), "neighbour"
    )
    partners = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "nx"))).alias("partners"))
    ranked = ordered_prefix(minority, [F.col("id")], {"_place": F.lit(1)})
    times = F.lit(missing // max(few, 1)) + F.when(F.col("_place") <= missing % max(few, 1), 1).otherwise(0)
    wanted = ranked.withColumn("_times", times.cast("long")).filter("_times > 0")
    copies = repeated(wanted.select("id", "x", "_times"), "_times").select("id", "x", "copy")
    draw = spread(F.col("id") * 1000003 + F.col("copy"), seed)
    fraction = spread(F.col("id") * 1000003 + F.col("copy"), seed + 1) / F.lit(HASH_MODULUS)
    chosen = copies.join(partners, "id").withColumns(
        {"_nx": F.get("partners", F.pmod(draw, F.size("partners")).cast("int"))["nx"], "_f": fraction}
    )
    return chosen.select(
        "id", "copy", F.zip_with("x", "_nx", lambda a, b: a + (b - a) * F.col("_f")).alias("x"), F.lit(1).alias(label)
    )


def smote_tomek(df: DataFrame, label: str = "label", k: int = 5, seed: int = 0, box_rows: int = BOX_ROWS) -> DataFrame:
    """Rows after raising the minority with `smote` and dropping both ends of Tomek links."""
    top = df.agg(F.max("id")).first()[0] or 0
    made = smote(df, label, k, seed, box_rows)
    numbered = ordered_prefix(made, [F.col("id"), F.col("copy")], {"_new": F.lit(1)})
    both = df.select("id", "x", label).unionByName(
        numbered.select((F.col("_new") + top).alias("id"), "x", label)
    )
    both = cut_lineage(both)
    links = tomek_links(both, label, box_rows)
    ends = links.select(F.col("minority_id").alias("id")).unionByName(links.select(F.col("majority_id").alias("id")))
    return both.join(ends, "id", "left_anti")
