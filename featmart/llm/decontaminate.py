"""Benchmark passages in documents, by a prefix-filtered set join and exact verification.

A window of an item is a set of shingles, all of which must occur where the window does:
so one shingle, its prefix under an order by rarity, is enough to find it. Documents are
read once; only passages whose shingles may belong to the benchmark leave that pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm import words
from featmart.llm.tables import kept_names, map_batches, numbered, raw
from featmart.session import cut_lineage

#: Consecutive item words that count as one window; shorter items are one window.
WINDOW_WORDS = 13
#: Words of a set element; windows of fewer words have one element, all their words.
SHINGLE_WORDS = 8
#: The filter for documents' shingles has 2^FILTER_BITS bits (4 MB) for any benchmark:
#: a fuller filter only lets more passages through to the join.
FILTER_BITS = 25
#: Contaminated: at least one of so many words is hit.
SHARE = 20


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window, words, offsets, tokens): every window with its shingles' hashes.

    `window` is the space-joined words. Items without words have none.
    """
    source = items.select(F.col(id_col).alias("item"), raw(text).alias("text"))
    kind = dict(source.dtypes)["item"]

    def work(batch):
        out: dict[str, list] = {k: [] for k in ("item", "window", "words", "offsets", "tokens")}
        ids = batch.column("item").to_pylist()
        for chunk in words.chunks(batch.column("text")):
            found = chunk.runs(words.LETTER_DIGIT)
            hashes = found.hashes(lower=True)
            body = words.LOWER[chunk.data].tobytes()
            for i in range(chunk.texts):
                low, high = found.first[i], found.first[i + 1]
                spans = zip(found.starts[low:high], found.ends[low:high])
                text_words = [body[a:b].decode("utf-8", "replace") for a, b in spans]
                if not text_words:
                    continue
                width = min(SHINGLE_WORDS, len(text_words))
                alone = words.Runs(chunk, found.starts[low:high], found.ends[low:high], np.array([0, high - low]))
                alone.__dict__["owner"] = np.zeros(high - low, dtype=np.int64)
                tokens = alone.shingles(hashes[low:high], width)[1].view(np.int64)
                size = min(WINDOW_WORDS, len(text_words))
                for at in range(len(text_words) - size + 1):
                    mine = text_words[at : at + size]
                    out["item"].append(ids[chunk.low + i])
                    out["window"].append(" ".join(mine))
                    out["words"].append(mine)
                    out["offsets"].append(list(range(size - width + 1)))
                    out["tokens"].append(tokens[at : at + size - width + 1].tolist())
        return out

    schema = f"item {kind}, window string, words array<string>, offsets array<int>, tokens array<bigint>"
    return map_batches(source, schema, work)


def token_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the windows' tokens, and the widths of their shingles.

    The bitmap is put together by aggregation in pieces of 4 KB; its size does not depend
    on the benchmark's, so it may go to the driver and back to all tasks.
    """
    place = F.col("token").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    pieces = (
        windows.select(F.explode("tokens").alias("token"))
        .select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    bitmap = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    step = (1 << 15) // 8
    # At most 4 MB, in one job: an iterator would run one for each shuffle partition.
    found = pieces.toArrow()
    for k, bits in zip(found.column("k").to_pylist(), found.column("bits").to_pylist()):
        bitmap[(k - 1) * step : k * step] = np.frombuffer(bits, dtype=np.uint8)
    widths = windows.select(F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("w")).distinct().collect()
    return bitmap, sorted(r["w"] for r in widths)


def passages(docs: DataFrame, bitmap: np.ndarray, widths: list[int], keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, `n_words` and `found`: the passages of each text whose shingles may be known.

    A passage is a longest run of words covered by such shingles: its first word's
    position, its words, and the shingles' positions and hashes. An occurrence of a window
    always lies inside one.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(bitmap)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], raw(text).alias("_text"))
    kinds = dict(source.dtypes)

    def work(batch):
        bits = known.value
        counts, found = [], []
        for chunk in words.chunks(batch.column("_text")):
            runs = chunk.runs(words.LETTER_DIGIT)
            counts.append(runs.per_text)
            rows: list[list] = [[] for _ in range(chunk.texts)]
            hashes = runs.hashes(lower=True) if widths else np.zeros(0, dtype=np.uint64)
            hits = []
            flags = np.zeros(len(runs), dtype=bool)
            for width in widths:
                at, tokens = runs.shingles(hashes, width)
                slot = tokens & np.uint64((1 << FILTER_BITS) - 1)
                is_known = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, tokens = at[is_known], tokens[is_known]
                hits.append((at, tokens.view(np.int64)))
                flags |= words.covered(at, width, len(runs))
            if flags.any():
                _collect(chunk, runs, flags, hits, rows)
            found += rows
        return {c: batch.column(c) for c in keep} | {"n_words": np.concatenate(counts), "found": found}

    piece = "struct<at:int,words:array<string>,places:array<int>,tokens:array<bigint>>"
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_words bigint", f"found array<{piece}>"])
    return map_batches(source, schema, work)


def _collect(chunk, runs, flags, hits, rows) -> None:
    edge = np.ones(len(flags), dtype=bool)
    edge[1:] = runs.owner[1:] != runs.owner[:-1]
    before = np.concatenate([[False], flags[:-1]])
    starts = np.flatnonzero(flags & (edge | ~before))
    after = np.concatenate([flags[1:], [False]])
    ends = np.flatnonzero(flags & (np.append(edge[1:], True) | ~after)) + 1
    at = np.concatenate([a for a, _ in hits])
    tokens = np.concatenate([t for _, t in hits])
    order = np.argsort(at, kind="stable")
    at, tokens = at[order], tokens[order]
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    for i, (a, b) in enumerate(zip(starts, ends)):
        text = runs.owner[a]
        base = runs.first[text]
        body = words.LOWER[chunk.data[runs.starts[a] : runs.ends[b - 1]]].tobytes()
        shift = runs.starts[a]
        rows[text].append({
            "at": int(a - base),
            "words": [body[s - shift : e - shift].decode("utf-8", "replace") for s, e in zip(runs.starts[a:b], runs.ends[a:b])],
            "places": (at[low[i] : high[i]] - base).tolist(),
            "tokens": tokens[low[i] : high[i]].tolist(),
        })


def contamination(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """`keep`, n_words, n_hit, n_items, items_sha256, contaminated: one row per document.

    Words are runs of ASCII letters and digits (lower-cased) and of any characters beyond
    ASCII. A word is hit if it stands inside an occurrence of a window of any item. A null
    or empty text has no words and is clean; an empty benchmark leaves all clean; an item
    without an id hits words but is not listed; repeated rows get a row each; an empty table
    gives an empty one; a kept column named as a result comes back with `_in` behind its name.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    docs, text = numbered(docs, keep, _body=F.col(f"`{text}`")), "_body"
    windows = cut_lineage(benchmark_windows(items, item_id, item_text))
    bitmap, widths = token_filter(windows)
    slim = cut_lineage(passages(docs, bitmap, widths, names, text).withColumn("_row", F.monotonically_increasing_id()))
    pieces = slim.filter(F.size("found") > 0).select("_row", F.explode("found").alias("p")).select("_row", "p.*")

    unique = windows.dropDuplicates(["window"]).select("window", "words", "offsets", "tokens")
    tokens = pieces.select(
        "_row", "at", (F.col("at") + F.size("words")).alias("until"), F.explode(F.arrays_zip("places", "tokens")).alias("t")
    ).select("_row", "at", "until", F.col("t.places").alias("place"), F.col("t.tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("often"))
    own = unique.select("window", F.explode(F.arrays_zip("offsets", "tokens")).alias("t")).select(
        "window", F.col("t.offsets").alias("offset"), F.col("t.tokens").alias("token")
    )
    # A window with a shingle that no document has cannot occur.
    prefix = (
        own.join(rarity, "token", "left")
        .groupBy("window")
        .agg(
            F.min(F.coalesce("often", F.lit(0))).alias("often"),
            F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("often", F.lit(0)), "token", "offset")).alias("rarest"),
        )
        .filter("often > 0")
        .join(unique.select("window", F.col("words").alias("wanted")), "window")
        .select("window", "wanted", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
    )
    start = F.col("place") - F.col("offset")
    candidates = (
        tokens.join(prefix, "token")
        .withColumn("start", start)
        .filter((F.col("start") >= F.col("at")) & (F.col("start") + F.size("wanted") <= F.col("until")))
        .select("_row", "at", "start", "window", "wanted")
    )
    hits = cut_lineage(
        candidates.join(pieces.select("_row", "at", "words"), ["_row", "at"])
        .filter(F.slice("words", F.col("start") - F.col("at") + 1, F.size("wanted")) == F.col("wanted"))
        .select("_row", "start", (F.col("start") + F.size("wanted")).alias("end"), "window")
    )
    earlier = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("_row", "start", "end").distinct()
        .withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
        .groupBy("_row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).cast("long").alias("n_hit"))
    )
    of_items = (
        hits.select("_row", "window").distinct()
        .join(windows.select("window", F.col("item").cast("string").alias("item")).distinct(), "window")
        .groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    results = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return (
        slim.drop("found").join(covered, "_row", "left").join(of_items, "_row", "left")
        .select(
            *names, "n_words", hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
            ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        )
        .toDF(*kept_names(keep, results), *results)
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without contaminated documents; rows that share an id are judged one by one."""
    content = F.xxhash64(raw(text))
    keyed = docs.select(F.col(id_col).alias("_id"), content.alias("_content"), F.col(text).alias("_text"))
    bad = contamination(keyed, items, ["_id", "_content"], "_text").filter("contaminated").select("_id", "_content").distinct()
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("b._id")) & (content_of("d", text) == F.col("b._content"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def content_of(side: str, text: str):
    return F.xxhash64(raw(F.col(f"{side}.{text}")))
