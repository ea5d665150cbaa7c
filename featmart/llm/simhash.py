"""Near-duplicate classes by SimHash fingerprints, found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints that
differ in at most 2 bits have, by the pigeonhole principle, a segment without errors whose
cyclic successor has at most one: so they share (that segment, a Golay index of the
successor), because words within 2 bits of each other share the index of a codeword within
4 bits of both. A fingerprint has 3 exact segments and 1 or 6 indices for each, about 16
keys; fingerprints that share a key are compared.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm import golay
from featmart.llm.components import components
from featmart.llm.tables import kept_names, map_batches, numbered, raw
from featmart.session import cut_lineage

SEED = 42
#: (first bit, width) of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints differing in at most this many bits are linked; the keys are built for it.
RADIUS = 2
#: A key shared by more fingerprints than this is searched by midpoints instead of pairs.
PAIRED = 64
#: Shingles hashed at a time, whatever the length of a text.
STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, as an unsigned integer.

    Words are separated by white space (space and \\x09-\\x0D); repeats count. A text of
    fewer words than `width` is one shingle; without words the fingerprint is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, total, STEP):
        part = words[low : low + STEP + width - 1]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(gram), seed) for gram in zip(*(part[j:] for j in range(width)))),
            dtype=np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint's bits as a signed long."""
    source = docs.select(*[F.col(f"`{c}`").alias(c) for c in keep], raw(text).alias("_text"))
    kinds = dict(source.dtypes)

    def work(batch):
        found = [fingerprint(t, width) for t in batch.column("_text").to_pylist()]
        return {c: batch.column(c) for c in keep} | {"fp": np.array(found, dtype=np.uint64).view(np.int64)}

    return map_batches(source, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp bigint", work)


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All fuzzy keys of signed fingerprints: (keys, number of keys of each)."""
    words = fps.view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    owner, keys = [], []
    for i, exact in enumerate(parts):
        near, count = golay.near_indices(parts[(i + 1) % len(parts)])
        who = np.repeat(np.arange(len(words)), count)
        owner.append(who)
        keys.append((i << 35) | (exact[who] << 12) | near)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(fp, key), one row for each key of each fingerprint."""

    def work(batch):
        fp = batch.column("fp").to_numpy()
        keys, count = segment_keys(np.ascontiguousarray(fp))
        return {"fp": np.repeat(fp, count), "key": keys}

    return map_batches(fps.select("fp"), "fp bigint, key bigint", work)


def close_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within RADIUS bits.

    `fps` holds different fingerprints. Keys shared by few compare all their pairs. Those
    shared by many, such as a large group of near copies, are searched exactly without
    pairs: two fingerprints within 2 bits share a word within 1 bit of both, a word has at
    most 65 such neighbours, and each word links its neighbours to the smallest of them.
    """
    keys = cut_lineage(fuzzy_keys(fps))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(keys.join(sizes, "key"))
    few = shared.filter(F.col("n") <= PAIRED)
    one, two = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    paired = (
        one.join(two, "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(f).cast("long") for f in _single_bits()])
    middles = (
        shared.filter(F.col("n") > PAIRED)
        .select("fp").distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    )
    low = middles.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    starred = low.select("a", F.explode("all").alias("b")).filter("a <> b")
    return paired.unionByName(starred)


def _single_bits() -> list[int]:
    return [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, `extra` columns, `fp` (signed), `component_id`, and
    `class_fp`, the smallest fingerprint of its class.

    `component_id` is the smallest id among all documents reachable over links between
    fingerprints. Copies collapse to one fingerprint before anything is compared, so a
    group of copies of any size costs one row. A null text has no words (fingerprint zero,
    linked like any other); rows that share an id each get their own row; a null id takes
    part but never names a class unless all ids of the class are null. An empty table
    gives no rows; texts are read whole. An id or extra column named as a result comes back
    with `_in` behind its name.
    """
    keep = [id_col, *extra]
    names = [f"_k{i}" for i in range(len(keep))]
    bare = numbered(docs, keep, _body=F.col(f"`{text}`"))
    slim = cut_lineage(fingerprints(bare, names, "_body", width))
    unique = cut_lineage(slim.groupBy("fp").agg(F.min("_k0").alias("low")))
    roots = components(close_pairs(unique)).withColumnRenamed("node", "fp")
    rooted = unique.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(
        rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root")
        .select("fp", "component_id", F.col("root").alias("class_fp"))
    )
    results = ("fp", "component_id", "class_fp")
    return slim.join(named, "fp").select(*names, *results).toDF(*kept_names(keep, results), *results)


def fingerprint_text(fp: str = "fp"):
    """16 lower-case hexadecimal digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest id.

    Of rows that share the smallest id, the one with the smallest content hash stays; of
    rows equal in id and text, one. Rows with a null id come after all others. Texts move
    only in the join with the rows that stay.
    """
    content = F.xxhash64(raw(text))
    classes = cut_lineage(near_classes(docs.withColumn("_content", content), id_col, text, width, extra=("_content",)))
    return keep_first(docs, classes, "class_fp", id_col, text)


def keep_first(docs: DataFrame, classes: DataFrame, class_col: str, id_col: str, text: str) -> DataFrame:
    """`docs` with the first row of each class; `classes` has a row (`id_col`, `_content`,
    `class_col`) for each row of `docs`, `_content` being the hash of its text.

    The columns of `docs` may have any names: they are numbered on the way.
    """
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    own = next(n for n, c in zip(names, docs.columns) if c == id_col)
    body = next(n for n, c in zip(names, docs.columns) if c == text)
    order = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col("_content").alias("content"))
    first = classes.groupBy(class_col).agg(F.min(order).alias("first"))
    keep = first.select(F.col("first.id").alias("_keep"), F.col("first.content").alias("_keep_content"))
    stay = (
        docs.toDF(*names).withColumn("_hash", F.xxhash64(raw(body)))
        .join(keep, F.col(own).eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_keep_content")), "left_semi")
    )
    repeated = classes.groupBy(id_col, "_content").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([own, "_hash"])
    return stay.select(*names).toDF(*docs.columns)
