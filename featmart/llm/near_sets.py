"""Near-duplicate classes by the Jaccard similarity of word shingles, found without loss.

SimHash fingerprints of the same shingles propose pairs within two bits, by the Golay keys of
`simhash`; they are checked on their texts. Most similar texts are further apart, so an exact
join of the shingle sets finds what the fingerprints miss.

Each text is the set of its shingles. Under one order of all shingles, two sets of
similarity s or more share their first common shingle within the first
n - ceil(s n) + 1 of both: those prefixes are the index, and every pair that meets there is
checked on its texts. The order puts shingles that are common in a sample last; it decides
how many pairs are checked, never which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm import words
from featmart.llm.components import components
from featmart.llm.simhash import close_pairs, fingerprint, keep_first
from featmart.llm.tables import map_batches, raw, written
from featmart.session import cut_lineage

#: Words of a shingle, and the percentage of similarity from which on two texts are linked.
WIDTH, PERCENT = 5, 80
#: Different texts whose shingles are counted for the order, about, and common ones kept.
SAMPLED, COMMON = 1 << 16, 1 << 20
#: Counters, of a byte each, by which pairs are ruled out before their texts are read.
COUNTERS = 256
#: Shingles that a task keeps for texts of several pairs.
HELD = 1 << 18
#: The filter for texts that pairs need has 2^FILTER_BITS bits (4 MB) for any number of them:
#: a fuller filter only lets more texts through to the join.
FILTER_BITS = 25
#: Members of a list that are compared with as many in one step.
BLOCK = 512
#: A place is 16 bits: ten for the size, as a power of STEP, and six for the share of the
#: prefix that lies before it. Both are rounded so that no pair is lost.
STEP, SHARES = 1.02, 63


def shingle_set(text: bytes, width: int = WIDTH) -> frozenset[bytes]:
    """Shingles of the lower-cased (A-Z) text; fewer words than `width` are one shingle."""
    found = text.lower().split()
    return frozenset(b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def similar(one: frozenset, two: frozenset, percent: int = PERCENT) -> bool:
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both)


def _tokens(chunk: words.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each different shingle of texts that have `width` words."""
    runs = chunk.runs(words.NOT_SPACE)
    at, tokens = runs.shingles(runs.hashes(lower=True), width)
    owner, tokens = runs.owner[at], tokens.view(np.int64)
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
    return owner[new], tokens[new]


def common_tokens(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles of a sample, and their counts."""
    step = max(1, -(-docs.count() // SAMPLED))
    sample = (
        docs.select(raw(text).alias("_text")).withColumn("_content", F.xxhash64("_text"))
        .filter(F.pmod("_content", F.lit(step)) == 0).dropDuplicates(["_content"]).select("_text")
    )

    def work(batch):
        return {"token": np.concatenate([_tokens(c, width)[1] for c in words.chunks(batch.column("_text"))])}

    counts = map_batches(sample, "token bigint", work).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).select("token", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    tokens, n = (top.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _nodes(texts: pa.Array) -> np.ndarray:
    """Hashes of the texts' words: equal words are one node."""
    found = [xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in texts.to_pylist()]
    return np.array(found, dtype=np.uint64).view(np.int64)


def text_nodes(docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """`keep`, `node`, a hash of the text's words, and `fp`, the SimHash of its shingles."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], raw(text).alias("_text"))
    kinds = dict(source.dtypes)

    def work(batch):
        found = np.array([fingerprint(t, width) for t in batch.column("_text").to_pylist()], dtype=np.uint64)
        return {c: batch.column(c) for c in keep} | {"node": _nodes(batch.column("_text")), "fp": found.view(np.int64)}

    return map_batches(source, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["node bigint", "fp bigint"]), work)


def fingerprint_pairs(slim: DataFrame) -> DataFrame:
    """Pairs (a, b) of different nodes that the fingerprints propose: those of one fingerprint
    with the smallest of them, and these smallest ones of two fingerprints that are close.

    `slim` has `node` and `fp`; copies count once.
    """
    nodes = cut_lineage(slim.select("node", "fp").distinct())
    unique = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    same = nodes.join(unique, "fp").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    close = (
        close_pairs(unique.select("fp"))
        .join(unique.select(F.col("fp").alias("a"), F.col("low").alias("one")), "a")
        .join(unique.select(F.col("fp").alias("b"), F.col("low").alias("two")), "b")
    )
    return same.unionByName(close.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))).distinct()


def _places(size: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    step = np.minimum(np.floor(np.log(size) / np.log(STEP) + 1e-9), 1023).astype(np.int64)
    share = np.floor(SHARES * 100 * at / np.maximum((100 - percent) * size, 1)).astype(np.int64)
    return (step << 6) | np.minimum(share, SHARES)


def index(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`token`, `place`, `node`: the first shingles of each text in the common order, by 48
    bits of their hash; where they stand; and a hash of the text's words.

    Texts of fewer than `width` words have none: only equal words are similar to them.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, text, width))

    def work(batch):
        known, often = common.value
        keys, sizes = [], []
        for chunk in words.chunks(batch.column("_text")):
            owner, tokens = _tokens(chunk, width)
            rank = np.zeros(len(tokens), dtype=np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                rank = np.where(known[place] == tokens, often[place], 0)
            order = np.lexsort((tokens, rank, owner))
            size = np.bincount(owner, minlength=chunk.texts)
            length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            first = at < np.repeat(length, size)
            place = _places(np.repeat(size, size)[first], at[first], percent)
            keys.append((tokens[order][first] & ~np.int64(0xFFFF)) | place)
            sizes.append(length)
        return {"key": np.concatenate(keys), "node": np.repeat(_nodes(batch.column("_text")), np.concatenate(sizes))}

    rows = map_batches(docs.select(raw(text).alias("_text")), "key bigint, node bigint", work)
    return rows.select(F.shiftright("key", 16).alias("token"), F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("place"), "node")


def _reach(one: str, two: str, percent: int) -> Column:
    """Whether two sets can be similar whose first common shingle stands at these places."""
    sizes = [F.pow(F.lit(STEP), F.shiftright(place, 6)) for place in (one, two)]
    shares = [1 - F.col(place).bitwiseAND(F.lit(SHARES)) * ((100 - percent) / (100 * SHARES)) for place in (one, two)]
    rest = [size * STEP * share for size, share in zip(sizes, shares)]
    return (100 + percent) * 1.0001 * F.least(*rest) >= percent * (sizes[0] + sizes[1])


def _known(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the column `content`, put together by aggregation in pieces of 4 KB."""
    place = F.col("content").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    pieces = (
        hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    bitmap = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    step = (1 << 15) // 8
    # At most 4 MB, in one job: an iterator would run one for each shuffle partition.
    found = pieces.toArrow()
    for k, bits in zip(found.column("k").to_pylist(), found.column("bits").to_pylist()):
        bitmap[(k - 1) * step : k * step] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def _texts(docs: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame:
    """`node`, `sketch` and `_text` of the nodes of `wanted` (node, content). Texts move to
    the join only if the filter knows their hash.

    A sketch counts the text's shingles by their hash; counts end at 255.
    """
    known = docs.sparkSession.sparkContext.broadcast(_known(wanted))

    def work(batch):
        slot = batch.column("content").to_numpy() & ((1 << FILTER_BITS) - 1)
        near = (known.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        keep = pa.array(near)
        if not near.any():
            return None
        body, sketches = batch.column("_text").filter(keep), []
        for chunk in words.chunks(body):
            owner, tokens = _tokens(chunk, width)
            slot = (words.mix(tokens.view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)
            counts = np.bincount(owner * COUNTERS + slot, minlength=chunk.texts * COUNTERS)
            sketches += [c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8).reshape(-1, COUNTERS)]
        return {"_text": body, "content": batch.column("content").filter(keep), "sketch": sketches}

    hashed = docs.select(raw(text).alias("_text")).withColumn("content", F.xxhash64("_text"))
    found = map_batches(hashed, "_text binary, content bigint, sketch binary", work)
    return found.join(wanted, "content").dropDuplicates(["node"]).select("node", "sketch", "_text")


def _block_pairs(lists: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list's members in different components that can be similar.

    Lists are cut into blocks, and every two blocks of a list are compared by one step in
    arrays: pairs become rows only if neither places nor counters rule them out. Two sets
    differ in at least as many shingles as their counters do.
    """
    size = Window.partitionBy("token")
    cut = (
        lists.join(texts.select("node", "sketch"), "node")
        .withColumn("blocks", F.ceil(F.count("*").over(size) / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    dealt = cut.select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "place", "sketch"
    ).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        own, node, root, place = (np.array(c, dtype=np.int64) for c in zip(*(r[:4] for r in rows)))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(-1, COUNTERS).astype(np.int16)
        low = STEP ** (place >> 6).astype(float)
        rest = low * STEP * (1 - (place & SHARES) * ((100 - percent) / (100 * SHARES)))
        total, full = sketch.sum(axis=1, dtype=np.int64), (sketch == 255).any(axis=1)
        first = np.flatnonzero(own == own.min())
        ones, twos = [], []
        for x in first:
            # Within one block each pair once; across two, those of the first with all of the second.
            ys = np.flatnonzero(own != own[x]) if own.min() != own.max() else np.arange(x + 1, len(own))
            reach = (100 + percent) * 1.0001 * np.minimum(rest[x], rest[ys]) >= percent * (low[x] + low[ys])
            ys = ys[reach & (root[ys] != root[x])]
            apart = np.abs(sketch[ys] - sketch[x]).sum(axis=1, dtype=np.int64)
            both = (total[ys] + total[x] - apart) // 2
            ys = ys[full[ys] | full[x] | (100 * both >= percent * (both + apart))]
            ones.append(np.minimum(node[x], node[ys]))
            twos.append(np.maximum(node[x], node[ys]))
        return np.concatenate(ones), np.concatenate(twos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("token", "i", "j", "own", "node", "root", "place", "sketch")]
            for row in zip(*columns):
                if row[:3] != key:
                    if len(held) > 1:
                        yield _pair_batch(*compare(held))
                    key, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield _pair_batch(*compare(held))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _pair_batch(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])


def texts_of(nodes: DataFrame, slim: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """A text and its sketch for each of the nodes; `slim` has the node and the text's hash,
    `_content`, of each row."""
    wanted = slim.join(nodes.distinct(), "node").groupBy("node").agg(F.min("_content").alias("content"))
    return written(_texts(docs, written(wanted, "near-nodes"), text, width), "near-texts")


def checked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar."""
    sides = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("one")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("_text").alias("two")), "b")
    )

    def work(batch):
        ones, twos = batch.column("one").to_pylist(), batch.column("two").to_pylist()
        memo: dict[bytes, frozenset] = {}
        held = 0

        def set_of(text: bytes) -> frozenset:
            nonlocal held
            if text not in memo:
                if held > HELD:
                    memo.clear()
                    held = 0
                memo[text] = shingle_set(text, width)
                held += len(memo[text])
            return memo[text]

        near = pa.array([similar(set_of(x), set_of(y), percent) for x, y in zip(ones, twos)], pa.bool_())
        return {c: batch.column(c).filter(near) for c in ("a", "b")}

    return cut_lineage(map_batches(sides.select("a", "b", "one", "two"), "a bigint, b bigint", work))


def _pairs(lists: DataFrame, centre: str, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's members and its centre that can be similar."""
    own, middle = F.col("node"), F.col(f"{centre}.node")
    found = lists.withColumn("_place", F.col(f"{centre}.place")).filter((own != middle) & _reach("place", "_place", percent))
    return found.select(F.least(own, middle).alias("a"), F.greatest(own, middle).alias("b")).distinct()


def near_roots(slim: DataFrame, docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, root) for every node that has a similar one, root being the smallest node that
    is reachable over pairs of similar nodes.

    Pairs that the fingerprints propose are checked with the first pairs of the index. The
    index moves once, and only shingles of two nodes or more are written. Members of a
    shingle's list are checked against its centre first, the member that shares most: copies
    of one text meet it in all their lists, even where they are not similar to each other.
    Lists that then lie in one component need no pairs; in the others members of different
    components are compared, the centre left out, as its pairs are done.
    """
    lists = Window.partitionBy("token")
    several = index(docs, text, width, percent).select(
        "*", F.min("node").over(lists).alias("low"), F.max("node").over(lists).alias("high")
    ).filter("low <> high")
    # Copies of a text and repeated shingle hashes count once.
    members = several.groupBy("token", "node").agg(F.min("place").alias("place"))
    members = written(members.withColumn("n", F.count("*").over(lists)), "near-lists")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = F.max(F.struct("weight", "node", "place")).over(lists)
    centred = written(members.join(weights, "node").withColumn("centre", centre).drop("weight", "n"), "near-centred")
    # Pairs are few bytes and much work: their number of tasks is not left to their size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    proposed = fingerprint_pairs(slim).unionByName(_pairs(centred, "centre", percent)).distinct()
    pairs = cut_lineage(proposed.repartition(tasks, "a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    links = checked(pairs, texts_of(nodes, slim, docs, text, width), width, percent)
    roots = components(links)
    left = _across(centred.filter(F.col("node") != F.col("centre.node")), roots)
    if left.isEmpty():
        return roots
    texts = texts_of(left.select("node"), slim, docs, text, width)
    rest = cut_lineage(_block_pairs(left, texts, percent).repartition(tasks, "a", "b"))
    return joined_roots(roots, checked(rest, texts, width, percent))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components `roots` after further edges (a, b): each stands as its root in the rounds,
    so that edges which are joined already take part in none."""
    first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b"))
    ends = links.join(first, "a", "left").join(second, "b", "left")
    upper = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    single = upper.join(roots, "node", "left_anti")
    return moved.select("node", F.coalesce("_top", "root").alias("root")).unionByName(single.select("node", "root"))


def _across(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are of several components, with each member's `root`."""
    placed = lists.select("token", "node", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = Window.partitionBy("token")
    mixed = placed.withColumns({"_r1": F.min("root").over(same), "_r2": F.max("root").over(same)}).filter("_r1 <> _r2")
    return written(mixed.select("token", "node", "place", "root"), "near-lists")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """`docs` with one document of each class, that of the smallest id.

    A class is all that is reachable over pairs of texts whose shingle sets have at least
    `percent` of their union in common. Texts without words form one class. Rows that share
    an id or have none are treated as in `simhash.drop_near_copies`.
    """
    # Only these two columns are read, under names of their own: others may have any name.
    bare = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    keyed = bare.withColumn("_content", F.xxhash64(raw("_text")))
    slim = written(text_nodes(keyed, ["_id", "_content"], "_text", width), "near-nodes")
    roots = near_roots(slim, bare, "_text", width, percent)
    classes = written(slim.join(roots, "node", "left").select("_id", "_content", F.coalesce("root", "node").alias("class")), "near-classes")
    return keep_first(docs, classes.withColumnRenamed("_id", id_col), "class", id_col, text)
