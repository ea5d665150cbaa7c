"""Classes by shingle sets against brute-force Jaccard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featmart.llm import near_sets
from featmart.llm.near_sets import shingle_set


def brute(rows):
    """Rows that stay, by comparing all pairs of sets."""
    sets = [shingle_set((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                root[find(i)] = find(j)
    first = {}
    for i, (key, _) in enumerate(rows):
        order = (key is None, key)
        if find(i) not in first or order < first[find(i)]:
            first[find(i)] = order
    return sorted((k[1] for k in first.values()), key=str)


def kept(spark, rows, stage=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((r["doc_id"] for r in (stage or near_sets.drop_near_copies)(docs).collect()), key=str)


def edited(rng, base, changes):
    out = list(base)
    for at in rng.choice(len(base), changes, replace=False):
        out[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(out)


def test_stage_finds_all_pairs_of_documents(spark):
    """At scale 0.01 two bits of SimHash find none of the pairs of different texts."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("sampled", [1 << 14, 3])
def test_edits_chains_boilerplate_and_odd_texts(spark, monkeypatch, sampled):
    monkeypatch.setattr(near_sets, "SAMPLED", sampled)
    rng = np.random.default_rng(5)
    line = " ".join(f"b{i}" for i in range(30))
    rows, key = [], 0
    for _ in range(6):
        base = [f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for changes in (0, 0, 1, 2, 3, 4, 6, 9, 12):
            rows.append((key, f"{line} {edited(rng, base, min(changes, len(base)))}".upper() if key % 4 else edited(rng, base, changes)))
            key += 1
    chain = [f"c{i}" for i in range(300)]
    rows += [(1000 + i, " ".join(chain[8 * i : 8 * i + 100])) for i in range(20)]
    rows += [(2000 + n, " ".join(f"s{i}" for i in range(n))) for n in range(1, 14)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One  two"), (3004, "one TWO"), (None, "one two"), (None, "only here")]
    rows += [(3010, "x " * 50_000), (3011, "x x x x x x")]
    assert kept(spark, rows) == brute(rows)
    assert kept(spark, []) == []


def test_places_lose_no_pair(spark):
    """A place's size and share are bounds of the true ones."""
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100_000, 4000)
    at = (rng.random(4000) * (size - (80 * size + 99) // 100 + 1)).astype(np.int64)
    place = near_sets._places(size, at, 80)
    low = near_sets.STEP ** (place >> 6).astype(float)
    assert (low <= size * 1.00001).all() and (size <= low * near_sets.STEP * 1.00001).all()
    rest = low * near_sets.STEP * (1 - (place & near_sets.SHARES) * 20 / (100 * near_sets.SHARES))
    assert (rest * 1.0001 >= size - at).all()


def test_clashing_columns(spark):
    rows = [(1, "one two three", "a", 1, "x"), (2, "one two three", "b", 2, "y"), (3, "other", None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _content string, node int, _id string")
    out = near_sets.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_sketches_rule_out_no_similar_pair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, pairs = [], []
    for i in range(0, 120, 2):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 900)))]
        rows += [(i, " ".join(base)), (i + 1, edited(rng, base, int(len(base) * rng.random() * 0.1)))]
        pairs += [(i, i + 1), (i, (i + 7) % 120)]
    rows += [(200, "x " * 3000 + "y z"), (201, "x " * 2000 + "y z"), (202, " ".join(f"v{i}" for i in range(120_000)))]
    pairs += [(200, 201), (202, 202)]
    docs = spark.createDataFrame(rows, "node bigint, text string")
    wanted = docs.select("node", F.xxhash64(F.col("text").cast("binary")).alias("content"))
    texts = near_sets._texts(docs, wanted, "text", near_sets.WIDTH)
    # Each pair is a list of its own, and all nodes are one more, cut into blocks.
    place = {n: int(near_sets._places(np.array([len(shingle_set(t.encode()))]), np.array([0]), 80)[0]) for n, t in rows}
    lists = [(k, n, place[n], n) for k, p in enumerate(pairs) for n in set(p)] + [(-1, n, place[n], n) for n, _ in rows]
    monkeypatch.setattr(near_sets, "BLOCK", 16)
    table = spark.createDataFrame(lists, "token bigint, node bigint, place int, root bigint")
    got = {tuple(r) for r in near_sets._block_pairs(table, texts, 80).collect()}
    sets = {n: shingle_set(t.encode()) for n, t in rows}
    every = {(a, b) for a in sets for b in sets if a < b}
    assert {p for p in every if near_sets.similar(sets[p[0]], sets[p[1]])} <= got and len(got) < 200


def test_fingerprints_propose_pairs(spark, monkeypatch):
    """The stage's SimHash step finds close texts by itself; the exact join finds them all."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 2000)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(f"v{i}" for i in rng.integers(0, 10_000, 2000)), "a b", "", "  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "_id bigint, _text string").withColumn("_content", F.xxhash64(F.col("_text").cast("binary")))
    slim = near_sets.text_nodes(docs, ["_id", "_content"], "_text").cache()
    node = {r["_id"]: r["node"] for r in slim.collect()}
    assert {(r["a"], r["b"]) for r in near_sets.fingerprint_pairs(slim).collect()} == {tuple(sorted((node[0], node[1])))}
    monkeypatch.setattr(near_sets, "_pairs", lambda lists, *_: lists.selectExpr("node AS a", "node AS b").filter("false"))
    monkeypatch.setattr(near_sets, "_across", lambda lists, *_: lists.filter("false"))
    assert kept(spark, rows) == [0, 2, 3, 4]


def test_later_edges_join_classes_that_stand_as_their_roots(spark, monkeypatch):
    """The components of the first pairs are not found again with those of the rest."""
    rng = np.random.default_rng(8)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))]
    later = [(int(a), int(b)) for a, b in rng.integers(0, 400, (60, 2))]
    one, two = (spark.createDataFrame(p, "a bigint, b bigint") for p in (first, later))
    seen, own = [], near_sets.components
    monkeypatch.setattr(near_sets, "components", lambda edges: seen.append(edges.count()) or own(edges))
    got = {tuple(r) for r in near_sets.joined_roots(own(one), two).collect()}
    assert got == {tuple(r) for r in own(one.unionByName(two)).collect()}
    assert seen == [len(later)]
    assert {tuple(r) for r in near_sets.joined_roots(own(one), two.filter("false")).collect()} == {tuple(r) for r in own(one).collect()}
