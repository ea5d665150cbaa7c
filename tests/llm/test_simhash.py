"""Near-duplicate classes against brute force, and the code behind the keys."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featmart.llm import golay, simhash
from featmart.llm.components import _large_star, _small_star, components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    """{row index: (fingerprint, smallest reachable id)} by comparing everything."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return sorted(((rows[i][0], f"{prints[i]:016x}", low.get(find(i))) for i in range(len(rows))), key=str)


def classes(spark, rows, **more):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, fp string").repartition(3)
    out = simhash.near_classes(docs, **more).select("doc_id", simhash.fingerprint_text().alias("f"), "component_id")
    return sorted(map(tuple, out.collect()), key=str)


def test_code_is_perfect_and_near_words_share_an_index():
    rng = np.random.default_rng(1)
    assert len(np.unique(golay.LEADER)) == 2048
    words = rng.integers(0, 1 << 23, 300)
    near, count = golay.near_indices(words)
    sets = np.split(near, np.cumsum(count)[:-1])
    assert set(count) <= {1, 6}
    for word, mine in zip(words, sets):
        for i in range(23):
            for j in range(i, 23):
                other = word ^ (1 << i) ^ (1 << j)
                theirs, _ = golay.near_indices(np.array([other]))
                assert set(mine) & set(theirs)


def test_keys_of_fingerprints_within_two_bits_meet():
    rng = np.random.default_rng(2)
    for word in rng.integers(0, 1 << 63, 6, dtype=np.int64):
        others = [word ^ np.int64((1 << i) - (1 << 64 if i == 63 else 0)) ^ np.int64((1 << j) - (1 << 64 if j == 63 else 0))
                  for i in range(64) for j in range(i)]
        keys, count = simhash.segment_keys(np.array([word, *others]))
        sets = np.split(keys, np.cumsum(count)[:-1])
        assert all(set(sets[0]) & set(s) for s in sets[1:])


def test_classes_equal_brute_force_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert classes(spark, rows) == brute(rows)


@pytest.mark.parametrize("paired", [64, 2])
def test_near_copies_nulls_empty_long_and_repeated(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 4000)]
    rows = [(i, " ".join(base[: 3998 + i % 3])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One  TWO"), (104, "one two"), (104, "one two"),
             (None, "one two"), (105, "É é x y z"), (106, "é é x y z"), (None, "lonely row here now")]
    rows += [(200, "long " * 300_000)]
    assert classes(spark, rows) == brute(rows)


def test_empty_table_and_one_of_each_class(spark):
    assert classes(spark, []) == []
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "q r s t u"), (None, "z z y"), (None, "z z y"), (3, "other words here")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, component_id int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(
        [(3, "a b c d"), (9, "q r s t u"), (None, "z z y"), (3, "other words here")], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(7, 7), (500, 500)]
    df = spark.createDataFrame(edges, "a int, b int").select(F.col("a"), F.col("b"))
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(150)}}


def test_a_round_of_components_reads_its_edges_four_times(spark):
    """The driver keeps account of every task: a round derives nothing more often than it must."""
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a bigint, b bigint")
    plan = _small_star(_large_star(links))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 4 and "Union" not in plan
