"""Periodic runs against plain definitions."""

import hashlib
import zlib

import numpy as np
import pytest

from featmart.llm import periodic
from featmart.llm.queries import PLANS
from featmart.llm.tables import table


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words):
    """Stretches in which words q apart are equal, for every q."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeat(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def random_words(rng):
    out = []
    for _ in range(int(rng.integers(1, 6))):
        q, size = int(rng.integers(1, 9)), int(rng.integers(0, 120))
        unit = [str(w) for w in rng.integers(0, rng.integers(1, 4) + 1, q)]
        out += (unit * (size // q + 1))[:size]
        out += [str(w) for w in rng.integers(0, 3, int(rng.integers(0, 30)))]
    return out


def test_runs_of_random_words():
    rng = np.random.default_rng(3)
    texts = [random_words(rng) for _ in range(400)] + [[], ["x"] * 23, ["x"] * 24, ["a", "b"] * 12, ["a"] * 500]
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = np.array([names[w] for t in texts for w in t])
    found = [[] for _ in texts]
    for t, s, length, q in zip(*(x.tolist() for x in periodic.runs_of(codes, first))):
        found[t].append((s, length, q))
    assert found == [plain_runs(t) for t in texts]
    assert sum(map(len, found)) > 500


def test_blocks_of_points(monkeypatch):
    """Grids are cut anywhere."""
    monkeypatch.setattr(periodic, "POINTS", 7)
    test_runs_of_random_words()


def test_extension_equals_a_plain_one():
    rng = np.random.default_rng(8)
    sizes = [1, 40, 400, 13, 200]
    codes = np.concatenate([np.tile(rng.integers(1, 3, max(1, s // 7)), 8)[:s] for s in sizes])
    bounds = np.concatenate([[0], np.cumsum([min(s, 8 * max(1, s // 7)) for s in sizes])])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    one, two = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b):
            for j in range(i + 1, b, 3):
                one.append(i)
                two.append(j)
    got = periodic.Extension(codes, ends).common(np.array(one), np.array(two))
    for i, j, n in zip(one, two, got):
        want = 0
        while j + want < ends[j] and codes[i + want] == codes[j + want]:
            want += 1
        assert n == want


@pytest.mark.parametrize("v", range(periodic.V))
def test_cover(v):
    assert all(periodic.SAMPLED[(v + periodic.SHIFT[v, w]) % periodic.V] and periodic.SAMPLED[(w + periodic.SHIFT[v, w]) % periodic.V] for w in range(periodic.V))


def test_query_over_documents(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in PLANS["op12_periodic_runs"](spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for row in docs:
        words = repeat([w.decode() for w in (row.text or "").encode().split()], row.doc_id)
        if len(words) > 3000:
            continue
        runs = plain_runs(words)
        best = None
        for s, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())
        assert got[row.doc_id] == want + digests, row.doc_id


def test_odd_rows(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(200_000))
    rows = [(1, None, "k"), (2, "", "k"), (3, " \t\n\x0b\x0c\r ", "k"), (4, "é x " * 30, "k"), (4, "é x " * 30, "k"), (5, long, "k"), (None, "a b " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    out = periodic.find(docs, ["doc_id", "start"])
    assert out.columns == ["doc_id", "start", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.start, r.n_words, [tuple(x) for x in r.runs], r.collapsed if r.doc_id != 5 else len(r.collapsed.split())) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "k", 0, [], ""), (2, "k", 0, [], ""), (3, "k", 0, [], ""),
        (4, "k", 30, [(0, 30, 1)], "é x"), (4, "k", 30, [(0, 30, 1)], "é x"),
        (5, "k", 200_000, [(0, 200_000, 50_000)], 50_000), (None, None, 40, [(0, 40, 2)], "a b"),
    ], key=str)
    assert periodic.find(docs.filter("false"), ["doc_id"]).count() == 0
    assert periodic.find(docs.withColumnRenamed("start", "Runs"), ["Runs"]).columns == ["Runs_in", "n_words", "runs", "collapsed"]
