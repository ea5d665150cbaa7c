"""Contamination against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from featmart.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        found = words_of(text)
        size = min(13, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        found, hit, names = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                owners = windows.get(tuple(found[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    names |= owners
        names = sorted(str(n) for n in names if n is not None)
        out.append((key, len(found), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


def run(spark, docs, items, width=2):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, n_hit int").repartition(width)
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, window string")
    return sorted(map(tuple, decontaminate.contamination(d, b, ["doc_id"]).collect()), key=str)


def test_documents_equal_plain(spark, sf):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    got = sorted(map(tuple, queries.PLANS["op7_benchmark_decontamination"](spark, sf).collect()), key=str)
    assert got == plain(docs, items)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("bits", [25, 15])
def test_odd_texts_and_items(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    line = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(line[:30])), (2, " ".join(line[20:45])), (3, "short item here"), (4, "One"), (5, None), (6, " ,;"),
             (7, " ".join(line[:13])), (8, " ".join(line[:9])), (None, "no id at all"), (1, "Café é語 x"), (10, "aa bb " * 12), (4, "one")]
    docs = [(1, " ".join(line)), (2, " ".join(line[:12])), (3, "a SHORT, item: here! short item"), (4, "nothing of it"), (5, None),
            (6, ""), (7, "- ; -"), (8, "x " * 400 + " ".join(line[10:25]) + " y" * 20), (9, "one"), (10, "no id at all really"),
            (None, "café É語 x"), (9, "one"), (11, "café é語 x"), (12, "aa bb " * 3000), (13, "long " * 200_000 + " ".join(line[3:16])),
            (14, " ".join(line[:9])), (15, " ".join(line[:20] + ["cut"] + line[20:40]))]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")], 1) == []
    assert run(spark, [(1, "a b")], [], 1) == plain([(1, "a b")], [])


def test_stage_drops_only_contaminated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, 0), (1, "clean text", 0), (None, passage, 0), (None, None, 0), (2, "ok", 0), (2, "ok", 0)],
                                 "doc_id bigint, text string, b int")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter(F.col("doc_id").isNotNull()).collect()) == [(1, "clean text"), (2, "ok"), (2, "ok")]
    assert kept.count() == 4
