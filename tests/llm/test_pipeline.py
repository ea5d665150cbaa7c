"""Every stage against brute force on its own input."""

import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from featmart.llm import mixing, queries
from featmart.llm.tables import table
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_line_quality import plain_figures
from tests.llm.test_near_sets import brute as plain_singles


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "benchmark_decontamination", "source_mix", "token_output"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        assert name == "token_output" or docs.columns == columns
    good, single, clean, mixed, tokens = kept
    before = {r["doc_id"]: tuple(r) for r in table(spark, sf, "documents").collect()}

    judged = {r.doc_id: r.kept for r in queries.PLANS["op9_quality_rules"](spark, sf).collect()}
    assert rows(good) == sorted((before[k] for k, v in judged.items() if v), key=str)
    figures = [plain_figures(r["text"]) for r in good.collect()]
    assert all(f[0] >= 20 and 100 * f[4] <= 30 * f[0] for f in figures)

    singles = plain_singles([(r["doc_id"], r["text"]) for r in good.collect()])
    assert rows(single) == sorted((before[k] for k in singles), key=str)

    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    verdict = plain_contamination([(r["doc_id"], r["text"]) for r in single.collect()], items)
    assert rows(clean) == sorted((before[v[0]] for v in verdict if not v[-1]), key=str)

    db = duckdb.connect()
    documents = clean.toPandas()  # noqa: F841
    sql = mixing.mixture_sql(queries.DOMAIN_SQL, queries.MIX_WEIGHTS, queries.MIX_PERCENT, 1, queries.MIX_SEED)
    assert rows(mixed) == sorted((before[r[0]] for r in db.sql(f"SELECT doc_id FROM ({sql})").fetchall()), key=str)

    tokenizer, at, want = Tokenizer.from_file(queries.VOCABULARY), 0, []
    for row in sorted(mixed.collect(), key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(row["text"], add_special_tokens=False).ids + [2]
        want.append((row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert rows(tokens) == sorted(want, key=str)


def test_whole_run_is_registered(spark, sf):
    found = entry_point.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert found["pipeline"](spark, sf).count() > 0


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
