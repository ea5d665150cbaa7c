"""Kept and extra columns may have any name, those of results and of inner columns too."""

import pytest
from pyspark.sql import functions as F

from featmart.llm import byte_pairs, decontaminate, line_dedup, line_quality, mixing, near_sets, page_text, periodic, private_data, quality_model, simhash, token_files, warc
from featmart.llm.queries import MIX_WEIGHTS, PATTERN, RANKS, VOCABULARY

NAMES = [
    "found", "spans", "kept", "fp", "stats", "score", "n_words", "n_lines", "n_removed", "runs", "ids", "_text", "_content", "_k", "_l",
    "_row", "_gone", "_id", "_body", "_k0", "node", "token", "part", "html", "held_out", "place", "_hash",
]


@pytest.fixture(scope="module")
def docs(spark):
    base = [(i, f"Some words of text number {i % 3} that are long enough to be kept here.\nAnd a line.", "en", f"s{i % 2}") for i in range(8)]
    df = spark.createDataFrame(base, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES]).repartition(2)


def same_kept(out, docs, renamed=()):
    """Every kept column is there with its values, under its name or with `_in` behind it."""
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for row in rows:
        values = row.asDict()
        for n in NAMES:
            assert values[n + "_in" if n in renamed else n] == f"{n}{row.doc_id}", n


def test_operators_that_keep_columns(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    items = spark.createDataFrame([("b", "words of text")], "item_id string, text string")
    keep = ["doc_id", *NAMES]
    same_kept(decontaminate.contamination(docs, items, keep), docs, ("n_words",))
    same_kept(private_data.find(docs, keep), docs, ("spans",))
    same_kept(line_quality.judge(docs, None, keep), docs, ("n_words", "kept"))
    same_kept(periodic.find(docs, keep), docs, ("n_words", "runs"))
    same_kept(byte_pairs.encode(docs, RANKS, PATTERN, keep, limit=10), docs, ("ids",))
    same_kept(simhash.near_classes(docs, extra=tuple(NAMES)), docs, ("fp",))
    same_kept(page_text.extract(docs, page_text.BiLstm(), [*keep, "text"], "text").withColumnRenamed("text_in", "given"), docs)
    scored = quality_model.score(docs.withColumn("stats", F.col("doc_id")).drop("doc_id"), labels.withColumnRenamed("doc_id", "stats"), "stats")
    assert scored.columns == ["stats", "held_out", "score", "predicted"] and scored.count() == 8


def test_stages_return_the_given_columns(spark, docs, tmp_path):
    items = spark.createDataFrame([("b", "words of text")], "item_id string, text string")
    stages = {
        "quality": lambda d: line_quality.keep_good(d, None),
        "near": near_sets.drop_near_copies,
        "simhash": simhash.drop_near_copies,
        "clean": lambda d: decontaminate.drop_contaminated(d, items),
        "mix": lambda d: mixing.mix(d, F.lit("web"), {"domain": {"web": 1}, "lang": MIX_WEIGHTS["lang"]}, 100, 1, 3),
    }
    given = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns, name
        assert all(tuple(r) == given[r.doc_id] for r in out.collect()), name
    same_kept(line_dedup.remove_boilerplate(docs), docs, ("n_lines", "n_removed"))
    token_files.write(docs, str(tmp_path / "ids"), VOCABULARY)
    assert token_files.read(spark, str(tmp_path / "ids")).count() == 8
    pages = docs.withColumnRenamed("html", "was").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"), *[n for n in NAMES if n != "html"])
    assert warc.histories(pages, F.timestamp_seconds(F.col("page_id"))).count() == 8
