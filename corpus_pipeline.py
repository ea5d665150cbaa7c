"""From raw documents to token files: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.llm import decontaminate, line_quality, mixing, near_sets, queries, token_files
from featmart.llm.tables import prepare, table
from featmart.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules or the line labels reject go; the labels come from the
    whole table, so that the model does not depend on earlier stages."""
    model = line_quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return line_quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of texts linked by a five-word Jaccard of 0.8 or more stays."""
    prepare(spark)
    return near_sets.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with too many words in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each leaf's seeded token-prefix stays, a document at most once."""
    prepare(spark)
    return mixing.mix(docs, F.expr(queries.DOMAIN_SQL), queries.MIX_WEIGHTS, queries.MIX_PERCENT, 1, queries.MIX_SEED)


def token_output(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of what is left, read back: one row per document."""
    prepare(spark)
    files = scratch_path(spark, "tokens")
    token_files.write(docs, files, queries.VOCABULARY)
    return token_files.read(spark, files)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: A trained decision and binary output have no SQL twin; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
