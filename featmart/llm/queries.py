"""The operators of this package, applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.llm import byte_pairs, decontaminate, dialogue, line_dedup, line_quality, mixing, page_text, periodic, private_data, quality_model, simhash, token_files, warc
from featmart.llm.tables import table
from featmart.session import scratch_path

#: Vocabulary of the token files, and ranks and pattern of the byte-level encoding.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

#: The mix: a third level above language and source, weights, and the share of all tokens.
#: `documents` has no domain, so its sources are dealt to three by their name's hash.
DOMAIN_SQL = "CASE WHEN md5(source) < '6' THEN 'web' WHEN md5(source) < 'b' THEN 'books' ELSE 'code' END"
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        PLANS[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = line_quality.train(docs, table(spark, folder, "labels"))
    figures = line_quality.judge(docs, model, ["doc_id"])
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"
    )


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "tokens")
    token_files.write(table(spark, folder, "documents"), files, VOCABULARY)
    return token_files.read(spark, files)


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


@query("op5_source_mix", mixing.mixture_sql(DOMAIN_SQL, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mixture(docs, F.expr(DOMAIN_SQL), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


@query("op8_line_dedup", line_dedup.SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op2_warc_histories")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    # `pages` has no time of capture: seconds since 1970 stand in, one per page id.
    captured = F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4_000_000_000)))
    merged = warc.histories(table(spark, folder, "pages"), captured)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "part", "at")


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_private_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return private_data.find(table(spark, folder, "documents"), ["doc_id"])


@query("op4_page_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return page_text.extract(pages, page_text.train(pages), ["page_id", "url"])


@query("op13_byte_pairs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_pairs.encode(table(spark, folder, "documents"), RANKS, PATTERN, ["doc_id"])
    back = byte_pairs.decode(coded, RANKS, PATTERN, ["doc_id"])
    return back.select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: What the query does to every tenth document: from word a on, words repeat with period p.
REPEATED_SQL = r"""
CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0 THEN array_join(flatten(transform(
    array(struct(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10 AS g, filter(split(text, '[ \\t-\\r]+'), w -> w <> '') AS words)),
    x -> transform(array(struct(x.g AS g, x.words AS words, CAST(size(x.words) AS BIGINT) AS n, CAST(x.g % greatest(size(x.words), 1) AS BIGINT) AS a)),
        y -> array_join(transform(y.words, (w, i) -> CASE WHEN i < y.a THEN w
            ELSE y.words[CAST(y.a + (i - y.a) % (1 + (y.n - y.a) div (3 + y.g % 8)) AS INT)] END), ' ')))), '')
ELSE text END
"""


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.expr(REPEATED_SQL).alias("text"))
    # The greatest exact exponent; runs come by start, then period, and the first of equals stays.
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (best, run) -> "
        "CASE WHEN best IS NULL OR run.length * best.period > best.length * run.period THEN run ELSE best END)"
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = periodic.find(docs, ["doc_id"]).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    number, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(number, F.lit(":"), turn)
    space = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
    damaged = (
        turns.withColumns(space | {"_damage": F.crc32(name.cast("binary")) % 20}).filter("_damage <> 0")
        .withColumns({
            "text": F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("_damage") == 4, "user").otherwise(F.col("role")),
            "_copy": F.explode(F.when(F.col("_damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        })
    )
    found = dialogue.summary(dialogue.repair(damaged))
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
