"""Byte-level BPE against the tiktoken library."""

import hashlib
import json
import random
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from featmart.llm import byte_pairs
from featmart.llm.queries import PATTERN, PLANS, RANKS
from featmart.llm.tables import table

EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def both(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    coded = byte_pairs.encode(docs, RANKS, PATTERN, ["doc_id"], **options)
    out = byte_pairs.decode(coded, RANKS, PATTERN, ["doc_id"]).collect()
    return {r.doc_id: (r.n_tokens, bytes(r.packed), bytes(r.decoded)) for r in out}


def expected(library, texts):
    out = {}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        out[i] = (len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode())
    return out


@pytest.mark.parametrize("limit", [0, 500])
def test_equals_the_library(spark, library, limit):
    rng = random.Random(4)
    alphabet = "abcdefghij  \n'stéß世界1234567890.,!"
    texts = ["", None, " ", "Hello  world \n\n x", "Hello  world \n\n x", "don't we'll 'S", "<|endoftext|>", "\x00\x1f\x7f"]
    texts += ["a" * 999, "ab" * 301, " " * 500 + "x", "　  foo\u0085bar ", "".join(rng.choice("abcdefgh") for _ in range(300))]
    for _ in range(80):
        texts.append("".join(rng.choice(EVERY if rng.random() < 0.3 else alphabet) for _ in range(rng.randrange(1, 150))))
    assert both(spark, texts, limit=limit) == expected(library, texts)


def test_classes_of_all_characters(spark, library):
    """Every code point stands alone between spaces, so that its class decides the matches."""
    step = 0x4000
    texts = [" x ".join(EVERY[i : i + step : 7]) for i in range(0, 0x30000, step)]
    assert both(spark, texts) == expected(library, texts)


def test_query_over_documents(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in PLANS["op13_byte_pairs"](spark, sf).collect()}
    want = {}
    for row in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(row.text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[row.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    assert got == want


def test_vocabularies(spark):
    """Any vocabulary that its own merges reach; others are refused."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bb": 257, b"abc": 258, b"bba": 259, b"cc": 260, b"abcab": 261}
    library = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = byte_pairs.Vocabulary(ranks, PATTERN)
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["ids"] for r in df.select("w", known.ids(known.codes(F.array("w"))).alias("ids")).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words}
    for odd in ({b"a": 0}, {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258}):
        with pytest.raises(ValueError):
            byte_pairs.Vocabulary(odd, PATTERN)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", "kept", 7)], "doc_id bigint, text string, words string, parts int")
    coded = byte_pairs.encode(docs, RANKS, PATTERN, docs.columns)
    assert coded.columns == [*docs.columns, "ids"] and coded.first()["words"] == "kept"
    assert byte_pairs.encode(docs.filter("false"), RANKS, PATTERN, ["doc_id"]).count() == 0
    assert byte_pairs.encode(docs.withColumnRenamed("words", "Ids"), RANKS, PATTERN, ["Ids"]).columns == ["Ids_in", "ids"]
    gone = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    row = byte_pairs.decode(gone, RANKS, PATTERN, ["doc_id"]).first()
    assert (row.n_tokens, bytes(row.packed), bytes(row.decoded)) == (0, b"", b"")


def test_texts_with_the_characters_between_frequent_words(spark, library):
    """Frequent words are looked up in texts of words and codes; no text may be taken for one."""
    code = byte_pairs.character(library.encode_ordinary(" !?")[0])
    texts = ["!? !? ... !? ;; \1 \0"] * 9 + [f"!?\1{code}\0", f"\0!?\1 !?", f" !?\1{code}\0...", "\1" * 5, "\0" * 4 + "!?", f"!? {code} ..."]
    assert both(spark, texts, limit=500) == expected(library, texts)


def test_keys_of_one_place(spark):
    """Pairs and words whose places are taken: pairs are found all the same, a left-out word is encoded."""
    pairs = [(byte_pairs.character(i) + byte_pairs.character(3 * i % 997), byte_pairs.character(5000 + i)) for i in range(3000)]
    lookup = byte_pairs.Lookup(pairs)
    held = sum(v is not None for v in json.loads(spark.range(1).select(F.to_json(lookup.slots)).first()[0]))
    assert held < len(pairs)
    missing = [p[::-1] for p, _ in pairs if p[::-1] not in dict(pairs)]
    df = spark.createDataFrame([([p for p, _ in pairs] + missing,)], "p array<string>")
    found = byte_pairs.let(lookup.slots, lambda s: byte_pairs.let(lookup.rest, lambda r: F.transform("p", lookup.find(s, r))))
    assert df.select(found).first()[0] == [v + p for p, v in pairs] + [None] * len(missing)

    # A match of one byte has no pair, whatever stands at its place.
    known = byte_pairs.Vocabulary({bytes([b]): b for b in range(256)} | {bytes([b, c]): 256 + 16 * i + c for i, b in enumerate(b"abcdefgh") for c in range(16)}, PATTERN)
    single = spark.createDataFrame([([chr(b) for b in range(1, 128)],)], "w array<string>").select(known.ids(known.codes(F.col("w"))))
    assert single.first()[0] == list(range(1, 128))

    codes = byte_pairs.Codes([("one", 5, "1"), ("two", 5, "2,2"), ("out", 5, "3")], 4)
    kept = [e for e in spark.range(1).select(codes.slots).first()[0] if e]
    assert kept == ["two\x012,2", "one\x011"]


def test_one_copy_of_a_bound_value(spark):
    """What `let` binds is computed once and is not built into an array that is copied."""
    plan = spark.range(1).select(byte_pairs.let(F.rand(), lambda x: F.array(x, x)).alias("a"), F.col("id"))
    assert len(set(plan.first()["a"])) == 1
    assert "transform(" not in plan._jdf.queryExecution().optimizedPlan().toString()
