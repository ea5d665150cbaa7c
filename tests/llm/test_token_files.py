"""Entropy coding round trips, and token files against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featmart.llm import queries, rans, token_files


def coded(ids):
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table.of_counts(symbols, counts)
    return rans.encode(ids, table), rans.Table.from_bytes(table.to_bytes())


@pytest.mark.parametrize("size", [1, 31, 32, 33, 5000, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 777])
@pytest.mark.parametrize("kinds", [1, 2, 300, 49_000])
def test_round_trip(size, kinds):
    ids = np.minimum(np.random.default_rng(size).zipf(1.2, size) % kinds, kinds - 1).astype(np.uint32)
    blocks, table = coded(ids)
    assert (np.concatenate(rans.decode(blocks, table)) == ids).all()
    assert len(rans.decode(blocks[-1:], table)[0]) == (size - 1) % rans.BLOCK + 1


def test_checkpoints_and_checksums():
    ids = np.random.default_rng(1).integers(0, 900, rans.BLOCK + 50_000).astype(np.uint32)
    blocks, table = coded(ids)
    for block, body in enumerate(blocks):
        spans = -(-min(rans.BLOCK, len(ids) - block * rans.BLOCK) // (rans.CHECK_STEPS * rans.LANES))
        parts = [rans.decode_from(body, table, k) for k in range(spans)]
        assert (np.concatenate(parts) == ids[block * rans.BLOCK : (block + 1) * rans.BLOCK]).all()
    broken = bytearray(blocks[0])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(rans.Damaged):
        rans.decode([bytes(broken)], table)


def test_close_to_the_entropy():
    ids = np.minimum(np.random.default_rng(2).geometric(0.02, 400_000), 2000).astype(np.uint32)
    blocks, _ = coded(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert sum(map(len, blocks)) * 8 / len(ids) < 1.03 * -(share * np.log2(share)).sum()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAzÉß'.,!sST 0１\t\n\r ́語😀<|>#ſΣ"))))
def test_words_encode_like_whole_texts(text):
    words = token_files.encoder(queries.VOCABULARY)
    whole = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.ids(text.encode(), 2).tolist() == [*whole, 2]


@pytest.mark.parametrize("text", ["it's. I'LL, don't.", "<|endoftext|> a<|STARTOFTEXT|>b <|startoftext|>", "x.,y ..., a!. 3,", "Σ ΑΣ ΑΣ."])
def test_special_and_contracted(text):
    test_words_encode_like_whole_texts.hypothesis.inner_test(text)


def expected(tokenizer, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode()))
    at, out = 0, []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_files_of_odd_documents(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 50_000)
    rows = [(5, None), (3, ""), (9, "word " * 60_000), (1, "Hello, world."), (None, "no id"), (7, "x"), (7, "x"), (7, "a")]
    rows += [(100 + i, f"document number {i} says é" * (i % 5)) for i in range(200)]
    docs = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id bigint, text string, part string").repartition(4)
    token_files.write(docs, str(tmp_path / "t"), queries.VOCABULARY)
    got = token_files.read(spark, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, got), key=str) == expected(tokenizer, rows)
    ids = {r["start"]: r["ids"] for r in token_files.read(spark, str(tmp_path / "t"), as_arrays=True).collect()}
    assert sum(map(len, ids.values())) == sum(r["n_tokens"] for r in got)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write(docs, str(tmp_path / "e"), queries.VOCABULARY)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_query_over_documents(spark, sf, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.PLANS["op6_token_files"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == expected(tokenizer, rows)


def test_other_vocabularies_get_whole_texts(spark, tmp_path):
    """Vocabularies that keep case and white space are encoded as the library does."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello there world", "  two\n spaces ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    token_files.write(docs, str(tmp_path / "ids"), path)
    got = {r.doc_id: list(r.ids) for r in token_files.read(spark, str(tmp_path / "ids"), as_arrays=True).collect()}
    library = Tokenizer.from_file(path)
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID] for i, t in enumerate(texts)}
    assert token_files.encoder(queries.VOCABULARY).by_words
    # Reading leaves batches of many rows.
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1
