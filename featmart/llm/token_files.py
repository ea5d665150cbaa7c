"""Token ids as files of entropy-coded segments, written and read by Spark.

A segment holds whole documents in ascending id order: their ids and lengths, one
frequency table, and independent blocks (see `rans`). Each segment is a row of a Parquet
folder, so writes commit per task and survive lost executors, and any number of readers
decode segments, or blocks of one, in parallel.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featmart.llm import rans
from featmart.llm.tables import prepare, raw

#: Id that closes each document.
END_ID = 2
#: Text bytes that a write task gets, by expectation.
PART_BYTES = 24 << 20
#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 21
#: Different words whose ids a worker remembers.
REMEMBERED = 400_000

SEGMENT = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("freq", pa.binary()), ("blocks", pa.list_(pa.binary())),
])
SEGMENT_DDL = (
    "part int, segment int, n_docs bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, "
    "freq binary, blocks array<binary>"
)


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
#: Lower-case letters whose words are one pre-token: a-z and the composed Latin letters
#: of U+00DF to U+017F.
LATIN = frozenset("abcdefghijklmnopqrstuvwxyz") | {c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c.islower()}
#: Capitals, digits, runs of white space of all kinds, and punctuation at either end.
PROBE = "  Hello  there\tWORLD, a1b2 3.14 (don't)\n\nÀÉ x-y\x0b\x0cz Ünder_score \r\n end."
PUNCTUATION = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordEncoder(dict):
    """Ids of a text, by way of its different words.

    For vocabularies that lower-case, drop white space and close words: the ids of a text
    are then those of its words in turn, and a word is encoded once while remembered. Others
    are known by PROBE, and get whole texts. The library does all merging; words of Latin letters go straight to its
    model, as the steps before it leave them as they are. Words are lower-cased (A-Z)
    first, unless the text may hold a special token, which is matched before that.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        # Ids go into 16 bits while in memory.
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.by_letters = all(steps) and [t for t, _ in steps[1].pre_tokenize_str(steps[0].normalize_str("Éa bc"))] == [
            "".join(BYTE_LETTERS[b] for b in w.encode()) for w in ("éa", "bc")
        ]

        whole = self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        self.by_words = whole == [i for w in PROBE.lower().split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word) or self.encode(word.decode("utf-8", "replace"))
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # Closing punctuation after a letter or digit is cut off by the tokenizer too.
        head = text.rstrip(PUNCTUATION)
        if head and head != text and "<|" not in text and (head[-1] in LATIN or head[-1] in "0123456789"):
            return self[head.encode()] + self[text[len(head) :].encode()]
        if self.by_letters and text.islower() and text.isalpha() and text.isascii():
            return _packed([t.id for t in self.model.tokenize(text)])
        if self.by_letters and LATIN.issuperset(text):
            return _packed([t.id for t in self.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, text.encode())))])
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes, end_id: int) -> np.ndarray:
        if not self.by_words:
            found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array([*found, end_id], dtype="<u2")
        words = text.split() if b"<|" in text else text.lower().split()
        found = list(map(self.__getitem__, words))
        found.append(end_id.to_bytes(2, "little"))
        return np.frombuffer(b"".join(found), dtype="<u2")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text and write the segments under `folder`.

    Documents are dealt by ranges of the id, null ids first, and sorted within; a range
    streams through its task one segment at a time. A null or empty text has the end id
    only; repeated ids are written in the order of their texts; an empty table gives no
    segment, and reads as no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), raw(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    ordered = source.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        total = 0
        words = encoder(vocabulary)
        for batch in batches:
            for key, body in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = words.ids(body.as_buffer().to_pybytes(), end_id)
                keys.append(key)
                held.append(ids)
                total += len(ids)
                if total >= SEGMENT_IDS:
                    yield _segment(part, number, keys, held)
                    keys, held, total, number = [], [], 0, number + 1
        if keys:
            yield _segment(part, number, keys, held)

    ordered.mapInArrow(encode, SEGMENT_DDL).write.option("compression", "none").parquet(folder)


def _segment(part: int, number: int, keys: list, held: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(held)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    table = rans.Table.of_counts(symbols, counts[symbols])
    row = {
        "part": part, "segment": number, "n_docs": len(keys), "n_ids": len(ids), "doc_ids": keys,
        "lengths": [len(h) for h in held], "freq": table.to_bytes(), "blocks": rans.encode(ids, table),
    }
    return pa.RecordBatch.from_pylist([row], schema=SEGMENT)


def read(spark: SparkSession, folder: str, as_arrays: bool = False) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it, across segments and parts. With
    `as_arrays` the ids themselves come along.
    """
    segments = spark.read.schema(SEGMENT_DDL).parquet(folder)
    sizes = segments.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part: the order of the parts is the only global one.
    part_start = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    starts = (
        sizes.withColumn("s", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(part_start, "part")
        .select("part", "segment", (F.col("p") + F.col("s")).alias("base"))
    )
    more = ", ids array<int>" if as_arrays else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents(batch, i, as_arrays)

    # A row holds a whole segment; batches are closed by their bytes, and decoded row by row.
    prepare(spark)
    docs = segments.mapInArrow(decode, "part int, segment int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint" + more)
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if as_arrays else [])
    )


def _documents(batch: pa.RecordBatch, row: int, as_arrays: bool) -> pa.RecordBatch:
    table = rans.Table.from_bytes(batch.column("freq")[row].as_py())
    ids = np.concatenate(rans.decode([b.as_py() for b in batch.column("blocks")[row].values], table))
    lengths = batch.column("lengths")[row].values.to_numpy()
    ends = np.cumsum(lengths)
    if ends[-1] != len(ids):
        raise rans.Damaged("lengths do not add up to the ids")
    body = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths)]
    count = len(lengths)
    columns = {
        "part": pa.array(np.full(count, batch.column("part")[row].as_py(), dtype=np.int32)),
        "segment": pa.array(np.full(count, batch.column("segment")[row].as_py(), dtype=np.int32)),
        "doc_id": batch.column("doc_ids")[row].values,
        "offset": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
    }
    if as_arrays:
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_pydict(columns)
