"""Quality rules: repetition figures, and lines labelled content or boilerplate by a CRF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm import crf, words
from featmart.llm.tables import kept_names, map_batches, numbered, raw

CONTENT, BOILERPLATE = 0, 1
#: Labelled documents that the model is fitted on, and the longest text (bytes) among them.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 20_000
#: A document stays if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5
#: Fewer words, or a larger share of repeated ones in percent, fails a document outright.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 20, 30, 8

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTERS = UPPER.copy()
LETTERS[97:123] = True
LETTERS[128:] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
SHOUTS = np.zeros(256, dtype=bool)
SHOUTS[list(b"!?")] = True
NOT_TAIL = ~((np.arange(256) & 0xC0) == 0x80)
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?:;\"')")] = True

#: Upper edges of the buckets of each line feature.
EDGES = {
    "words": (0, 1, 3, 8, 20, 60),
    "word_length": (2.0, 3.5, 5.0, 6.5, 9.0, 14.0),
    "symbols": (0.0, 0.01, 0.03, 0.08, 0.15, 0.3),
    "bars": (0.0, 0.01, 0.03, 0.08, 0.15),
    "shouts": (0.0, 0.01, 0.03, 0.08, 0.15),
    "upper": (0.0, 0.03, 0.1, 0.3, 0.7),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "repeated": (0.0, 0.3, 0.9),
    "copies": (1, 2, 4),
    "ending": (0,),
}
WIDTH = 1 + max(map(len, EDGES.values()))
N_FEATURES = 3 * WIDTH * len(EDGES)
FEATURE = np.min_scalar_type(N_FEATURES).type


class Lines:
    """The lines of a chunk of texts with the figures that rules and labels are made of."""

    def __init__(self, chunk: words.Chunk):
        self.chunk = chunk
        self.lines = lines = chunk.lines()
        self.words = found = chunk.runs(words.NOT_SPACE)
        place = np.searchsorted(found.starts, lines.starts)
        until = np.searchsorted(found.starts, lines.ends)
        self.line_words = until - place
        hashes = found.hashes()
        at, grams = found.shingles(hashes, REPEAT_WIDTH)
        twice = words.repeats(found.owner[at], grams)[0] > 1
        self.repeated = words.covered(at[twice], REPEAT_WIDTH, len(found))
        self.copies, earlier = words.repeats(lines.owner, lines.hashes())
        self.duplicate = earlier & (self.line_words > 0)
        self.per_line_repeated = self.sums(self.repeated, place, until)

    @staticmethod
    def sums(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[high] - total[low]

    def per_text(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]

    def figures(self) -> dict[str, np.ndarray]:
        """Per text: the numbers that the fixed rules look at."""
        chunk, found = self.chunk, self.words
        letters = chunk.count(NOT_TAIL & words.NOT_SPACE, chunk.bounds[:-1], chunk.bounds[1:])
        return {
            "n_words": found.per_text,
            "word_chars": letters,
            "n_symbols": chunk.count(SYMBOLS, chunk.bounds[:-1], chunk.bounds[1:]),
            "n_dup_lines": self.per_text(self.duplicate, self.lines.first),
            "n_repeat_words": self.per_text(self.repeated, found.first),
        }

    def features(self) -> np.ndarray:
        """(lines, ids): a bucket of each figure of the line, the one before and the one after."""
        chunk, starts, ends = self.chunk, self.lines.starts, self.lines.ends
        chars = np.maximum(chunk.count(NOT_TAIL & words.NOT_SPACE, starts, ends), 1)
        letters = np.maximum(chunk.count(LETTERS & NOT_TAIL, starts, ends), 1)
        many = np.maximum(self.line_words, 1)
        bars = np.zeros(256, dtype=bool)
        bars[ord("|")] = True
        closing = np.zeros(len(starts), dtype=bool)
        if len(chunk.data):
            closing = SENTENCE_END[chunk.data[np.maximum(ends - 1, 0)]] & (ends > starts)
        figures = {
            "words": self.line_words,
            "word_length": chars / many,
            "symbols": chunk.count(SYMBOLS, starts, ends) / chars,
            "bars": chunk.count(bars, starts, ends) / chars,
            "shouts": chunk.count(SHOUTS, starts, ends) / chars,
            "upper": chunk.count(UPPER, starts, ends) / letters,
            "digits": chunk.count(DIGITS, starts, ends) / chars,
            "repeated": self.per_line_repeated / many,
            "copies": self.copies,
            "ending": closing,
        }
        own = np.stack([np.searchsorted(EDGES[k], v) for k, v in figures.items()], axis=1, dtype=FEATURE, casting="unsafe")
        step = FEATURE(len(EDGES) * WIDTH)
        # Ids take a byte: the sample's lines are held in the driver as long as the fit lasts.
        base = (np.arange(len(EDGES)) * WIDTH).astype(FEATURE)
        inner = np.ones(len(starts), dtype=bool)
        inner[self.lines.first[:-1]] = False
        nothing = np.full(own.shape[1], WIDTH - 1, dtype=FEATURE)
        before = np.where(inner[:, None], np.roll(own, 1, axis=0), nothing)
        after = np.where(np.roll(inner, -1)[:, None], np.roll(own, -1, axis=0), nothing)
        return np.concatenate([own + base, before + base + step, after + base + step + step], axis=1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> crf.Crf | None:
    """Fit the line labeller on at most SAMPLE_DOCS labelled documents.

    Lines of documents labelled 1 count as content, those of documents labelled 0 as
    boilerplate. The sample takes the labelled ids smallest by hash, whatever their order
    in the table. Null labels and ids are skipped; without both labels there is no model.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    )
    # Of rows that share an id, that of the smallest content hash.
    rows = (
        docs.select(F.col(id_col).alias("_id"), raw(text).alias("_text"))
        .filter(F.octet_length("_text") <= SAMPLE_BYTES)
        .join(F.broadcast(ids), "_id")
        .groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_first"))
        .select("_id", "_label", F.col("_first.t").alias("_text")).toPandas().sort_values("_id")
    )
    if rows["_label"].nunique() < 2:
        return None
    kinds = np.where(rows["_label"].to_numpy() == 1, CONTENT, BOILERPLATE)
    features, tags, first = [], [], [np.zeros(1, dtype=np.int64)]
    # Chunk by chunk: the words of all texts take ten times the driver's memory that their lines do.
    for chunk in words.chunks(pa.array([bytes(t) for t in rows["_text"]], pa.large_binary())):
        lines = Lines(chunk)
        features.append(lines.features())
        tags.append(kinds[chunk.low + lines.lines.owner])
        first.append(first[-1][-1] + lines.lines.first[1:])
    return crf.fit(np.concatenate(features), np.concatenate(tags), np.concatenate(first), N_FEATURES, 2)


def judge(docs: DataFrame, model: crf.Crf | None, keep: list[str], text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The columns `keep`, the rules' figures, `content_words`, `base_failed` and `kept`.

    A null text has no words and fails by the rules, as does an empty one. Without a model
    all lines are content. Repeated rows are judged alike, and an empty table gives an empty
    one; long texts are judged whole. A kept column named as a result comes back with `_in`
    behind its name.
    """
    source = numbered(docs, keep, _text=raw(F.col(f"`{text}`")))
    kinds = dict(source.dtypes)
    own = [f"_k{i}" for i in range(len(keep))]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")

    def work(batch):
        parts = []
        for chunk in words.chunks(batch.column("_text")):
            lines = Lines(chunk)
            figures = lines.figures()
            content = figures["n_words"]
            if model is not None:
                tags = model.decode(model.scores(lines.features()), lines.lines.first)
                content = lines.per_text(lines.line_words * (tags == CONTENT), lines.lines.first)
            parts.append(figures | {"content_words": content})
        out = {n: np.concatenate([p[n] for p in parts]) for n in names}
        total = out["n_words"]
        failed = (total < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * total)
        return (
            {c: batch.column(c) for c in own} | out
            | {"base_failed": failed, "kept": ~failed & (out["content_words"] >= share * total)}
        )

    schema = [f"{c} {kinds[c]}" for c in own] + [f"{n} bigint" for n in names]
    results = (*names, "base_failed", "kept")
    return map_batches(source, ", ".join([*schema, "base_failed boolean", "kept boolean"]), work).toDF(*kept_names(keep, results), *results)


def keep_good(docs: DataFrame, model: crf.Crf | None, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns; texts are not shuffled."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]
    return judge(docs.toDF(*names), model, names, body).filter("kept").select(*names).toDF(*docs.columns)
