"""A quality score: ridge regression on random Fourier features of document statistics,
followed by isotonic calibration.

The cosine features approximate a Gaussian kernel, so a linear fit on them is a kernel fit
whose normal equations are sums over rows: every partition adds up its own, and only a
matrix of fixed size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.llm import words
from featmart.llm.line_quality import DIGITS, LETTERS, NOT_TAIL, SENTENCE_END, SHOUTS, SYMBOLS, UPPER, Lines
from featmart.llm.tables import kept_names, map_batches, numbered, raw
from featmart.session import cut_lineage

#: Cosine features, kernel width in standard deviations, ridge per row, and the seed.
FEATURES, KERNEL_WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 11
#: Tasks that add up the normal equations; each sends one matrix.
SUM_TASKS = 256
#: Equal bins of the fitted score that the calibration is learned on, over RANGE.
BINS, RANGE = 2000, (-1.0, 2.0)
#: Score from which a document is predicted to be good.
GOOD = 0.7
#: A document is held out if crc32(id as text) % FOLDS is HELD_OUT; CALIBRATED sets the
#: calibration, the other folds the fit.
FOLDS, HELD_OUT, CALIBRATED = 4, 2, 3

STATISTICS = (
    "log_words", "log_lines", "log_words_per_line", "word_length", "long_words", "short_words", "letters", "upper",
    "upper_words", "digits", "symbols", "symbol_words", "bars", "shouts", "beyond_ascii", "commas", "stops", "closed_lines",
    "repeated_words", "copied_lines", "different_words", "most_frequent_word",
)


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


BARS, COMMAS, STOPS = _class(b"|"), _class(b",;:"), _class(b".")
BEYOND = np.arange(256) >= 0xC0


def statistics(chunk: words.Chunk) -> np.ndarray:
    """(texts, STATISTICS); an empty text has zeros throughout."""
    lines = Lines(chunk)
    found = lines.words
    low, high = chunk.bounds[:-1], chunk.bounds[1:]
    n_words, n_lines = found.per_text, lines.lines.per_text
    many = np.maximum(n_words, 1)
    chars = np.maximum(chunk.count(NOT_TAIL & words.NOT_SPACE, low, high), 1)
    letters = chunk.count(LETTERS & NOT_TAIL, low, high)
    length = chunk.count(NOT_TAIL, found.starts, found.ends)

    def share(flags: np.ndarray) -> np.ndarray:
        return lines.per_text(flags, found.first) / many

    def of_chars(member: np.ndarray) -> np.ndarray:
        return chunk.count(member, low, high) / chars

    count, earlier = words.repeats(found.owner, found.hashes(lower=True))
    most = np.zeros(chunk.texts)
    np.maximum.at(most, found.owner, count)
    upper = chunk.count(UPPER, found.starts, found.ends)
    closing = np.zeros(len(lines.lines), dtype=bool)
    if len(chunk.data):
        ends = lines.lines.ends
        closing = SENTENCE_END[chunk.data[np.maximum(ends - 1, 0)]] & (ends > lines.lines.starts)
    columns = {
        "log_words": np.log1p(n_words), "log_lines": np.log(np.maximum(n_lines, 1)),
        "log_words_per_line": np.log1p(n_words / np.maximum(n_lines, 1)),
        "word_length": lines.per_text(length, found.first) / many, "long_words": share(length > 12), "short_words": share(length < 4),
        "letters": letters / chars, "upper": chunk.count(UPPER, low, high) / np.maximum(letters, 1),
        "upper_words": share((upper > 1) & (2 * upper > length)), "digits": of_chars(DIGITS), "symbols": of_chars(SYMBOLS),
        "symbol_words": share(chunk.count(SYMBOLS, found.starts, found.ends) > 0), "bars": of_chars(BARS), "shouts": of_chars(SHOUTS),
        "beyond_ascii": of_chars(BEYOND), "commas": of_chars(COMMAS), "stops": of_chars(STOPS),
        "closed_lines": lines.per_text(closing, lines.lines.first) / np.maximum(n_lines, 1),
        "repeated_words": share(lines.repeated), "copied_lines": lines.per_text(lines.duplicate, lines.lines.first) / np.maximum(n_lines, 1),
        "different_words": share(~earlier), "most_frequent_word": most / many,
    }
    return np.stack([columns[n] for n in STATISTICS], axis=1) * (n_words > 0)[:, None]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and `stats`, an array in the order of STATISTICS; texts are read once."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], raw(text).alias("_text"))
    kinds = dict(source.dtypes)

    def work(batch):
        found = np.concatenate([statistics(c) for c in words.chunks(batch.column("_text"))])
        return {c: batch.column(c) for c in keep} | {"stats": list(found)}

    return map_batches(source, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["stats array<double>"]), work)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    turns: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(stats)), np.sqrt(2 / FEATURES) * np.cos(scaled @ self.turns + self.phase)])

    def fitted(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a small share of the fitted score keeps the order inside level steps."""
        fitted = self.fitted(stats)
        level = np.interp(fitted, self.knots, self.levels)
        return 0.998 * level + 0.002 / (1 + np.exp(-4 * (fitted - 0.5)))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Model | None:
    """Fit on the labelled rows of `stats` that are not held out; None without both labels.

    Labels of an id that disagree count as the larger. Null ids and labels are skipped.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("y"))
        .filter(fold("_id") != HELD_OUT)
    )
    rows = cut_lineage(stats.join(known, stats[id_col] == known["_id"]).select("stats", "y", (fold("_id") == CALIBRATED).alias("calibrates")))
    if rows.select("y").distinct().limit(2).count() < 2:
        return None
    fit_rows = rows.filter("not calibrates")
    moments = fit_rows.select(
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(STATISTICS))],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATISTICS))], F.count("*").alias("n"),
    ).first()
    if not moments["n"]:
        return None
    count = len(STATISTICS)
    spread = np.array(moments[count : 2 * count], dtype=float)
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array(moments[:count], dtype=float), np.where(spread > 1e-9, spread, 1.0),
        rng.normal(size=(count, FEATURES)) / KERNEL_WIDTH, rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    sums = normal_equations(fit_rows, model)
    gram, target = sums[:, :-1], sums[:, -1]
    penalty = RIDGE * moments["n"] * np.eye(FEATURES + 1)
    penalty[0, 0] = 0
    model.weights = np.linalg.lstsq(gram + penalty, target, rcond=None)[0]
    model.knots, model.levels = calibrate(rows.filter("calibrates"), model)
    return model


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """(FEATURES + 1, FEATURES + 2): the features' products, and with the label."""
    width = FEATURES + 1

    def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.stack(batch.column("stats").to_numpy(zero_copy_only=False)))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("sums")):
                total[i] = total.get(i, 0) + row.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "sums": pa.array(list(total.values()), pa.list_(pa.float64()))})

    parts = rows.select("stats", "y").coalesce(SUM_TASKS).mapInArrow(sum_rows, "i int, sums array<double>")
    merged = parts.repartition(8, "i").mapInArrow(sum_parts, "i int, sums array<double>").collect()
    return np.stack([r["sums"] for r in sorted(merged, key=lambda r: r["i"])])


def calibrate(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the isotonic regression of labels on fitted scores.

    Rows are summed per bin first, so the pooling of adjacent violators sees at most BINS
    rows for any number of labels. Without rows the fitted score stands for itself.
    """

    def bins(batch):
        fitted = model.fitted(np.stack(batch.column("stats").to_numpy(zero_copy_only=False)))
        place = np.clip((fitted - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS, 0, BINS - 1).astype(np.int32)
        return {"bin": place, "fitted": fitted, "y": batch.column("y")}

    found = (
        map_batches(rows.select("stats", "y"), "bin int, fitted double, y double", bins)
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("fitted").alias("x")).orderBy("bin").collect()
    )
    if not found:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return pool(np.array([r["x"] / r["n"] for r in found]), np.array([r["y"] / r["n"] for r in found]), np.array([float(r["n"]) for r in found]))


def pool(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising levels with the least weighted squared error.

    Returns the first and last x of each block with the block's level.
    """
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        blocks.append([xi, xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            first, _, y1, w1 = blocks[-2]
            _, last, y2, w2 = blocks.pop()
            blocks[-1] = [first, last, (y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2]
    knots = [k for b in blocks for k in ((b[0], b[1]) if b[1] > b[0] else (b[0],))]
    levels = [v for b in blocks for v in ((b[2], b[2]) if b[1] > b[0] else (b[2],))]
    return np.array(knots), np.clip(np.array(levels), 0, 1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", good: float = GOOD) -> DataFrame:
    """id, held_out, score (0 to 1), predicted: one row per document.

    Inputs of a score are statistics of the text alone. Null and empty texts have all
    statistics zero and get that point's score; a null id is never held out; repeated rows
    get a row each; an empty table gives an empty one; texts are read whole. Without usable
    labels every score is 0.5. An id named as a result comes back with `_in` behind its name.
    """
    bare = numbered(docs, [id_col], _body=F.col(f"`{text}`"))
    marks = labels.select(F.col(f"`{id_col}`").alias("_k0"), F.col(f"`{label}`").alias("_label"))
    stats = cut_lineage(with_statistics(bare, ["_k0"], "_body"))
    model = train(stats, marks, "_k0", "_label")
    kind = dict(stats.dtypes)["_k0"]

    def work(batch):
        values = np.full(batch.num_rows, 0.5)
        if model is not None:
            values = model.score(np.stack(batch.column("stats").to_numpy(zero_copy_only=False)))
        return {"_k0": batch.column("_k0"), "score": values}

    scored = map_batches(stats, f"_k0 {kind}, score double", work)
    (name,) = kept_names([id_col], ("held_out", "score", "predicted"))
    return scored.select(
        F.col("_k0").alias(name), F.coalesce(fold("_k0") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= good).cast("int").alias("predicted"),
    )
