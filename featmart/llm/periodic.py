"""Runs of words that repeat with a period, found through a difference cover.

Words are numbers, and all texts of a chunk are searched together. A run of period q holds
two neighbouring points of the grid 0, q, 2q, ... of its text, and from the first of them
its words equal those q later; so the grids of all periods (n/1 + n/2 + ... points) find
every run. A point whose next few words agree is extended both ways by the longest common
extension of two positions:

* A difference cover of the residues modulo V has, for any two positions, one shift below V
  that takes both to sampled positions: fewer than V words are compared to get there.
* Only the suffixes at sampled positions are sorted, by blocks of V words and doubling.
* The common blocks of two sampled suffixes are the minimum of neighbours' values between
  their ranks, from a sparse table; the words of the next block are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm import words
from featmart.llm.tables import kept_names, map_batches, numbered, raw

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Modulus and residues of the cover: every difference modulo 13 is one of two residues.
V, COVER = 13, (0, 1, 3, 9)
#: Words compared before a point of a grid is extended.
FEW = 8
#: Points of grids that are held at a time.
POINTS = 1 << 20

SAMPLED = np.isin(np.arange(V), COVER)
#: The shift that takes positions of two residues to the cover.
SHIFT = np.array([[next(d for d in range(V) if SAMPLED[(a + d) % V] and SAMPLED[(b + d) % V]) for b in range(V)] for a in range(V)])


@dataclass
class Extension:
    """Longest common extensions to the right between positions of one text.

    `codes` are the words of all texts end to end, from 1 on; `ends` has, for each word,
    the end of its text.
    """

    codes: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        total = len(self.codes)
        self.at = np.flatnonzero(SAMPLED[np.arange(total) % V])
        self.slot = np.full(total, -1, dtype=np.int64)
        self.slot[self.at] = np.arange(len(self.at))
        ends = self.ends[self.at]
        # Blocks of V words; beyond the text's end a word is 0, and texts share no block.
        block = ends.astype(np.uint64)
        for d in range(V):
            place = self.at + d
            word = np.where(place < ends, self.codes[np.minimum(place, total - 1)], 0)
            block = words.mix(block + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        levels = [np.unique(block, return_inverse=True)[1].astype(np.int64)]
        steps = []
        reach = V
        longest = int((ends - self.at).max(initial=0))
        while reach < longest and levels[-1].max(initial=0) + 1 < len(self.at):
            place = self.at + reach
            steps.append(np.where(place < ends, self.slot[np.minimum(place, total - 1)], -1))
            rank = levels[-1]
            key = rank * (len(rank) + 1) + np.where(steps[-1] >= 0, rank[steps[-1]] + 1, 0)
            levels.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
            reach *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        # Sampled suffixes differ in the end, so ranks are places.
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        one, two = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(one), dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            live = (one >= 0) & (two >= 0)
            same = live & (levels[k][np.maximum(one, 0)] == levels[k][np.maximum(two, 0)])
            common[same] += 1 << k
            if k < len(steps):
                one = np.where(same, steps[k][np.maximum(one, 0)], one)
                two = np.where(same, steps[k][np.maximum(two, 0)], two)
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half = 1 << (len(self.table) - 1)
            below = self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def blocks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Common blocks of V words of the suffixes at two sampled positions."""
        a, b = self.rank[self.slot[one]], self.rank[self.slot[two]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        found = np.zeros(len(one), dtype=np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            pick = level == k
            row = self.table[k]
            found[pick] = np.minimum(row[low[pick]], row[high[pick] - (1 << int(k))])
        return found

    def _compare(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from two positions on, at most `limit` (below V + 1), in one text."""
        total = np.zeros(len(one), dtype=np.int64)
        live = np.arange(len(one))
        for d in range(int(limit.max(initial=0))):
            live = live[d < limit[live]]
            x, y = one[live] + d, two[live] + d
            inside = y < self.ends[two[live]]
            live, x, y = live[inside], x[inside], y[inside]
            live = live[self.codes[x] == self.codes[y]]
            total[live] = d + 1
        return total

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Equal words from `one` and from the later `two` on, within their text."""
        shift = SHIFT[one % V, two % V]
        total = self._compare(one, two, shift)
        ends = self.ends[two]
        go = np.flatnonzero((total == shift) & (two + shift < ends))
        x, y = one[go] + shift[go], two[go] + shift[go]
        many = V * self.blocks(x, y)
        total[go] += many
        x, y = x + many, y + many
        rest = np.flatnonzero(y < ends[go])
        total[go[rest]] += self._compare(x[rest], y[rest], np.full(len(rest), V))
        return total


def _candidates(codes: np.ndarray, first: np.ndarray):
    """(text, point, period) where a run may be, a block of grid points at a time."""
    size = np.diff(first)
    periods = np.where(size >= LEAST_WORDS, size // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (size[text] - 1) // period
    upto = np.concatenate([[0], np.cumsum(points)])
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + POINTS, side="right")) - 1)
        count = points[low:high]
        pair = np.repeat(np.arange(low, high), count)
        step = np.arange(len(pair)) - np.repeat(upto[low:high] - upto[low], count)
        q = period[pair]
        at = first[text[pair]] + step * q
        # A run of period q agrees for so many words from its first point on.
        need = np.maximum(LEAST_WORDS + 1 - 2 * q, (LEAST_PERIODS - 2) * q + 1)
        live = np.flatnonzero(codes[at] == codes[at + q])
        for d in range(1, FEW):
            place = at[live] + q[live] + d
            short = d >= need[live]
            inside = place < first[text[pair[live]] + 1]
            same = np.zeros(len(live), dtype=bool)
            same[inside] = codes[at[live[inside]] + d] == codes[place[inside]]
            live = live[short | same]
        yield text[pair[live]], at[live], q[live]
        low = high


def runs_of(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; starts count
    from the text's first word. Words are `codes`, those of text i at first[i]:first[i + 1].
    """
    found = list(zip(*_candidates(codes, first)))
    text, at, q = (np.concatenate(part) for part in found) if found else (np.zeros(0, dtype=np.int64),) * 3
    if not len(text):
        return text, at, at, q
    # Texts without a candidate need no order of suffixes.
    used = np.unique(text)
    place = np.searchsorted(used, text)
    sizes = np.diff(first)[used]
    inner = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(inner[-1]) + np.repeat(first[used] - inner[:-1], sizes)
    own = np.unique(codes[source], return_inverse=True)[1] + 1
    ends = np.repeat(inner[1:], sizes)
    total = len(own)
    at = at - first[text] + inner[place]
    ahead = Extension(own, ends).common(at, at + q)
    # The same on the reversed words: position p is total - 1 - p, and of a pair the later
    # one comes first.
    back = Extension(own[::-1], (total - np.repeat(inner[:-1], sizes))[::-1])
    behind = np.zeros(len(at), dtype=np.int64)
    more = np.flatnonzero(at > inner[place])
    behind[more] = back.common(total - at[more] - q[more], total - at[more])
    start, length = at - behind - inner[place], ahead + behind + q
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    text, start, length, q = text[keep], start[keep], length[keep], q[keep]
    # A stretch is found by every multiple of its smallest period that fits.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def _dropped(total: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Flags of the words that a run has after its first period."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, `n_words`, `runs` and `collapsed`.

    Words are stretches without white space of ASCII. A run is a stretch of words of
    smallest period q that no neighbour extends, of at least max(24, 3 q) words; `runs` has
    (start, length, period), by start, then period, starts counted in words from 0.
    `collapsed` has the words, joined by one space, without those that a run has after its
    first period.

    A null text has no words, no runs and an empty `collapsed`, as has an empty one. Repeated
    rows are judged alike, each by itself; an empty table gives an empty one. A text's arrays
    take memory in proportion to its length, its grids are searched a block of points at a
    time. A kept column named as one of the results comes
    back with `_in` behind its name.
    """
    names = ("n_words", "runs", "collapsed")
    source = numbered(docs, keep, _text=raw(F.col(f"`{text}`")))
    kinds = dict(source.dtypes)
    own = [f"_k{i}" for i in range(len(keep))]

    def work(batch):
        texts = batch.column("_text")
        sizes, counts, parts, collapsed = [], [], [], []
        for chunk in words.chunks(texts):
            found = chunk.runs(words.NOT_SPACE)
            codes = np.unique(found.hashes(), return_inverse=True)[1].astype(np.int64)
            owner, start, length, period = runs_of(codes, found.first)
            drop = _dropped(len(codes), start + found.first[owner], length, period)
            any_drop = np.bincount(owner, minlength=chunk.texts)
            for i in range(chunk.texts):
                body = texts[chunk.low + i].as_py().split()
                if any_drop[i]:
                    body = compress(body, (~drop[found.first[i] : found.first[i + 1]]).tolist())
                collapsed.append(b" ".join(body))
            sizes.append(found.per_text)
            counts.append(any_drop)
            parts.append((start, length, period))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        values = [pa.array(np.concatenate(p)) for p in zip(*parts)]
        runs = pa.StructArray.from_arrays(values, ["start", "length", "period"])
        return (
            {c: batch.column(c) for c in own}
            | {"n_words": np.concatenate(sizes), "runs": pa.ListArray.from_arrays(pa.array(ends), runs), "collapsed": collapsed}
        )

    schema = [f"{c} {kinds[c]}" for c in own]
    schema += ["n_words bigint", "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed binary"]
    out = map_batches(source, ", ".join(schema), work).toDF(*kept_names(keep, names), *names)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
