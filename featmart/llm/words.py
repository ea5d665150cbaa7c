"""Words of many texts at once, as numpy arrays over a buffer of UTF-8 bytes.

ASCII bytes never occur inside the encoding of another character, so a word class that
takes either all or no characters beyond ASCII can be read from bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text whose arrays are held at a time; one longer text is held alone.
CHUNK_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: the bytes outside all `ranges` (ends included)."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], for text whose A-Z are lower-cased
LETTER_DIGIT = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: [^\n]
NOT_NEWLINE = byte_class((0x0A, 0x0A))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        tables = []
        for factor in (_BASE, _BACK):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size > 4 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned longs."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


@dataclass
class Chunk:
    """Some whole texts: their bytes end to end, and where each begins and ends."""

    low: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def runs(self, member: np.ndarray) -> "Runs":
        """Maximal runs of bytes in the class, none across two texts."""
        flag = member[self.data]
        size = len(flag)
        opens, closes = flag.copy(), flag.copy()
        if size:
            opens[1:] &= ~flag[:-1]
            closes[:-1] &= ~flag[1:]
            inner = self.bounds[(self.bounds > 0) & (self.bounds < size)]
            opens[inner] = flag[inner]
            closes[inner - 1] = flag[inner - 1]
        return self.spans(np.flatnonzero(opens), np.flatnonzero(closes) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> "Runs":
        first = np.searchsorted(starts, self.bounds)
        return Runs(self, starts, ends, first)

    def lines(self) -> "Runs":
        """The \\n-separated lines of each text, empty ones included; an empty text has one."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.bounds[1:]])
        text = np.searchsorted(self.bounds, breaks, side="right") - 1
        owner = np.concatenate([np.arange(self.texts), text])
        order = np.lexsort((starts, owner))
        close = np.concatenate([text, np.arange(self.texts)])
        ends = ends[np.lexsort((ends, close))]
        counts = np.bincount(owner, minlength=self.texts)
        return Runs(self, starts[order], ends, np.concatenate([[0], np.cumsum(counts)]))

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans: equal spans have equal hashes."""
        power, back = _power_tables(len(self.data) + 1)
        codes = LOWER[self.data] if lower else self.data
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[codes] * power[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def count(self, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes of the class within each span."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(member[self.data], out=sums[1:])
        return sums[ends] - sums[starts]


@dataclass
class Runs:
    """Spans of a chunk in order; `first[i]:first[i + 1]` are those of text i."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def owner(self) -> np.ndarray:
        """Index of the text that each span belongs to."""
        return np.repeat(np.arange(self.chunk.texts), np.diff(self.first))

    @cached_property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.chunk.hash_spans(self.starts, self.ends, lower)

    def shingles(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each `width` consecutive words of one text."""
        total = len(hashes) - width + 1
        if total <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.owner[:total] == self.owner[width - 1 :])
        sums = np.zeros(total, dtype=np.uint64)
        for j in range(width):
            sums *= np.uint64(_BASE)
            sums += hashes[j : j + total]
        return at, mix(sums[at] + np.uint64(width))


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a binary column without nulls, in chunks of about CHUNK_BYTES."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield Chunk(low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def chunk_of(texts: list[str | bytes]) -> Chunk:
    """All given texts as one chunk."""
    body = [t.encode() if isinstance(t, str) else t for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in body])]).astype(np.int64)
    return Chunk(0, np.frombuffer(b"".join(body), dtype=np.uint8), bounds)


def repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: how often its hash occurs in its text, and whether it does earlier.

    Items must come in text order.
    """
    key = mix(hashes + owner.astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    count, earlier = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=bool)
    count[order] = np.repeat(size, size)
    earlier[order] = ~new
    return count, earlier


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Flags of the positions within `length` from any of `starts`."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, total), -1)
    return np.cumsum(step[:-1]) > 0
