"""Static range asymmetric numeral coding of token ids, in numpy.

A block of symbols is dealt over LANES interleaved coders with 32-bit states that give off
16 bits at a time; symbol i belongs to lane i % LANES. Every `CHECK_STEPS` steps the block
notes its states and its place in the stream, so decoding can begin there. All blocks of a
segment share one frequency table and are coded side by side.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 16
SCALE = 1 << SCALE_BITS
LANES = 32
BLOCK_STEPS = 2048
BLOCK = LANES * BLOCK_STEPS
CHECK_STEPS = 512
#: Blocks coded together.
SIDE_BY_SIDE = 64
#: Smallest state; a state is always in [LOWEST, LOWEST << 16).
LOWEST = 1 << 16
MAGIC = b"FRN1"
_HEADER = struct.Struct("<4sIIIII")  # magic, symbols, steps, words, checkpoints, crc32 of the ids


class Damaged(ValueError):
    """A block's bytes or its decoded ids fail their checksum."""


@dataclass
class Table:
    """Frequencies of the symbols that occur, summing to SCALE."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self):
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.symbols)), self.freq)
        self.rank = np.zeros(int(self.symbols[-1]) + 1, dtype=np.int64)
        self.rank[self.symbols] = np.arange(len(self.symbols))

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> "Table":
        """Scale counts to SCALE, at least 1 each; what is left over goes to the largest."""
        if not 0 < len(symbols) <= SCALE:
            raise ValueError(f"a table holds 1 to {SCALE} symbols")
        free = SCALE - len(symbols)
        freq = 1 + (counts.astype(np.float64) * (free / counts.sum())).astype(np.int64)
        freq[np.argmax(freq)] += SCALE - freq.sum()
        return cls(symbols.astype(np.int64), freq)

    def to_bytes(self) -> bytes:
        steps = np.diff(self.symbols, prepend=0).astype("<u4")
        return zlib.compress(struct.pack("<I", len(steps)) + steps.tobytes() + (self.freq - 1).astype("<u2").tobytes(), 6)

    @classmethod
    def from_bytes(cls, body: bytes) -> "Table":
        body = zlib.decompress(body)
        (n,) = struct.unpack_from("<I", body)
        steps = np.frombuffer(body, "<u4", n, 4)
        freq = np.frombuffer(body, "<u2", n, 4 + 4 * n).astype(np.int64) + 1
        return cls(np.cumsum(steps.astype(np.int64)), freq)


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of up to BLOCK ids each, every one readable by itself with the table."""
    ids = np.asarray(ids, dtype=np.uint32)
    ranks = table.rank[ids]
    whole = len(ids) // BLOCK
    out = []
    for low in range(0, whole, SIDE_BY_SIDE):
        high = min(low + SIDE_BY_SIDE, whole)
        part = slice(low * BLOCK, high * BLOCK)
        out += _encode(ids[part].reshape(high - low, -1), ranks[part].reshape(high - low, BLOCK_STEPS, LANES), BLOCK, table)
    rest = len(ids) - whole * BLOCK
    if rest:
        steps = -(-rest // LANES)
        padded = np.full(steps * LANES, int(np.argmax(table.freq)))
        padded[:rest] = ranks[whole * BLOCK :]
        out += _encode(ids[whole * BLOCK :].reshape(1, -1), padded.reshape(1, steps, LANES), rest, table)
    return out


def _encode(ids: np.ndarray, ranks: np.ndarray, count: int, table: Table) -> list[bytes]:
    blocks, steps, lanes = ranks.shape
    freq, start = table.freq.astype(np.uint64), table.start
    state = np.full((blocks, lanes), LOWEST, dtype=np.uint64)
    gave = np.zeros((steps, blocks, lanes), dtype=bool)
    word = np.zeros((steps, blocks, lanes), dtype=np.uint16)
    noted: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        f, b = freq[ranks[:, t]], start[ranks[:, t]]
        gave[t] = full = state >= (f << np.uint64(16))
        word[t] = state & np.uint64(0xFFFF)
        state = np.where(full, state >> np.uint64(16), state)
        whole = state // f
        state = (whole << np.uint64(SCALE_BITS)) + (state - whole * f) + b
        if t % CHECK_STEPS == 0:
            noted[t] = state.astype("<u4")
    marks = sorted(noted)
    before = np.concatenate([np.zeros((1, blocks), dtype=np.int64), np.cumsum(gave.sum(axis=2), axis=0)])
    out = []
    for i in range(blocks):
        stream = word[:, i][gave[:, i]].astype("<u2")
        notes = b"".join(struct.pack("<I", before[t, i]) + noted[t][i].tobytes() for t in marks)
        head = _HEADER.pack(MAGIC, count, steps, len(stream), len(marks), zlib.crc32(ids[i].astype("<u4").tobytes()))
        body = head + notes + stream.tobytes()
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block; all spans between checkpoints are decoded side by side."""
    read = [_open(body) for body in blocks]
    spans = [(i, k) for i, (_, _, _, offsets, _, _) in enumerate(read) for k in range(len(offsets))]
    ids = [np.zeros(steps * LANES, dtype=np.uint32) for _, _, steps, _, _, _ in read]
    for low in range(0, len(spans), 256):
        _decode_spans(read, spans[low : low + 256], table, ids)
    out = []
    for found, (crc, count, *_) in zip(ids, read):
        found = found[:count]
        if zlib.crc32(found.astype("<u4").tobytes()) != crc:
            raise Damaged("decoded ids differ from those written")
        out.append(found)
    return out


def decode_from(body: bytes, table: Table, checkpoint: int) -> np.ndarray:
    """The ids of one block from a checkpoint to the next."""
    read = [_open(body)]
    ids = [np.zeros(read[0][2] * LANES, dtype=np.uint32)]
    _decode_spans(read, [(0, checkpoint)], table, ids)
    low = checkpoint * CHECK_STEPS * LANES
    return ids[0][low : min(low + CHECK_STEPS * LANES, read[0][1])]


def _open(body: bytes):
    if len(body) < _HEADER.size + 4 or zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise Damaged("block fails its checksum")
    magic, count, steps, words, marks, crc = _HEADER.unpack_from(body)
    if magic != MAGIC:
        raise Damaged("not a block")
    notes = np.frombuffer(body, "<u4", marks * (1 + LANES), _HEADER.size).reshape(marks, 1 + LANES)
    stream = np.frombuffer(body, "<u2", words, _HEADER.size + 4 * marks * (1 + LANES))
    return crc, count, steps, notes[:, 0].astype(np.int64), notes[:, 1:], stream


def _decode_spans(read, spans, table: Table, ids: list[np.ndarray]) -> None:
    """Write the ids of the spans (block, checkpoint) into `ids`."""
    base = np.concatenate([[0], np.cumsum([len(r[5]) for r in read])])
    stream = np.concatenate([r[5] for r in read] + [np.zeros(1, dtype="<u2")]).astype(np.uint64)
    state = np.stack([read[i][4][k] for i, k in spans]).astype(np.uint64)
    at = np.array([base[i] + read[i][3][k] for i, k in spans])
    left = np.array([min(CHECK_STEPS, read[i][2] - k * CHECK_STEPS) for i, k in spans])
    order = np.argsort(-left, kind="stable")
    state, at, left = state[order], at[order], left[order]
    longest = int(left[0])
    found = np.zeros((len(spans), longest, LANES), dtype=np.uint32)
    freq, start = table.freq.astype(np.uint64), table.start
    symbols = table.symbols.astype(np.uint32)
    for t in range(longest):
        live = int(np.searchsorted(-left, -t, side="left"))
        part = state[:live]
        low = part & np.uint64(SCALE - 1)
        rank = table.slot[low.astype(np.int64)]
        found[:live, t] = symbols[rank]
        part = freq[rank] * (part >> np.uint64(SCALE_BITS)) + low - start[rank]
        short = part < LOWEST
        place = np.cumsum(short, axis=1)
        take = stream[np.minimum(at[:live, None] + place - 1, len(stream) - 1)]
        state[:live] = np.where(short, (part << np.uint64(16)) | take, part)
        at[:live] += place[:, -1]
    for row, span in enumerate(order):
        i, k = spans[span]
        low = k * CHECK_STEPS * LANES
        ids[i][low : low + left[row] * LANES] = found[row, : left[row]].reshape(-1)
