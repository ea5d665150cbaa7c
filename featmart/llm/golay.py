"""The binary Golay code of length 23: every word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, PARITY = 23, 11
#: Generator polynomial of the code (a fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75


def _remainders() -> np.ndarray:
    """Remainder of each 12-bit message, shifted past the parity bits, by the generator."""
    words = np.arange(1 << (LENGTH - PARITY), dtype=np.int64) << PARITY
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        words = np.where((words >> bit) & 1, words ^ (GENERATOR << (bit - PARITY)), words)
    return words


REMAINDER = _remainders()


def syndrome(words: np.ndarray) -> np.ndarray:
    return REMAINDER[words >> PARITY] ^ (words & ((1 << PARITY) - 1))


def _leaders() -> np.ndarray:
    """The one error pattern of at most 3 bits behind each syndrome."""
    table = np.zeros(1 << PARITY, dtype=np.int64)
    for weight in (1, 2, 3):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)])
        table[syndrome(patterns)] = patterns
    return table


LEADER = _leaders()


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest codeword."""
    return (words ^ LEADER[syndrome(words)]) >> PARITY


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within 4 bits: (indices, counts), one run per word.

    A word at 3 bits from its codeword has five more at 4 bits, found by decoding the
    word with one bit flipped; any other word has none. Two words at most 2 bits apart
    have a word between them, 1 bit from each at most, whose codeword is within 4 bits of
    both: they share an index.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int64)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found[first], first.sum(axis=1)
