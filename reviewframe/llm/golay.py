"""Fuzzy keys from the perfect binary Golay code (23, 12).

Every 23-bit word lies within distance 3 of exactly one codeword. The codewords nearest to a word and
to its 23 one-bit neighbours give one or six indices of 12 bits. Two words at distance 2 or less have
a common one-bit neighbour (or are such neighbours), so they share an index.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # fixed value: generator polynomial of the code
LENGTH, CHECK_BITS = 23, 11


@lru_cache(maxsize=1)
def decode_table() -> np.ndarray:
    """Index (message bits) of the nearest codeword for each of the 2**23 words."""
    words = np.arange(1 << LENGTH, dtype=np.uint32)

    def syndrome(values: np.ndarray) -> np.ndarray:
        rest = values.copy()
        for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
            rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - CHECK_BITS)),
                             np.uint32(0))
        return rest

    errors = np.zeros(1 << CHECK_BITS, dtype=np.uint32)
    patterns = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(LENGTH), n)],
                        dtype=np.uint32)
    errors[syndrome(patterns)] = patterns
    return ((words ^ errors[syndrome(words)]) >> np.uint32(CHECK_BITS)).astype(np.int16)


def fuzzy_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs, without repeats, for words of ``bits`` bits (23 at most)."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(decode_table()[words.astype(np.uint32)[:, None] ^ flips], axis=1)
    keep = np.ones(found.shape, dtype=bool)
    keep[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, cols = np.nonzero(keep)
    return rows, found[rows, cols].astype(np.int64)
