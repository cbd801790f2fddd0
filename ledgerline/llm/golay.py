"""The binary Golay code of length 23: decoding tables and nearby codewords.

The code is perfect: each of the 2^23 words lies within three bits of exactly one
of its 4096 codewords. Everything here is computed from the generator polynomial.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed values of the code: length, dimension, and x^11+x^9+x^7+x^6+x^5+x+1.
LENGTH, DIMENSION, GENERATOR = 23, 12, 0b101011100011


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """The 4096 codewords; message bits select shifts of the generator."""
    words = np.zeros(1, dtype=np.uint32)
    for shift in range(DIMENSION):
        words = np.concatenate([words, words ^ np.uint32(GENERATOR << shift)])
    return words


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """Index of the codeword within three bits, for each of the 2^23 words."""
    table = np.empty(1 << LENGTH, dtype=np.uint16)
    index = np.arange(len(codewords()), dtype=np.uint16)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            table[codewords() ^ np.uint32(sum(1 << b for b in bits))] = index
    return table


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices that words one bit away (within ``width`` low bits) decode to.

    Returns an array of shape (n, k), the word's own index first, and a mask of
    the entries that are not repeats. At most six differ: a word three bits from
    its codeword has five more codewords at four bits.
    """
    table = decoder()
    words = words.astype(np.uint32)
    flips = np.uint32(1) << np.arange(width, dtype=np.uint32)
    own = table[words][:, None]
    near = np.sort(np.where((other := table[words[:, None] ^ flips]) == own, np.uint16(0xFFFF), other), axis=1)
    fresh = np.ones(near.shape, dtype=bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    fresh &= near != 0xFFFF
    # Pack the distinct entries to the left; five columns hold them all.
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :5]
    near = np.take_along_axis(near, order, axis=1)
    fresh = np.take_along_axis(fresh, order, axis=1)
    return np.hstack([own, near]), np.hstack([np.ones((len(words), 1), dtype=bool), fresh])
