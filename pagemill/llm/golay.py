"""The binary Golay code [23, 12, 7], and keys that nearby words share.

The code is perfect: each 23-bit word is at most 3 bits from exactly one
codeword. A word's keys are the codewords that decoding finds for the word
and for each word one bit away: one key if the word is within 2 bits of its
codeword, six if it is 3 bits away. Two words at most 2 bits apart have a
word between them that is at most one bit from both, so they share its key.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WIDTH, DIMENSION = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


@cache
def codewords() -> np.ndarray:
    """The 4096 codewords by message: sums of the generator polynomial's shifts."""
    messages = np.arange(1 << DIMENSION, dtype=np.int64)
    words = np.zeros_like(messages)
    for i in range(DIMENSION):
        words ^= np.where(messages >> i & 1, GENERATOR << i, 0)
    return words


@cache
def decoder() -> np.ndarray:
    """The message of the nearest codeword for each of the 2^23 words."""
    bits = 1 << np.arange(WIDTH, dtype=np.int64)
    errors = [np.zeros(1, np.int64), bits]
    i, j = np.triu_indices(WIDTH, 1)
    errors.append(bits[i] | bits[j])
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(WIDTH)] * 3, indexing="ij"))
    some = (i < j) & (j < k)
    errors.append(bits[i[some]] | bits[j[some]] | bits[k[some]])
    table = np.empty(1 << WIDTH, np.uint16)
    messages = np.arange(1 << DIMENSION, dtype=np.uint16)
    for error in np.concatenate(errors):
        table[codewords() ^ error] = messages
    return table


def keys(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, key) for each key of each word; ``width``: how many low bits may differ."""
    words = words.astype(np.int64)
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(width, dtype=np.int64))], axis=1)
    found = np.sort(decoder()[near], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new].astype(np.int64)
