"""Words of texts as 64-bit hashes: lower case, runs of letters, digits and underscores."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's begin (one more entry: the end)."""
    flat: list[int] = []
    offsets = [0]
    for text in texts:
        flat += map(xxhash.xxh3_64_intdigest, WORD.findall(text.lower()))
        offsets.append(len(flat))
    return np.array(flat, np.uint64), np.array(offsets, np.int64)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, as long as n are left."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out
