"""64-bit hashes of words and of word n-grams, computed over whole batches of texts with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A word's hash
is a polynomial over its bytes' random values, mixed; an n-gram's hash mixes its
words' hashes in order. Different n-grams get equal hashes with a chance of about
2 ** -64 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import lean

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text, byte offset of each word in its text, its end) over all texts in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts_of_text = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    value = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=value[1:])
    h = mix((value[end] - value[start]) * _power(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(starts_of_text, start, side="right") - 1
    return h, np.bincount(text, minlength=len(texts)), start - starts_of_text[text], end - starts_of_text[text]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, at each start (len(h) - k + 1 of them, across text borders too)."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + h[j : j + n])
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-gram hashes of each text; the whole sequence as one with fewer words, nothing without words."""
    h, counts, _, _ = words(texts)
    every, out, at = grams(h, k), [], 0
    for n in counts.tolist():
        if n >= k:
            g = np.sort(every[at : at + n - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        else:
            out.append(grams(h[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `most` bytes together, with the first one's place; null is the empty text."""
    lean()
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, total = 0, 0
    data = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    for i, n in enumerate([*lengths, most + 1]):
        if i > begin and (total + n > most or i == len(lengths)):
            yield begin, [x or b"" for x in data[begin:i].to_pylist()]
            begin, total = i, 0
        total += n
