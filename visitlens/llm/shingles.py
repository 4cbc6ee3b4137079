"""Words and five-word shingles as 64-bit numbers, shared by the near-duplicate operators.

Numbers are hashed from the bytes of many words at once; no worker remembers words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHINGLE = 5
#: Letters and digits, A-Z lower-cased, and everything beyond ASCII make words.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Bytes that are hashed together; a longer word is hashed on its own.
CHUNK = 1 << 18
_STEP = 0x9E3779B97F4A7C15
_ODD = np.array([pow(_STEP, i, 1 << 64) | 1 for i in range(1, SHINGLE + 1)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, and powers of an odd base: a word's hash is the sum of their products.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_POWERS = np.ones(1, dtype=np.uint64)


def _first_powers(n: int) -> np.ndarray:
    factors = np.full(n, _STEP, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > CHUNK:
        return _first_powers(n)
    if n > len(_POWERS):
        _POWERS = _first_powers(max(64, 1 << (n - 1).bit_length()))
    return _POWERS


def fold(text: bytes | str | None) -> bytes:
    """The words of a text in UTF-8, with single bytes of space for everything that separates them."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(_FOLD) if text else b""


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(raw, dtype=np.uint8)
    inside = codes != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts = edges[::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    lengths = edges[1::2] - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE[codes[inside]] * _powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(_STEP)), starts


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts) of the words of a folded text."""
    if len(raw) <= CHUNK:
        return _hashed(raw)
    numbers, starts, at = [], [], 0
    while at < len(raw):
        end = len(raw)
        if at + CHUNK < end:
            end = raw.rfind(b" ", at, at + CHUNK) + 1 or (raw.find(b" ", at + CHUNK) + 1 or end)
        n, s = _hashed(raw[at:end])
        numbers.append(n)
        starts.append(s + at)
        at = end
    return np.concatenate(numbers), np.concatenate(starts)


def numbers_of(texts: Sequence[bytes | str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of several texts in a row, and the count of each text."""
    folded = [fold(t) for t in texts]
    numbers, starts = hash_words(b" ".join(folded))
    ends = np.cumsum([len(f) + 1 for f in folded])
    return numbers, np.diff(np.searchsorted(starts, ends), prepend=0)


def word_numbers(text: bytes | str | None) -> np.ndarray:
    return hash_words(fold(text))[0]


def shingle_numbers(numbers: np.ndarray) -> np.ndarray:
    """One number for each five consecutive words; a shorter text, if not empty, is one shingle."""
    n = len(numbers)
    if not n:
        return numbers
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out += mix64(numbers[i : n - width + 1 + i] + _ODD[i]) * _ODD[i]
    return mix64(out + np.uint64(width))


def weighted_shingles(text: bytes | str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(shingle_numbers(word_numbers(text)), return_counts=True)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d); plain Jaccard where weights are alike."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) and not len(kb):
        return 1.0
    keys = np.union1d(ka, kb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ka)] = wa
    y[np.searchsorted(keys, kb)] = wb
    # elements with the same pair of weights count alike
    pairs, n = np.unique(np.column_stack((x, y)), axis=0, return_counts=True)
    total = 0.0
    for (p, q), m in zip(pairs, n, strict=True):
        if p and q:
            total += m / (np.maximum(pairs[:, 0] / p, pairs[:, 1] / q) * n).sum()
    return total
