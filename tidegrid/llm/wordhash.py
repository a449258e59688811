"""64-bit hashes of words and word shingles of many texts at once, with numpy.

A word's hash is a polynomial over its bytes, taken as the difference of two prefix sums, so that no Python loop
runs over words. Texts are processed in blocks of about `BLOCK` bytes, cut between texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data`, the bytes of texts that end at `ends`, and each word's text number."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * inverse[s]), np.searchsorted(ends, s, side="right")


def blocks(texts: pa.Array):
    """(number of the first text, hashes of words, text number of each word from 0, texts) by block."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        w, doc = _words(data[at[i] : at[j]], at[i + 1 : j + 1] - at[i])
        yield i, w, doc, j - i
        i = j


def shingles(words: np.ndarray, doc: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and the text of each; fewer than k words make one shingle."""
    count = np.bincount(doc, minlength=texts)
    n = len(words)
    acc, out, owner = np.full(n, 0x51ED270B, np.uint64), [], []
    starts = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    with np.errstate(over="ignore"):
        for i in range(min(k, n)):
            acc = mix(acc[: n - i] * np.uint64(0x2545F4914F6CDD1D) + words[i:])
            short = np.flatnonzero(count == i + 1)
            if i + 1 < k and len(short):
                out.append(acc[starts[short]] ^ np.uint64(i + 1))
                owner.append(short)
        if n >= k:
            whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            out.append(acc[whole])
            owner.append(doc[whole])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, o = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(o, kind="stable") if len(out) > 1 else slice(None)
    return h[order], o[order]


def shingle_sets(texts: pa.Array, k: int):
    """For each text in turn its sorted array of distinct shingle hashes."""
    for _, words, doc, n in blocks(texts):
        h, owner = shingles(words, doc, n, k)
        cuts = np.searchsorted(owner, np.arange(n + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(h[a:b])
