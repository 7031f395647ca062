"""Word shingles of whole texts as 64-bit hashes, for many texts at once in numpy.

Words follow attestra.llm.words. A text of at least ``size`` words has one shingle for each run of ``size`` words; one
of fewer words, but not none, has a single shingle of all its words.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_rng = np.random.default_rng(20_240_601)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:48] = 0
_FOLD[58:65] = 0
_FOLD[91:97] = 0
_FOLD[123:128] = 0
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed bijection), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            have = len(_POWERS[i])
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(base, have, 2**64))])
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts -> the hashes of all their words, and where each text's words begin (one more entry at the end)."""
    data = _FOLD[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
    edge = np.diff((data != 0).astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = (p[: len(data)] for p in _powers(len(data)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    hashes = mixed((total[last] - total[first]) * inverse[first])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(first, begins)


def shingle_hashes(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts -> the hashes of their shingles in order, and where each text's shingles begin."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    end = np.repeat(at[1:], counts)
    place = np.arange(len(words))
    out = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        out += np.where(place + j < end, padded[j : j + len(words)] * _ODD[j], np.uint64(0))
    out = mixed(out)
    keep = (place + size <= end) | ((place == np.repeat(at[:-1], counts)) & (np.repeat(counts, counts) < size))
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def in_chunks(texts, most: int = 400_000):
    """(first, texts) runs of together about most bytes, so that the arrays of a step stay small. None counts as empty."""
    run, begin, total = [], 0, 0
    for i, t in enumerate(texts):
        t = b"" if t is None else t
        if run and total + len(t) > most:
            yield begin, run
            run, begin, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield begin, run
