"""Word positions and hashes of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed in one go, about; a longer text goes alone.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 512
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one more at the end)."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buffer]
    solid = ~space
    starts = np.flatnonzero(solid & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], solid[:-1])))
    up, down = _powers(len(buffer) + 1)
    sums = np.cumsum(_BYTE[buffer] * up[: len(buffer)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0)) if len(starts) else np.zeros(0, dtype=np.uint64)
    hashes = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else before
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, edges)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, ignoring text borders."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        out += words[k : k + n] * np.uint64(factor | 1)
    return mix(out)


def chunks(texts: list[bytes], rows: int = CHUNK_ROWS):
    """(first, last) ranges of texts of about ``CHUNK_BYTES``, and of at most ``rows`` texts."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and (size + len(text) > CHUNK_BYTES or k - first >= rows):
            yield first, k
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)
