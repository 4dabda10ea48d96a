"""Words and word shingles of whole texts, for functions that run in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than [\\x20\\x09-\\x0D] of the text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by one space; fewer words give the whole sequence, none give none."""
    if not tokens:
        return []
    line = b" ".join(tokens)
    if len(tokens) <= size:
        return [line]
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1, out=starts[1:])
    return [line[a:b] for a, b in zip(starts[: len(tokens) - size + 1].tolist(), (starts[size:] - 1).tolist())]


def hashes(items: list[bytes], seed: int = 42) -> np.ndarray:
    """XXH64 of each item, unsigned."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(item, seed) for item in items), dtype=np.uint64, count=len(items))


def remixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of already hashed values; salt 0 leaves them as they are."""
    if not salt:
        return values
    odd = np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (values ^ (values >> np.uint64(31))) * odd
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
