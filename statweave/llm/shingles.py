"""Word shingles of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
# Fixed odd multipliers that tell the places of a shingle apart.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than space and \\x09-\\x0D, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct shingles in ascending order; fewer words than five make one, no word none."""
    words = words_of(text)
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    values = word_hashes(words)
    if n < WORDS:
        return mixed((values * ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = values[: n - WORDS + 1] * ODD[0]
    for j in range(1, WORDS):
        total += values[j : n - WORDS + 1 + j] * ODD[j]
    return np.unique(mixed(total))
