"""Word shingles as 64-bit hashes. Words are runs of anything but ``[\\x20\\x09-\\x0D]``, with A-Z in lower case."""

from __future__ import annotations

import numpy as np
import xxhash

from .caches import worker_cache

WIDTH = 5
CACHE_ENTRIES = 250_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values; different salts give independent orders."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("shingles", "words", _Hashes).__getitem__, words), np.uint64, len(words))


def shingle_sequence(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of ``width`` words; of all words if there are fewer; nothing without words."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    total = words[: n - width + 1].copy()
    for i in range(1, width):
        total = total * _MULTIPLIER + words[i : n - width + 1 + i]
    return mixed(total, width)


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` values, by doubling; nothing if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, piece, span, power = np.zeros(n, np.uint64), 0, values, 1, int(_MULTIPLIER)
    while done < width:
        if width & span:
            total = total * np.uint64(power) + piece[done : done + n]
            done += span
        if done < width:
            piece = piece[:-span] * np.uint64(power) + piece[span:]
            span, power = 2 * span, power * power & 0xFFFFFFFFFFFFFFFF
    return mixed(total, width)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_sequence(word_hashes(split_words(text)), width))
