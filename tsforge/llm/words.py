"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from tsforge.llm.common import worker_state

CACHED_WORDS = 300_000
CACHED_LENGTH = 48
#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """64-bit hash by word (bytes); two bounded generations."""

    def __init__(self) -> None:
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        value = self.older.get(word)
        if value is None:
            value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    return worker_state("hashes", WordHashes, alone=True)


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased: runs of anything but \\x20, \\x09 to \\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle; no words, none."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashed = word_hashes().of(found)
    n = max(1, len(hashed) - k + 1)
    out = np.full(n, np.uint64(min(k, len(hashed))))
    for i in range(min(k, len(hashed))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return np.unique(out)
