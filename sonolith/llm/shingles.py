"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SIZE = 5
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)
#: Words remembered by a worker; a memory bound that changes no result.
REMEMBERED = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> _S)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word, A-Z lower-cased; bytes.split() cuts at exactly x20 and x09-x0D."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``size`` words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    short = len(words) < size
    width = len(words) if short else size
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64) * _B
    for k in range(width):
        h = mixed((h ^ words[k : k + n]) * _A + _B)
    return np.unique(h)


def digest(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()
