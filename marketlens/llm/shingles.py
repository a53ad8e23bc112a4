"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
CACHED_WORDS = 100_000
LOWER_A_TO_Z = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; bytes are split on exactly these blanks."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_A_TO_Z).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingles, sorted; a shorter text is one shingle, a text without words has none."""
    own = word_hashes(lower_words(text))
    if not len(own):
        return own
    width = min(width, len(own))
    n = len(own) - width + 1
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = rolled * FACTOR + own[k : k + n]
    return np.unique(mixed(rolled))
