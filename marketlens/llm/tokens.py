"""Token ids of whole texts, by the public tokenizers library, with a cache of words.

The vocabulary `word_bpe_49k.json` drops white space before it splits words, so
the ids of a text are those of its blank-separated pieces in order. Invented or
rare words aside, pieces repeat, and a piece seen before costs one lookup.
"""

from __future__ import annotations

import os
from array import array
from string import punctuation

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Pieces a worker remembers; beyond, it forgets all and starts again. Bounds memory, never results.
CACHED_PIECES = 700_000
LATIN_END = "ɐ"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of a piece as little-endian unsigned 32-bit bytes; `encode` joins those of a text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.model = self.whole.model
        self.letters = _byte_letters()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > CACHED_PIECES:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and piece.islower() and (piece.isascii() or max(piece) < LATIN_END):
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        else:
            head = piece.rstrip(punctuation)
            lower = head.lower()
            if head.isalpha() and max(lower) < LATIN_END and len(lower) == len(head) and lower != piece and lower.islower():
                ids = self[lower] + self[piece[len(head):]] if len(head) < len(piece) else self[lower]
            else:
                ids = self._slow(piece)
        self[piece] = ids
        return ids

    def _slow(self, piece: str) -> bytes:
        return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str = VOCABULARY, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
