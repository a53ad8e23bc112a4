"""Text helpers as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Composed Latin letters all lie below the CJK blocks.
_LAST_LETTER_BLOCK = 0x3000
# Every white-space character: tabs, no-break spaces, separators, ...
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def trim_text(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(trim_text(c), F.lit(""))


def text_or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(trim_text(c), F.lit("")), F.lit(default))


@cache
def _composed_letters() -> tuple[str, str]:
    """Composed characters whose decomposition is one ASCII letter plus marks, and those letters.

    Spark SQL has no NFD function, so composed letters go through one
    `translate`; the table follows from the Unicode data, not from a list.
    """
    composed, plain = [], []
    for code in range(0x80, _LAST_LETTER_BLOCK):
        char = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", char) if not unicodedata.combining(x))
        if bare != char and len(bare) == 1 and bare.isascii() and bare.isalpha():
            composed.append(char)
            plain.append(bare)
    # The barred d has no decomposition.
    return "".join(composed) + "đĐ", "".join(plain) + "dd"


def fold_accents(c: Column) -> Column:
    """Lower-case text without diacritics."""
    composed, plain = _composed_letters()
    return F.lower(F.regexp_replace(F.translate(c, composed, plain), r"\p{M}+", ""))


def strip_accents(c: Column) -> Column:
    """Lower-case text without diacritics, trimmed."""
    return trim_text(fold_accents(c))


def normalize_header(c: Column) -> Column:
    """Accent-free lower-case words separated by one blank."""
    return F.trim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", " "))


def contains_pattern(c: Column, text: str) -> Column:
    """Case-insensitive LIKE '%text%'; `%` and `_` in the text are wildcards, a backslash is not special."""
    return F.lower(c).like("%" + text.lower().replace("\\", "\\\\") + "%")


def parent_sku(variant: Column) -> Column:
    """The part of a variant code before its first dash."""
    return F.split_part(variant, F.lit("-"), F.lit(1))
