"""Text expressions: normalisation, blank tests and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accent folding of lower-case letters: fixed values.
FOLDS = {
    "a": "áàâäãāăąæ",
    "e": "éèêëēĕėę",
    "i": "íìîïīĭį",
    "o": "óòôöõōŏőœ",
    "u": "úùûüūŭůűų",
    "y": "ýỳŷÿȳ",
    "n": "ñńņň",
    "c": "çćĉċč",
    "s": "ß",
}
FOLD_FROM = "".join(FOLDS.values())
FOLD_TO = "".join(base * len(letters) for base, letters in FOLDS.items())


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: str | Column, lowercase: bool = True, remove_accents: bool = True, prefix_space: bool = False) -> Column:
    """Lower-case, fold accents, and optionally start with one space."""
    out = _col(text)
    if lowercase:
        out = F.lower(out)
    if remove_accents:
        out = F.translate(out, FOLD_FROM, FOLD_TO)
    if prefix_space:
        out = F.when(out.startswith(" "), out).otherwise(F.concat(F.lit(" "), out))
    return out


def is_not_blank(text: str | Column) -> Column:
    """True where a text has a character that is not Unicode white space; null counts as blank."""
    return F.coalesce(_col(text).rlike("(?U)\\S"), F.lit(False))


def byte_length(text: str | Column) -> Column:
    """UTF-8 bytes of a text."""
    return F.octet_length(_col(text)).cast("long")
