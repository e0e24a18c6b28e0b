"""Column functions over text: lengths, digits, check digits, folding of case and accents."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of a PESEL's first ten digits.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
MARKS = "[\\u0300-\\u036f]"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


@functools.cache
def _digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and their values."""
    other = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


def ascii_digits(c: Column) -> Column:
    """The decimal digits of ``c``, of any script, as ASCII."""
    return F.regexp_replace(F.translate(c, *_digits()), "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pesel_valid(digits: Column) -> Column:
    """Eleven digits of which the last closes the weighted sum of the others to a multiple of ten; dates aren't looked at."""
    each = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    total = F.aggregate(F.zip_with(each, F.array(*map(F.lit, PESEL_WEIGHTS)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) == 11, (10 - total % 10) % 10 == F.substring(digits, 11, 1).cast("int")).otherwise(F.lit(False))


def ipv4_valid(value: Column) -> Column:
    """Four parts of ASCII digits up to 255; leading zeros are fine."""
    parts = F.split(value, "[.]")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def _folds() -> tuple[str, str]:
    """Letters with accents, one code point each, and the small letters that they fold to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0].lower()) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.category(unicodedata.normalize("NFD", chr(c))[-1]) == "Mn"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLDS = _folds()


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column) -> Column:
    """``c`` without case and accents, code point by code point: positions stay."""
    return F.lower(F.when(is_ascii(c), c).otherwise(F.translate(c, *FOLDS)))


def fold_away(c: Column) -> Column:
    """``c`` folded and without combining marks, for comparing."""
    return without_marks(fold(c))


def without_marks(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, MARKS, ""))


# Letters that fold to more than one.
WIDE = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def widened(c: Column) -> Column:
    """Folded text with its sharp s and ligatures written out."""
    out = c
    for one, more in WIDE.items():
        out = F.replace(out, F.lit(one), F.lit(more))
    return F.when(c.rlike("[" + "".join(WIDE) + "]"), out).otherwise(c)


def folded_away(phrase: str) -> str:
    """``fold_away`` of a constant, written out as ``widened`` has it."""
    folded = re.sub(MARKS, "", phrase.translate(dict(zip(map(ord, FOLDS[0]), FOLDS[1]))).lower())
    return "".join(WIDE.get(x, x) for x in folded)


def spellings() -> dict[str, list[list[str]]]:
    """Runs of letters that one letter may stand for, the longest first, with all ways to write them."""
    def ways(run: str) -> list[list[str]]:
        heads = [[run[0], 1], *([one, len(more)] for one, more in WIDE.items() if run.startswith(more))]
        return [[one, *rest] for one, n in heads for rest in (ways(run[n:]) if run[n:] else [[]])]

    runs = {*WIDE.values(), "sst"}  # of which the last two may be one letter, too
    return {run: ways(run) for run in sorted(runs, key=lambda x: (-len(x), x))}


def longer_than(c: Column, limit: int) -> Column:
    """Whether a text has more than ``limit`` characters as people count them: grapheme clusters, which are told apart only where code points are too many."""
    return F.coalesce(F.when(F.char_length(c) > limit, F.regexp_count(c, F.lit("\\X")) > limit), F.lit(False))


def trimmed(c: Column) -> Column:
    """``c`` without white space and line breaks at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def readable(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def saturating_multiply(a: Column, b: Column) -> Column:
    """Product of two positive longs, the largest long where it doesn't fit."""
    return F.coalesce(F.try_multiply(a, b), F.lit(9223372036854775807))
