"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _latin_with_marks() -> dict[str, str]:
    """Each Latin letter with a mark, and its plain letter, by the letters' Unicode names."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        found = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER (?:DOTLESS )?([A-Z])(?: WITH .+)?", unicodedata.name(chr(code), ""))
        if found:
            out[chr(code)] = found[2].lower() if found[1] == "SMALL" else found[2]
    return out


_FOLDED = _latin_with_marks()


def fold_accents(v: Column) -> Column:
    """Latin letters without their marks; combining marks go too."""
    return F.regexp_replace(F.translate(v, "".join(_FOLDED), "".join(_FOLDED.values())), "[̀-ͯ]", "")


def entity_key(v: Column) -> Column:
    """What makes two spellings one entity: no case, no blanks, dots, dashes or underscores."""
    return F.regexp_replace(F.lower(v), r"[\s._-]+", "")


def normalized(v: Column) -> Column:
    """Lower case without accents; letters, digits, @ and inner dots; one blank between words."""
    kept = F.regexp_replace(fold_accents(F.lower(v)), r"[^a-z0-9@.぀-ヿ一-鿿]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"(?:^|(?<= ))\.+|\.+(?= |$)", ""), " +", " "))


def scrubbed(v: Column) -> Column:
    """An error message without what is personal or changes from case to case, at most 200 characters."""
    out = v
    # In this order: what is wider goes first.
    for pattern, name in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>"),
        (r"[a-z]+://[^\s\"']+", "<url>"),
        (r"(?:/[A-Za-z0-9._-]+){2,}", "<path>"),
        (r"[0-9a-fA-F]{16,}", "<token>"),
        (r"[0-9]+", "<n>"),
    ):
        out = F.regexp_replace(out, pattern, name)
    return F.substring(out, 1, 200)


def estimated_tokens(v: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(v) / 4)


def human_number(v: Column) -> Column:
    """850 000, 1 234,56, 1,000,000 and 1.234,5 as a number; null for anything else.

    Blanks and apostrophes group. Of dots and commas the last one is the decimal mark, unless it comes more than once or
    is alone with three digits behind it.
    """
    bare = F.regexp_replace(v, "[\\s'  ]", "")
    last = F.regexp_extract(bare, r"([.,])[0-9]*$", 1)
    many = F.length(bare) - F.length(F.replace(bare, last, F.lit(""))) > 1
    other = F.when(last == ",", ".").otherwise(",")
    grouping = (last == "") | many | (bare.rlike(r"^[-+]?[0-9]{1,3}[.,][0-9]{3}$"))
    plain = F.when(grouping, F.translate(bare, ".,", "")).otherwise(F.replace(F.replace(bare, other, F.lit("")), last, F.lit(".")))
    return F.when(bare.rlike(r"^[-+]?[0-9]+(?:[.,][0-9]+)*$"), plain.try_cast("double"))


def recased(fake: Column, like: Column) -> Column:
    """fake in the case of like: all upper, all lower, or with capitals."""
    letters = F.regexp_replace(like, r"[^\p{L}]", "")
    return F.when(letters == "", fake).when(letters == F.upper(letters), F.upper(fake)).when(letters == F.lower(letters), F.lower(fake)).otherwise(F.initcap(fake))


def positions(text: Column, needle: Column) -> Column:
    """All places (from 0) of a needle in a text, those that overlap too."""
    last = F.length(text) - F.length(needle)
    return F.when((F.length(needle) == 0) | (last < 0), F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.length(needle)) == needle))


def windows(text: Column, size: int = 250, overlap: int = 50) -> Column:
    """array<struct<start, part>>: windows of a text for a model with a short reach."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(F.filter(starts, lambda s: (s == 0) | (s + overlap < n)), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("part")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
