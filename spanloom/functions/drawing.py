"""Keyed draws and shapes: what substitutes are made from, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def seed(key: str, tag: Column | str, value: Column) -> Column:
    """128 hex digits that nobody without the key can predict: a hash within a hash, keyed twice."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), t, value), 256)
    return F.concat(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("1"), inner), 256), F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("2"), inner), 256))


def draw(s: Column, i: Column, n: int | Column) -> Column:
    """A number below n for a place, from three of the seed's hex digits."""
    return F.conv(F.substring(s, F.pmod(i * 3, F.lit(125)) + 1, F.lit(3)), 16, 10).cast("int") % n


def chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda x: x != "")


def shaped(v: Column, s: Column, letters: bool = True) -> Column:
    """Every digit, and every letter if wanted, by one from the seed; a leading digit that isn't 0 stays so."""

    def one(c: Column, i: Column) -> Column:
        digit = F.when((i == 0) & (c != "0"), draw(s, i, 9) + 1).otherwise(draw(s, i, 10)).cast("string")
        out = F.when(c.rlike("[0-9]"), digit)
        if letters:
            out = out.when(c.rlike("[a-z]"), F.substring(F.lit(_LOWER), draw(s, i, 26) + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.substring(F.lit(_UPPER), draw(s, i, 26) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(chars(v), one), "")


def relaid(v: Column, plain: Column, places: str = "[0-9A-Za-z]") -> Column:
    """The characters of plain in the places of v's letters and digits, small ones where v's are; separators stay."""
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(t: Column, c: Column) -> Column:
        solid, one = c.rlike(places), F.substring(plain, t["at"], F.lit(1))
        return F.struct(F.when(solid, t["at"] + 1).otherwise(t["at"]).alias("at"), F.concat(t["out"], F.when(solid, F.when(c.rlike("[a-z]"), F.lower(one)).otherwise(one)).otherwise(c)).alias("out"))

    return F.aggregate(chars(v), zero, step, lambda t: t["out"])
