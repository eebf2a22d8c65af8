"""Substitutes of the same shape, as Column expressions: keyed, stable, and valid where the scheme has a check.

A substitute's digits and letters come from a keyed hash of the category and the value, by their place; none is
computed from the value's own digits, so the value can't be worked out from it. Separators and case stay. Cards keep
their first digit and get a Luhn digit, IBANs keep their country and get check digits, addresses keep their class, and
numbers of persons, companies and accounts get what closes the check of their scheme.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.checks import mod_of
from ..functions.drawing import chars, draw, relaid, seed, shaped
from . import checksummed

def luhn_digit(body: Column) -> Column:
    """The digit that makes a string of digits pass Luhn's test."""
    total = F.aggregate(
        F.transform(F.reverse(chars(body)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return ((10 - total % 10) % 10).cast("string")


def card(v: Column, s: Column) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    body = F.concat(F.substring(d, 1, 1), F.substring(shaped(d, s, False), F.lit(2), F.length(d) - 2))
    return relaid(v, F.concat(body, luhn_digit(body)))


def iban(v: Column, s: Column) -> Column:
    x = F.upper(F.regexp_replace(v, "[^0-9A-Za-z]", ""))
    body = F.substring(shaped(x, s), F.lit(5), F.length(x) - 4)
    country = F.substring(x, 1, 2)
    digits = F.array_join(F.transform(chars(F.concat(body, country, F.lit("00"))), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return relaid(v, F.concat(country, F.lpad((98 - mod_of(digits, 97)).cast("string"), 2, "0"), body))


def ip(v: Column, s: Column) -> Column:
    """Private, loopback and other special addresses keep what makes them so; public ones stay public."""
    part = F.split(v, r"\.")
    last = [draw(s, F.lit(i), 254) + 1 for i in range(4)]
    private = F.when(v.rlike(r"^(?:10|127)\."), F.concat_ws(".", part[0], last[1].cast("string"), last[2].cast("string"), last[3].cast("string")))
    private = private.when(v.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.concat_ws(".", part[0], part[1], last[2].cast("string"), last[3].cast("string")))
    # Blocks that are kept for documentation: nobody's.
    public = F.concat(F.element_at(F.array(F.lit("192.0.2."), F.lit("198.51.100."), F.lit("203.0.113.")), draw(s, F.lit(5), 3) + 1), last[3].cast("string"))
    return F.when(v.rlike(r"^[0-9.]+$"), private.otherwise(public)).otherwise(shaped(v, s))


def email(v: Column, s: Column) -> Column:
    """A local part of the same shape at a domain that nobody can own."""
    return F.concat(shaped(F.regexp_extract(v, "^([^@]*)", 1), s), F.lit("@"), F.substring(s, 1, 6), F.lit(".example"))


def date(v: Column, s: Column) -> Column:
    """The same layout: day and month up to 12 so that either order is a date, a year from 1940 on."""
    year = (1940 + draw(s, F.lit(7), 65)).cast("string")
    two = lambda i: F.lpad((draw(s, F.lit(i), 12) + 1).cast("string"), 2, "0")
    mark = F.regexp_extract(v, "([./-])", 1)
    return F.when(v.rlike("^[0-9]{4}"), F.concat(year, mark, two(1), mark, two(2))).otherwise(F.concat(two(1), mark, two(2), mark, F.when(v.rlike("[0-9]{4}$"), year).otherwise(F.substring(year, 3, 2))))


def phone(v: Column, s: Column) -> Column:
    """The prefix and its country stay, the other digits change."""
    keep = F.regexp_extract(v, r"^(\+[0-9]{1,2}|00[0-9]{1,2}|\(?[0-9])", 1)
    return F.concat(keep, shaped(F.substring(v, F.length(keep) + 1, F.length(v)), s, False))


def fake(v: Column, category: Column, key: str) -> Column:
    """A substitute for a value by its category."""
    s = seed(key, category, v)
    return (
        F.when(category == "card", card(v, s))
        .when((category == "iban") & v.rlike("^[A-Za-z]{2}[0-9]{2}"), iban(v, s))
        .when(category.isin(*checksummed.CATEGORIES), F.coalesce(checksummed.substitute(v, s, category), shaped(v, s)))
        .when(category == "ip", ip(v, s))
        .when(category == "email", email(v, s))
        .when(category.isin("dob", "date"), date(v, s))
        .when(category == "phone", phone(v, s))
        .when(category == "url", F.concat(F.lit("https://"), F.substring(s, 1, 10), F.lit(".example/"), F.substring(s, 11, 8)))
        .otherwise(shaped(v, s))
    )


def with_fakes(text: Column, vault: Column, key: str) -> Column:
    """The vault with substitutes in place of its tokens, except where one would be ambiguous.

    A substitute that the text already has, or that contains or lies in another one, keeps its token instead; so restoring is exact.
    """
    offered = F.transform(vault, lambda e: F.struct(e["placeholder"].alias("token"), e["value"].alias("value"), e["category"].alias("category"), fake(e["value"], e["category"], key).alias("fake")))

    def chosen(e: Column, offered: Column) -> Column:
        clash = F.contains(text, e["fake"]) | (F.length(e["fake"]) < 4) | F.exists(offered, lambda o: (o["token"] != e["token"]) & (F.contains(o["fake"], e["fake"]) | F.contains(e["fake"], o["fake"])))
        return F.struct(F.when(F.coalesce(clash, F.lit(True)), e["token"]).otherwise(e["fake"]).alias("placeholder"), e["value"].alias("value"), e["category"].alias("category"))

    return let(offered, lambda all_: F.transform(all_, lambda e: chosen(e, all_)))
