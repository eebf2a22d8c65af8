"""Work on long texts and arrays within a row whose time grows with their length and not with its square.

``substring`` counts from a text's beginning, and an array that grows by one element is copied each time. Texts are
therefore cut into blocks once, and arrays are built in runs that are joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters in a block of a text, and elements in a run of an array.
BLOCK, RUN = 4096, 256


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The text in pieces of ``size`` characters; a null or empty one has none. Bind it as a column before cut() is given it."""
    n = F.length(text)
    places = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    long = F.transform(places, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(n <= size, F.filter(F.array(text), lambda x: x != "")).when(n > size, long).otherwise(F.array().cast("array<string>"))


def cut(parts: Column, start: Column, end: Column, size: int = BLOCK) -> Column:
    """The characters from start to end (exclusive) of a text in blocks."""
    i, j = F.floor(start / size).cast("int"), F.floor((end - 1) / size).cast("int")
    first = F.substring(F.get(parts, i), start - i * size + 1, F.least(end - start, F.lit(size)))
    last = F.substring(F.get(parts, j), F.lit(1), end - j * size)
    between = F.when(j > i + 1, F.array_join(F.slice(parts, i + 2, j - i - 1), "")).otherwise("")
    return F.when(end <= start, "").when(i == j, first).otherwise(F.concat(first, between, last))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value made once however often the body names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str, last: Callable[[Column], Column] | None = None, run: int = RUN) -> Column:
    """An array of what out(state, item) gives for each item, nulls left out, the state before an item being what step made of those before it.

    zero is a struct of all the state's fields with their types; kind is the type of what out gives; last(state) is one more at the end.
    """
    none = F.array().cast(f"array<{kind}>")
    there = lambda x: F.filter(F.array(x), lambda y: y.isNotNull())

    def one(held: Column, x: Column) -> Column:
        return F.struct(step(held["state"], x).alias("state"), F.concat(held["out"], there(out(held["state"], x))).alias("out"))

    def many(held: Column, i: Column, listed: Column) -> Column:
        inner = F.aggregate(F.slice(listed, i * run + 1, run), F.struct(held["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(held["out"], x["out"]).alias("out")))

    runs = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / run).cast("int"))).otherwise(F.array().cast("array<int>"))
    end = (lambda h: F.array_append(h["out"], there(last(h["state"])))) if last else (lambda h: h["out"])
    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    # An array that a row holds is read as a whole for each slice; one that a lambda has made is not.
    return let(F.transform(items, lambda x: x), lambda listed: F.flatten(F.aggregate(runs, start, lambda h, i: many(h, i, listed), end)))


def looked_up(keys: Column, entries: Column) -> Column:
    """For each of keys (an array of strings) the value of its entry, an array of struct<key, value>; null without one. Of entries of one key the least value counts.

    Both are sorted together and gone through once.
    """
    item = "struct<key:string,k:int,i:int,value:string>"
    listed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit(0).alias("k"), F.lit(0).alias("i"), e["value"].alias("value")).cast(item))
    asked = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.lit(1).alias("k"), i.alias("i"), F.lit(None).cast("string").alias("value")).cast(item))
    zero = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    new = lambda s, x: (x["k"] == 0) & ~s["key"].eqNullSafe(x["key"])
    step = lambda s, x: F.struct(F.when(new(s, x), x["key"]).otherwise(s["key"]).alias("key"), F.when(new(s, x), x["value"]).otherwise(s["value"]).alias("value"))
    out = lambda s, x: F.when(x["k"] == 1, F.struct(x["i"].alias("i"), F.when(s["key"] == x["key"], s["value"]).alias("value")))
    found = let(F.array_sort(F.concat(listed, asked)), lambda items: scanned(items, zero, step, out, "struct<i:int,value:string>"))
    return F.transform(F.array_sort(found), lambda x: x["value"])
