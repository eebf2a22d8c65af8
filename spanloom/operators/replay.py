"""Forward replay: values that a vault knows become their placeholders again in a further text, within a row and without a shuffle.

The longest value goes first. What was replaced is settled, so that no shorter value is looked for inside a placeholder. A value
counts only where no letter, digit or underscore touches it. An empty value is nowhere; a null text or vault gives the text unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "array<struct<settled:boolean,part:string>>"
EDGE = r"[\p{L}\p{N}_]"
#: Values of at most this many characters without separators are matched as they stand only.
SHORT = 3


def _escaped(v: Column) -> Column:
    return F.regexp_replace(v, r"([\\^$.|?*+()\[\]{}&#~-])", r"\\$1")


def _exact(v: Column) -> Column:
    return _escaped(v)


def _loose(v: Column) -> Column:
    """Whatever its case, and with other or no separators where it has some."""
    words = F.filter(F.split(v, r"[\s._-]+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?iu:"), F.array_join(F.transform(words, _escaped), r"[\s._-]*"), F.lit(")"))
    return F.when(F.length(F.array_join(words, "")) > SHORT, pattern).otherwise(_escaped(v))


def _replaced(text: Column, vault: Column, shape) -> Column:
    known = F.filter(vault, lambda e: F.trim(e["value"]) != "")
    # Of equally long values the one that comes first in the alphabet.
    ordered = F.array_sort(F.transform(known, lambda e: F.struct((-F.length(e["value"])).alias("n"), e["value"].alias("value"), e["placeholder"].alias("placeholder"))))

    def step(pieces: Column, e: Column) -> Column:
        pattern = F.concat(F.lit(f"(?<!{EDGE})"), shape(e["value"]), F.lit(f"(?!{EDGE})"))
        mark = F.struct(F.lit(True).alias("settled"), e["placeholder"].alias("part"))

        def cut(p: Column) -> Column:
            parts = F.transform(F.split(p["part"], pattern, -1), lambda x: F.struct(F.lit(False).alias("settled"), x.alias("part")))
            return F.when(p["settled"], F.array(p)).otherwise(F.flatten(F.transform(parts, lambda x, i: F.when(i > 0, F.array(mark, x)).otherwise(F.array(x)))))

        return F.flatten(F.transform(pieces, cut))

    begin = F.array(F.struct(F.lit(False).alias("settled"), text.alias("part"))).cast(PIECE)
    out = F.aggregate(ordered, begin, lambda p, e: step(p, e).cast(PIECE), lambda p: F.array_join(F.transform(p, lambda x: x["part"]), ""))
    return F.when(text.isNull() | vault.isNull(), text).otherwise(out)


def applied(text: Column, vault: Column) -> Column:
    """text with the values of a vault, an array of (placeholder, value, ...), as they stand replaced by their placeholders."""
    return _replaced(text, vault, _exact)


def replayed(text: Column, vault: Column) -> Column:
    """As applied, but whatever the case and separators (blanks, dots, dashes, underscores) of values of more than SHORT characters."""
    return _replaced(text, vault, _loose)
