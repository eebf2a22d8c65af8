"""Gates on a document's spans: which of them are no values after all, and where their edges lie. All within a row, JVM-only.

Spans are arrays of detect.SPAN. Each gate takes the array (and the text where it looks around) and gives an array of those that stay, in
their order. A null or empty array gives itself. What is compared with what is sorted first, so a document's spans cost their number, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories whose values may be digits only.
NUMERIC = ("card", "phone", "national_id", "company_id", "iban", "secret", "reference", "amount")


def covered(spans: Column) -> Column:
    """array<boolean> by place in the order of (start, -end): whether a longer span that begins before or with each one reaches over it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    zero = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<boolean>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        end = -s["back"]
        return F.struct(F.greatest(state["reach"], end).alias("reach"), F.array_append(state["out"], end <= state["reach"]).alias("out"))

    return F.aggregate(ordered, zero, step, lambda s: s["out"])


def denested(spans: Column) -> Column:
    """Without values of which every occurrence lies within a longer span: one free occurrence keeps all of a value's.

    Of equal stretches the one of the lower rank counts as the longer one.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"), s["value"].alias("value"))))
    zero = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("free"))

    def step(state: Column, s: Column) -> Column:
        end = -s["back"]
        return F.struct(F.greatest(state["reach"], end).alias("reach"), F.when(end > state["reach"], F.array_append(state["free"], s["value"])).otherwise(state["free"]).alias("free"))

    free = F.aggregate(ordered, zero, step, lambda s: F.array_distinct(s["free"]))
    return F.filter(spans, lambda s: F.array_contains(free, s["value"]))


def numbers_with_meaning(spans: Column, numeric: Sequence[str] = NUMERIC) -> Column:
    """Without values of digits alone, unless their category gives digits a meaning."""
    return F.filter(spans, lambda s: ~s["value"].rlike(r"^[0-9\s.,]+$") | s["category"].isin(*numeric))


def without_terms(spans: Column, terms: Column) -> Column:
    """Without values whose words are all terms (lower-case, an array) that name nothing."""
    words = lambda v: F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(spans, lambda s: F.exists(words(s["value"]), lambda w: ~F.array_contains(terms, w)) | (F.size(words(s["value"])) == 0))


def trimmed(spans: Column) -> Column:
    """Spans without blanks, quotes and marks at their ends; those of nothing else go."""
    lead = lambda v: F.length(v) - F.length(F.regexp_replace(v, r"^[\s\"'“”«»(\[{,;:.!?–-]+", ""))
    core = lambda v: F.regexp_replace(F.regexp_replace(v, r"^[\s\"'“”«»(\[{,;:.!?–-]+", ""), r"[\s\"'“”«»)\]},;:.!?–-]+$", "")

    def cut(s: Column) -> Column:
        value = core(s["value"])
        start = s["start"] + lead(s["value"])
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["type"].alias("type"), s["category"].alias("category"), s["rank"].alias("rank"))

    return F.filter(F.transform(spans, cut), lambda s: s["value"] != "")


def by_line(spans: Column, categories: Sequence[str] = ("name", "company")) -> Column:
    """A span over several lines of those categories as one for each line that isn't blank."""

    def parts(s: Column) -> Column:
        lines = F.split(s["value"], "\n")
        zero = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,type:string,category:string,rank:int>>").alias("out"))

        def step(state: Column, line: Column) -> Column:
            end = state["at"] + F.length(line)
            one = F.struct(state["at"].alias("start"), end.alias("end"), line.alias("value"), s["type"].alias("type"), s["category"].alias("category"), s["rank"].alias("rank"))
            return F.struct((end + 1).alias("at"), F.when(F.trim(line) != "", F.array_append(state["out"], one)).otherwise(state["out"]).alias("out"))

        return F.aggregate(lines, zero, step, lambda x: x["out"])

    return F.flatten(F.transform(spans, lambda s: F.when(s["category"].isin(*categories) & s["value"].contains("\n"), parts(s)).otherwise(F.array(s))))


def anchored_places(spans: Column, places: Sequence[str] = ("location",)) -> Column:
    """Places stay only beside a span of another category."""
    return F.when(F.exists(spans, lambda s: ~s["category"].isin(*places)), spans).otherwise(F.filter(spans, lambda s: ~s["category"].isin(*places)))


def longest_valid(value: Column, check: Callable[[Column], Column], trims: int = 12) -> Column:
    """value without as few of its last words (at most trims) as make it pass the check; null where none does, or for a null value."""
    words = F.split(value, " ")
    n = F.size(words)
    cuts = F.sequence(F.lit(0), F.least(n - 1, F.lit(trims)))
    return F.when(value.isNotNull(), F.get(F.filter(F.transform(cuts, lambda k: F.array_join(F.slice(words, F.lit(1), n - k), " ")), lambda x: F.coalesce(check(x), F.lit(False))), F.lit(0)))
