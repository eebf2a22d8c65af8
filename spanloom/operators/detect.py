"""Detection: documents to spans, without a shuffle and in the JVM, but for the test of what a large catalogue's rules can match (gatekeeper).

A rule's matches are marked in the text by two control characters and the text is split at
them; every second part is a value and the parts before it give its place, in code points. A text is scanned
by a rule only where it can match: where the lower-cased text holds a string that the rule's matches hold, enough digits, and what the rule's probe finds.
Control characters of the text itself are read as blanks.

Null and empty texts have no spans. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, scanned
from ..functions.checks import CHECKS
from . import gatekeeper
from .dictionary import scan
from .rules import Rule

#: Rules with more strings than this look for them in one pass in Arrow batches, others one after the other in the JVM.
FEW = 48
OPEN, CLOSE = "\x01", "\x02"
SPAN = "struct<start:int,end:int,value:string,type:string,category:string,rank:int>"


def _clean(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.contains(whole, F.lit(OPEN)) | F.contains(whole, F.lit(CLOSE)), F.translate(whole, OPEN + CLOSE, "  ")).otherwise(whole)


def _can_match(rule: Rule, gate: Callable[[Rule], list[Column]] | None = None) -> Column:
    """Over _clean, _low, _1 and _6: cheap tests first, a search for a string costs far less than one for a pattern. gate gives tests that take the strings' place."""
    out = None
    strings = [reduce(or_, [F.contains(F.col("_low"), F.lit(x)) for x in sorted(rule.literals)])] if rule.literals and gate is None else []
    for x in (
        F.col(f"_{rule.digits}") if rule.digits else None,
        *(gate(rule) if gate else strings),
        F.col("_clean").rlike(rule.probe or rule.regex) if not rule.literals and (rule.probe or not rule.digits) else None,
    ):
        if x is not None:
            out = x if out is None else out & x
    return out


def _gated(rules: Sequence[Rule]) -> tuple[Callable[[Rule], list[Column]], Column]:
    """What each rule asks of _gates, and the expression of _gates over _low. A rule of alternatives asks for what one of them holds."""
    either = {r: frozenset().union(*(s for s, n in r.branches if n < gatekeeper.RUN)) for r in rules if not r.literals and r.branches and all(n >= gatekeeper.RUN or s and min(map(len, s)) > 2 for s, n in r.branches)}
    groups = sorted({tuple(sorted(s)) for s in [*(r.literals for r in rules), *either.values()] if s})
    number = {g: i for i, g in enumerate(groups)}

    def gate(rule: Rule) -> list[Column]:
        open_ = lambda strings: gatekeeper.is_open(F.col("_gates"), number[tuple(sorted(strings))])
        run = gatekeeper.is_open(F.col("_gates"), len(groups))
        if rule in either:
            return [reduce(or_, ([open_(either[rule])] if either[rule] else []) + ([run] if any(n >= gatekeeper.RUN for _, n in rule.branches) else []))]
        return ([open_(rule.literals)] if rule.literals else []) + ([run] if rule.run >= gatekeeper.RUN else [])

    return gate, gatekeeper.open_gates(F.col("_low"), groups)


def _pieces(text: Column, rule: Rule, rank: int, gate: Callable[[Rule], list[Column]] | None = None) -> Column:
    """A rule's number and the text split at its matches; null where it can't match."""
    marked = F.regexp_replace(text, rule.regex, f"$1{OPEN}$2{CLOSE}")
    return F.struct(F.lit(rank).alias("rank"), F.when(_can_match(rule, gate), F.split(marked, f"[{OPEN}{CLOSE}]", -1)).alias("parts"))


def _placed(found: Column) -> Column:
    """Every second part with its place."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"))

    def step(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + F.length(part)).alias("at"), (~state["inside"]).alias("inside"))

    def out(state: Column, part: Column) -> Column:
        span = F.struct(state["at"].alias("start"), (state["at"] + F.length(part)).alias("end"), part.alias("value"), found["rank"].alias("rank"))
        return F.when(state["inside"] & (part != ""), span)

    return scanned(found["parts"], zero, step, out, "struct<start:int,end:int,value:string,rank:int>")


def _names(values: Sequence[str | None]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _passes(check: Column, value: Column, used: Sequence[str]) -> Column:
    """Each check once, whatever the number of rules that name it."""
    out = F.lit(True)
    for name in used:
        out = F.when(check == name, CHECKS[name](value)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def with_spans(docs: DataFrame, rules: Sequence[Rule], text: str = "text", into: str = "spans") -> DataFrame:
    """docs and an array of all rules' spans, by rule and place; they may overlap."""
    rules = list(rules)
    used = sorted({r.check for r in rules if r.check})
    # Digits that stand together, with at most one other character between two.
    clean = docs.withColumn("_clean", _clean(F.col(f"`{text}`"))).withColumns({"_low": F.lower("_clean"), "_1": F.col("_clean").rlike("[0-9]")}).withColumn("_6", F.col("_1") & F.col("_clean").rlike("[0-9](?s:.?[0-9]){5}"))
    gate = None
    if sum(len(r.literals) for r in rules) > FEW:
        gate, opened = _gated(rules)
        clean = clean.withColumn("_gates", opened)
    split = clean.withColumn("_found", F.filter(F.array(*[_pieces(F.col("_clean"), r, i, gate) for i, r in enumerate(rules)]), lambda x: x["parts"].isNotNull()))
    placed = split.withColumn("_found", F.flatten(F.transform("_found", _placed)))
    if used:
        checks = _names([r.check or "" for r in rules])
        placed = placed.withColumn("_found", F.filter("_found", lambda s: _passes(F.element_at(checks, s["rank"] + 1), s["value"], used)))
    types, categories = _names([r.type for r in rules]), _names([r.category for r in rules])
    named = F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(types, s["rank"] + 1).alias("type"), F.element_at(categories, s["rank"] + 1).alias("category"), s["rank"].alias("rank")))
    return placed.withColumn(into, named if rules else F.array().cast(f"array<{SPAN}>")).drop("_clean", "_low", "_1", "_6", "_gates", "_found")


def claimed(spans: Column) -> Column:
    """The spans that keep their characters, by rule and place: in the order of rules and places, those that overlap none before them.

    Only spans of one stretch, which overlaps no other, are held against each other.
    """
    kind = f"array<struct<rank:int,start:int,span:{SPAN}>>"

    def free(held: Column, s: Column) -> Column:
        return F.when(F.exists(held, lambda x: (x["span"]["start"] < s["span"]["end"]) & (s["span"]["start"] < x["span"]["end"])), held).otherwise(F.array_append(held, s))

    def judged(stretch: Column) -> Column:
        return F.when(F.size(stretch) < 2, stretch).otherwise(F.aggregate(F.array_sort(stretch), F.array().cast(kind), free))

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["reach"]
        one = F.struct(s["span"]["rank"].alias("rank"), s["start"].alias("start"), s["span"].alias("span"))
        return F.struct(F.greatest(state["reach"], s["span"]["end"]).alias("reach"), F.when(apart, F.array(one)).otherwise(F.array_append(state["stretch"], one)).cast(kind).alias("stretch"))

    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("stretch"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s.alias("span"))))
    ended = let(ordered, lambda x: scanned(x, zero, step, lambda state, s: F.when(s["start"] >= state["reach"], judged(state["stretch"])), kind, lambda state: judged(state["stretch"])))
    return F.transform(F.array_sort(F.flatten(ended)), lambda x: x["span"])


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores where they come in fewer partitions than there are: a scan by many rules takes far longer than that shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def spans(docs: DataFrame, rules: Sequence[Rule], *keys: str, text: str = "text", resolve: bool = True) -> DataFrame:
    """keys and a row for each span."""
    found = with_spans(docs, rules, text)
    if resolve:
        found = found.withColumn("spans", claimed(F.col("spans")))
    # An inner explode would be filtered by the array's size first, and for that the scan would run once more.
    return found.select(*keys, F.explode_outer("spans").alias("_s")).filter("_s is not null").select(*keys, "_s.*")


def outside(found: DataFrame, zones: DataFrame, *keys: str, exempt: Sequence[str] = ()) -> DataFrame:
    """The rows of found, but for values of which every occurrence in a document lies in one of its zones (keys, start, end).

    Categories in exempt stay. One interval join on the document, then a minimum for each value.
    """
    z = zones.select(*[F.col(k).alias(f"_z_{k}") for k in keys], F.col("start").alias("_from"), F.col("end").alias("_to"))
    on = [found[k].eqNullSafe(z[f"_z_{k}"]) for k in keys] + [z["_from"] <= found["start"], found["end"] <= z["_to"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    per = found.join(z, condition, "left").groupBy(*keys, "value", "start").agg(F.max(F.col("_from").isNotNull().cast("int")).alias("_in"))
    kept = per.groupBy(*keys, "value").agg(F.min("_in").alias("_in")).filter("_in = 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("value").alias("_v"))
    match = found["value"] == kept["_v"]
    for k in keys:
        match = match & found[k].eqNullSafe(kept[f"_k_{k}"])
    if exempt:
        match = match & ~found["category"].isin(*exempt)
    return found.join(kept, match, "left_anti")


def without(found: DataFrame, keep: DataFrame) -> DataFrame:
    """Spans whose value isn't on a list (value), whatever its case and surrounding blanks."""
    listed = keep.select(F.lower(F.trim("value")).alias("_keep")).distinct()
    return found.join(listed, F.lower(F.trim(found["value"])) == listed["_keep"], "left_anti")


def exact(docs: DataFrame, secrets: DataFrame, *keys: str, text: str = "text", least: int = 4) -> DataFrame:
    """keys, value of listed secrets (value) that a text holds anywhere, trimmed and of at least ``least`` characters."""
    listed = secrets.select(F.trim("value").alias("value"))
    return scan(docs, listed, *keys, text=text, edges=False, once=True, least=least).select(*keys, "value").distinct()


def deduped(found: DataFrame, *keys: str) -> DataFrame:
    """Spans (keys, start, end, label, score): of two of a label that share over half of the shorter one, the one of the higher score (then the earlier)."""
    other = found.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("label").alias("_label"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("score").alias("_score"))
    same = found["label"] == other["_label"]
    for k in keys:
        same = same & found[k].eqNullSafe(other[f"_o_{k}"])
    shared = F.least(found["end"], other["_e"]) - F.greatest(found["start"], other["_s"])
    over = 2 * shared > F.least(found["end"] - found["start"], other["_e"] - other["_s"])
    better = F.struct(other["_score"], -other["_s"], -other["_e"]) > F.struct(found["score"], -found["start"], -found["end"])
    return found.join(other, same & (other["_s"] < found["end"]) & (found["start"] < other["_e"]) & over & better, "left_anti")
