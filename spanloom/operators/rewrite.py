"""Rewriting and restoring: values to markers or tokens and back, within a row and without a shuffle.

A vault is an array of (placeholder, value, category) in a row: one entry for each distinct value of a scope, here a
document. Numbers go on after the largest one in a marker that the text already has, so a text's own markers are never restored by mistake.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import blocks, cut, let, looked_up
from .detect import SPAN, claimed, with_spans
from .fakes import with_fakes
from .rules import Rule

ENTRY = "struct<placeholder:string,value:string,category:string>"
#: Between the parts of a key; no value holds it.
SEPARATOR = "\x01"
#: Labels that differ from the upper-cased type.
LABELS = {"api_token": "TOKEN", "bearer": "BEARER_TOKEN", "hash_token": "TOKEN", "hex40": "TOKEN", "phone_us": "PHONE", "ipv4": "IP", "card_number": "CARD"}
#: Token words that differ from the upper-cased category.
WORDS = {"name": "PERSON", "national_id": "ID", "location": "LOCATION", "company": "COMPANY", "apikey": "APIKEY", "number": "NUM"}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    out = F.upper(value)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def label(span_type: Column) -> Column:
    return _mapped(span_type, LABELS)


def word(category: Column) -> Column:
    return _mapped(category, WORDS)


def _highest(text: Column, pattern: str) -> Column:
    """The largest number in a marker of the text, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast("int"))), F.lit(0))


def vault_of(spans: Column, taken: Column, style: str) -> Column:
    """Entries in the order of spans: a number of its own for each value of a label (style: marker or token)."""
    name = (lambda s: label(s["type"])) if style == "marker" else (lambda s: word(s["category"]))
    # Detection leaves no control characters in a value.
    known = F.array_distinct(F.transform(spans, lambda s: F.concat_ws(SEPARATOR, name(s), s["category"], s["value"])))

    def entries(keys: Column, taken: Column) -> Column:
        """Each label's in turn, with their places among all."""
        placed = F.transform(keys, lambda k, i: F.struct(i.alias("i"), k.alias("key"), F.substring_index(k, SEPARATOR, 1).alias("label")))
        labels = F.array_distinct(F.transform(keys, lambda k: F.substring_index(k, SEPARATOR, 1)))
        own = let(placed, lambda p: F.transform(labels, lambda x: F.filter(p, lambda e: e["label"] == x)))
        return F.array_sort(F.flatten(F.transform(own, lambda es: F.transform(es, lambda e, j: F.struct(e["i"].alias("i"), e["key"].alias("key"), e["label"].alias("label"), (j + 1 + taken).alias("n"))))))

    def entry(e: Column) -> Column:
        number = e["n"].cast("string")
        text = F.concat(F.lit("[REDACTED_"), e["label"], F.lit("_"), number, F.lit("]")) if style == "marker" else F.concat(F.lit("["), e["label"], number, F.lit("]"))
        category = F.substring_index(F.substring_index(e["key"], SEPARATOR, 2), SEPARATOR, -1)
        return F.struct(text.alias("placeholder"), F.substring_index(e["key"], SEPARATOR, -1).alias("value"), category.alias("category"))

    return F.transform(let(known, lambda keys: let(taken, lambda n: entries(keys, n))), entry)


def splice(text: Column, spans: Column, vault: Column, style: str) -> Column:
    """The text with each span's characters replaced by its placeholder. Spans don't overlap."""
    of_span = (lambda s: label(s["type"])) if style == "marker" else (lambda s: s["category"])
    of_entry = (lambda e: F.regexp_extract(e["placeholder"], r"^\[REDACTED_(.*)_[0-9]+\]$", 1)) if style == "marker" else (lambda e: e["category"])
    entries = F.transform(vault, lambda e: F.struct(F.concat_ws(SEPARATOR, of_entry(e), e["value"]).alias("key"), e["placeholder"].alias("value")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(SEPARATOR, of_span(s), s["value"]).alias("key"))))

    def joined(parts: Column, marks: Column, names: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(marks, i - 1)["end"])
        pieces = F.transform(marks, lambda m, i: F.concat(cut(parts, before(i), m["start"]), F.get(names, i)))
        return F.concat(F.array_join(pieces, ""), cut(parts, F.coalesce(F.get(marks, F.size(marks) - 1)["end"], F.lit(0)), F.length(text)))

    spliced = let(ordered, lambda marks: let(looked_up(F.transform(marks, lambda m: m["key"]), entries), lambda names: let(blocks(text), lambda parts: joined(parts, marks, names))))
    return F.when(F.size(spans) == 0, text).otherwise(spliced)


def redact(docs: DataFrame, rules: Sequence[Rule], style: str = "marker", text: str = "text", disabled: Sequence[str] = (), keep: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """docs with spans, vault and redacted (style: marker, token or fake; fake needs a key).

    Categories in disabled and values in keep (whatever their case) stay as they are.
    """
    active = [r for r in rules if r.category not in disabled]
    found = with_spans(docs, active, text)
    if keep:
        found = found.withColumn("spans", F.filter("spans", lambda s: ~F.lower(F.trim(s["value"])).isin(*[k.lower().strip() for k in keep])))
    pattern = r"\[REDACTED_[A-Z_]+_([0-9]{1,9})\]" if style == "marker" else r"\[[A-Za-z_]+([0-9]{1,9})[a-z]?\]"
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = found.withColumn("spans", claimed(F.col("spans"))).withColumn("_taken", _highest(body, pattern))
    out = out.withColumn("vault", vault_of(F.col("spans"), F.col("_taken"), style))
    if style == "fake":
        if not key:
            raise ValueError("substitutes need a key")
        out = out.withColumn("vault", with_fakes(body, F.col("vault"), key))
    return out.withColumn("redacted", splice(body, F.col("spans"), F.col("vault"), style)).drop("_taken")


#: The placeholders that redact() makes, but for substitutes.
BRACKETED = r"\[[A-Za-z_]+[0-9]+[a-z]?\]"


def restore(text: Column, vault: Column, disabled: Sequence[str] = ()) -> Column:
    """The text with every placeholder of the vault replaced by its value, in one pass: what was restored isn't read again. Categories in disabled stay.

    Where placeholders overlap the longest one counts. A null or empty vault gives the text unchanged. If all placeholders are
    in brackets they are looked up all at once; others are tried one after the other at each place.
    """
    listed = F.filter(vault, lambda e: (e["placeholder"] != "") & e["value"].isNotNull())
    entries = F.filter(listed, lambda e: ~F.coalesce(e["category"].isin(*disabled), F.lit(False))) if disabled else listed
    keyed = F.transform(entries, lambda e: F.struct(e["placeholder"].alias("key"), e["value"].alias("value")))
    longest = F.array_sort(F.transform(entries, lambda e: F.struct((-F.length(e["placeholder"])).alias("n"), e["placeholder"].alias("placeholder"))))
    escaped = F.array_join(F.transform(longest, lambda e: F.regexp_replace(e["placeholder"], r"([\\^$.|?*+()\[\]{}&#~-])", r"\\$1")), "|")
    bracketed = F.forall(entries, lambda e: e["placeholder"].rlike(f"^{BRACKETED}$"))
    pattern = F.when(bracketed, F.lit(BRACKETED)).otherwise(escaped)

    def one_pass(p: Column) -> Column:
        def joined(marks: Column, values: Column) -> Column:
            parts = F.split(text, p, -1)
            return F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(values, i), F.get(marks, i), F.lit("")))), "")

        return let(F.regexp_extract_all(text, p, F.lit(0)), lambda marks: let(looked_up(marks, keyed), lambda values: joined(marks, values)))

    return F.when(text.isNull() | (F.coalesce(F.size(entries), F.lit(0)) <= 0), text).otherwise(let(pattern, one_pass))


def segments(text: Column, spans: Column) -> Column:
    """array<struct<kind, value>>: the text's parts and values, in order."""

    def parted(parts: Column, marks: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(marks, i - 1)["end"])
        part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        both = F.flatten(F.transform(marks, lambda m, i: F.array(part("text", cut(parts, before(i), m["start"])), part("redaction", m["value"]))))
        rest = part("text", cut(parts, F.coalesce(F.get(marks, F.size(marks) - 1)["end"], F.lit(0)), F.length(text)))
        return F.filter(F.array_append(both, rest), lambda x: (x["kind"] != "text") | (x["value"] != ""))

    return F.when(text.isNotNull(), let(F.array_sort(spans), lambda marks: let(blocks(text), lambda parts: parted(parts, marks))))


__all__ = ["ENTRY", "SPAN", "label", "redact", "restore", "segments", "splice", "vault_of", "word"]
