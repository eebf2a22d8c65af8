"""Many values against all texts: every place of every listed value, in one pass of the texts for each part of the list.

A list is held as flat sorted arrays. Of a value of n characters the first a and the last a, a being the largest power of two up to n, cover all of it:
the first ones' hash is its anchor, both hashes and n together are its key. A text's hashes of all windows of 1, 2, 4, ... characters are
made by doubling; a window whose hash is an anchor offers the lengths that values of this anchor have, and each of these is looked up
by its key. What is found is compared with the value itself. So the time a character depends on the number of window sizes, not on that of the values.

The list is split by hash into parts of at most ``PART`` characters and values, and one part at a time passes the driver and is broadcast; texts are
not shuffled. Texts are read in blocks of ``BLOCK`` characters that overlap by the longest value.

Null and empty values are nowhere, nor is anything in a null text. Repeated values count once. Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters and values in a part of a list, at most; characters in a block of a text.
PART, BLOCK = 1 << 24, 1 << 20
#: What may not touch a value, and what may stand between its words, as regular expressions.
WORD, BETWEEN = regex.compile(r"[\p{L}\p{N}_]"), regex.compile(r"[\s._-]+")
#: Values of at most this many characters without separators are met as they stand only.
SHORT = 3
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each window size up to most, and the hashes of all windows of that size."""
    h, base, size = (codes.astype(np.uint64) + np.uint64(1)) * _MIX, _BASE, 1
    h ^= h >> np.uint64(29)
    while len(h):
        yield size, h
        if 2 * size > most or len(h) <= size:
            return
        h, base, size = h[:-size] * base + h[size:], base * base, 2 * size


def _key(first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first * _BASE ^ (last + length.astype(np.uint64))) * _MIX
        return x ^ (x >> np.uint64(31))


def _fold(text: str) -> str:
    """Lower case, a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def squeezed(text: str) -> tuple[str, np.ndarray]:
    """The text in lower case without blanks, dots, dashes and underscores, and where each character stands."""
    kept = np.ones(len(text), bool)
    for m in BETWEEN.finditer(text):
        kept[m.start() : m.end()] = False
    return BETWEEN.sub("", _fold(text)), np.flatnonzero(kept).astype(np.int32)


class Automaton:
    """A part of a list: values, and per window size the anchors, the lengths that each one's values have, and the keys with the values' numbers."""

    def __init__(self, values: list[str], names: list[str] | None = None):
        """names are what texts are searched for, values what is reported; several values may share a name."""
        self.values, self.names = values, names or values
        sizes = np.array([len(x) for x in self.names], np.int64)
        starts, self.longest = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), int(sizes.max(initial=0))
        self.by_size = {}
        with np.errstate(over="ignore"):
            for a, h in _windows(_codes("".join(self.names)), self.longest):
                own = np.flatnonzero((sizes >= a) & (sizes < 2 * a))
                if not len(own):
                    continue
                first, last = h[starts[own]], h[starts[own] + sizes[own] - a]
                pairs = np.unique(np.rec.fromarrays([first, sizes[own]], names="anchor,length"))
                anchors, at = np.unique(pairs["anchor"], return_index=True)
                keys = _key(first, last, sizes[own])
                order = np.argsort(keys, kind="stable")
                # A bit for the top bits of each anchor's hash: most windows are turned away by it.
                bits = max(10, min(26, int(len(anchors)).bit_length() + 4))
                seen = np.zeros(1 << bits, bool)
                seen[anchors >> np.uint64(64 - bits)] = True
                self.by_size[a] = (seen, np.uint64(64 - bits), anchors, np.append(at, len(pairs)), pairs["length"].astype(np.int64), keys[order], own[order])

    def places(self, text: str, at_edges: np.ndarray | None = None, ends: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """start, end and number of every value in the text; at_edges tells the places where one may begin, ends those before which one may end."""
        for begin in range(0, len(text), BLOCK):
            part = text[begin : begin + BLOCK + self.longest]
            inside = min(BLOCK, len(text) - begin)
            with np.errstate(over="ignore"):
                for a, h in _windows(_codes(part), self.longest):
                    if a not in self.by_size:
                        continue
                    seen, shift, anchors, offsets, lengths, keys, numbers = self.by_size[a]
                    hit = seen[h[:inside] >> shift]
                    if at_edges is not None:
                        hit &= at_edges[begin : begin + len(hit)]
                    at = np.flatnonzero(hit)
                    i = np.searchsorted(anchors, h[at])
                    i[i == len(anchors)] = 0
                    good = anchors[i] == h[at]
                    at, i = at[good], i[good]
                    n = offsets[i + 1] - offsets[i]
                    which = np.repeat(offsets[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                    at, length = np.repeat(at, n), lengths[which]
                    fits = at + length <= len(part)
                    at, length = at[fits], length[fits]
                    key = _key(h[at], h[at + length - a], length)
                    lo, n = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                    n -= lo
                    if ends is not None:
                        n[~ends[begin + at + length]] = 0
                    which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    for s, m, number in zip(np.repeat(at, n).tolist(), np.repeat(length, n).tolist(), numbers[which].tolist(), strict=True):
                        if part[s : s + m] == self.names[number]:
                            yield begin + s, begin + s + m, number


#: Whether each character is one of WORD; -1 until it is met.
_IS_WORD = np.full(0x110000, -1, np.int8)


def _word_flags(text: str) -> np.ndarray:
    """Whether each character is a letter, a digit or an underscore; False at both ends beyond the text."""
    codes = _codes(text)
    flags = _IS_WORD[codes]
    if (flags < 0).any():
        for c in np.unique(codes[flags < 0]).tolist():
            _IS_WORD[c] = WORD.match(chr(c)) is not None
        flags = _IS_WORD[codes]
    return np.concatenate([[False], flags.astype(bool), [False]])


def _separated(value: str) -> frozenset[int]:
    """After how many of its other characters a value has separators."""
    out, n = [], 0
    for part in BETWEEN.split(value)[:-1]:
        n += len(part)
        out.append(n)
    return frozenset(out)


class Matcher:
    """An automaton with the rules of matching: whole words or anywhere; as values stand, or whatever case and separators."""

    def __init__(self, values: list[str], edges: bool, loose: bool):
        self.edges, self.loose = edges, loose
        if loose:
            by_letters = [(v, squeezed(v)[0]) for v in values]
            far = [(v, s) for v, s in by_letters if len(s) > SHORT]
            near = [v for v, s in by_letters if len(s) <= SHORT]
            self.folded = Automaton([v for v, _ in far], [s for _, s in far])
            self.separators = [_separated(v) for v, _ in far]
            self.plain = Automaton(near)
        else:
            self.folded, self.plain = None, Automaton(values)

    def found(self, text: str) -> Iterator[tuple[int, int, str]]:
        word = _word_flags(text) if self.edges else None
        free = ~word[:-2] if self.edges else None
        for s, e, i in self.plain.places(text, free, None if word is None else ~word[1:]):
            yield s, e, self.plain.values[i]
        if self.folded is None or not self.folded.values:
            return
        letters, at = squeezed(text)
        for s, e, i in self.folded.places(letters, None if free is None else free[at]):
            start, end = int(at[s]), int(at[e - 1]) + 1
            if word is not None and word[end + 1]:
                continue
            # Separators only where the value has some.
            gaps = np.flatnonzero(np.diff(at[s:e]) > 1) + 1
            if self.separators[i].issuperset(gaps.tolist()):
                yield start, end, self.folded.values[i]


def _parts(values: DataFrame, least: int, part: int) -> Iterator[list[str]]:
    """The values' parts by hash, one after the other."""
    listed = values.select(F.col("value").cast("string").alias("value")).filter(F.length("value") >= max(1, least)).distinct()
    size = listed.agg(F.sum(F.length("value")).alias("chars"), F.count("*").alias("n")).first()
    parts = max(-(-(size["chars"] or 0) // part), -(-size["n"] // part), 1)
    for i in range(parts):
        yield listed.filter(F.pmod(F.xxhash64("value"), F.lit(parts)) == i).toArrow()["value"].to_pylist()


def scan(docs: DataFrame, values: DataFrame, *keys: str, text: str = "text", edges: bool = True, loose: bool = False, once: bool = False, least: int = 1, part: int = PART) -> DataFrame:
    """keys, start, end, value: a row for each place of a text where one of values (value) stands, overlapping ones too.

    edges: only where no letter, digit or underscore touches it. loose: whatever its case, and with other or no separators where it has some, if it has more
    than SHORT other characters. once: only the first place of each value in a row's text. Values of fewer than ``least`` characters are left out.
    """
    base = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])
    out = None
    for listed in _parts(values, least, part):
        held = docs.sparkSession.sparkContext.broadcast(Matcher(listed, edges, loose))

        def passed(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = held.value
            for batch in batches:
                rows, starts, ends, found = [], [], [], []
                for row, body in enumerate(batch["_text"].to_pylist()):
                    known = set()
                    for s, e, v in sorted(matcher.found(body)) if body and once else matcher.found(body) if body else ():
                        if once and v in known:
                            continue
                        known.add(v) if once else None
                        rows.append(row), starts.append(s), ends.append(e), found.append(v)
                kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows, pa.int64())) if batch.num_columns > 1 else None
                columns = [*(kept.columns if kept is not None else []), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        some = base.mapInArrow(passed, schema)
        out = some if out is None else out.unionByName(some)
    return out


def settled(found: DataFrame, *keys: str) -> DataFrame:
    """Of the places of each text (keys) those that hold when the longest value goes first, then the one that comes first in the alphabet, then the first place.

    Places are joined into stretches that overlap; what one array holds is the places of one stretch.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "value")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).over(order)
    places = found.withColumn("_stretch", stretch).groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("n"), "value", "start", "end"))).alias("_p"))
    kind = "array<struct<n:int,value:string,start:int,end:int>>"

    def step(held: Column, p: Column) -> Column:
        return F.when(F.exists(held, lambda x: (x["start"] < p["end"]) & (p["start"] < x["end"])), held).otherwise(F.array_append(held, p))

    kept = F.when(F.size("_p") == 1, F.col("_p")).otherwise(F.aggregate("_p", F.array().cast(kind), step))
    return places.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.start", "_k.end", "_k.value")
