"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are counted by numpy on Arrow batches, without a
shuffle. Trees are fitted on the driver, on at most ``max_rows`` labelled rows (those whose ids' hashes
are least, so reruns agree): values are cut into at most BINS bins, and each level of a
tree is grown from histograms of gradients. The trees are flattened
into arrays, one column a level, and all rows of a batch walk down all of them at once.

Scores read the text alone. A label's row that is held out is never fitted.

Defined cases: a null text is empty; all its statistics are 0 and it gets a score. A null label, or one of
an unknown document, is left out; a document labelled twice is fitted with its mean. Without labels of
both kinds every score is the mean label, or 0.5 without any. Repeated rows get equal scores. An empty
table gives no rows. Columns other than doc_id, text and those in ``carry`` are ignored; a carried
column may not have the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, held_out
from .text_arrays import shingles, slices, texts, words

THRESHOLD, FOLDS = 0.3, 5
#: The most labelled rows that a fit reads.
MAX_ROWS = 20_000
#: Bytes of text whose statistics are counted at once; they take about fifty times as much.
SLICE = 1 << 19
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 120, 4, 0.15, 64, 20, 2.0

NAMES = [
    "words", "word_length", "long_words", "upper", "lower", "digits", "beyond_ascii", "bangs", "symbols", "pipes", "full_stops", "commas",
    "lines", "line_length", "repeated_lines", "distinct_words", "commonest_word", "repeated_shingles", "repeated_pairs", "next_same",
    "upper_words", "word_length_spread", "half_upper", "half_bangs", "half_symbols", "half_repeats",
]

_CLASSES = {
    "upper": [range(65, 91)], "lower": [range(97, 123)], "digits": [range(48, 58)], "beyond_ascii": [range(128, 256)], "bangs": [[33]],
    "symbols": [[ord(x) for x in "#*$%&<>"]], "pipes": [[124]], "full_stops": [[46]], "commas": [[44]],
}


#: The number of a byte's class, 0 for the rest.
_KINDS = len(_CLASSES) + 1
_KIND = np.zeros(256, np.int32)
for _i, _parts in enumerate(_CLASSES.values(), 1):
    _KIND[[x for p in _parts for x in p]] = _i


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring bounds."""
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(run[bounds]).astype(np.float64)


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each run between bounds has, and how often its commonest occurs."""
    # A text's number above 40 bits of the hash: one plain sort, and hashes only meet within a text.
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    v = np.sort((doc << np.uint64(40)) | (values >> np.uint64(24)))
    d = (v >> np.uint64(40)).astype(np.int64)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    of = d[at]
    many = np.bincount(of, minlength=len(first) - 1).astype(np.float64)
    most = np.zeros(len(first) - 1)
    if len(at):
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        most[of[begins]] = np.maximum.reduceat(np.diff(np.append(at, len(v))), begins)
    return many, most


def statistics(column_: pa.Array) -> np.ndarray:
    """A row of NAMES for each whole text."""
    data, offsets = texts(column_)
    w = words(data, offsets)
    n, size = w.counts.astype(np.float64), np.diff(offsets).astype(np.float64)
    some, some_bytes = np.maximum(n, 1), np.maximum(size, 1)
    lens = w.ends - w.starts
    by: dict[str, np.ndarray] = {"words": np.log1p(n), "word_length": _sums(lens, w.first) / some, "long_words": _sums(lens > 14, w.first) / some}
    # Counts of each kind of byte in the first and the second half of each text.
    middle = offsets[:-1] + np.diff(offsets) // 2
    both = np.stack([middle - offsets[:-1], offsets[1:] - middle], 1).ravel()
    half = np.repeat(np.arange(len(both), dtype=np.int32) * np.int32(_KINDS), both)
    halves = np.bincount(half + _KIND[data], minlength=len(both) * _KINDS).reshape(-1, 2, _KINDS).astype(np.float64)
    for i, name in enumerate(_CLASSES, 1):
        by[name] = halves[:, :, i].sum(1) / some_bytes
    for name, of in (("half_upper", "upper"), ("half_bangs", "bangs"), ("half_symbols", "symbols")):
        by[name] = halves[:, 1, 1 + list(_CLASSES).index(of)] / np.maximum(both[1::2], 1)
    ends = data == 10
    lines = _sums(ends, offsets) + (size > 0)
    by["lines"], by["line_length"] = np.log1p(lines), np.log1p(size / np.maximum(lines, 1))
    # Lines by the sums of their scrambled bytes and places: enough to tell equal ones.
    bounds = np.unique(np.concatenate([np.flatnonzero(ends) + 1, offsets]))
    bounds = bounds[bounds <= len(data)]
    weight = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    if len(data):
        starts = bounds[:-1]
        at = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, np.diff(bounds)).astype(np.uint64)
        line = np.add.reduceat(weight * (at * np.uint64(2) + np.uint64(1)), starts)
        first = np.searchsorted(starts, offsets)
        kinds, _ = _distinct(line, first)
        held = np.diff(first)
        by["repeated_lines"] = (held - kinds) / np.maximum(held, 1)
    else:
        by["repeated_lines"] = np.zeros(len(n))
    h = w.hashes
    kinds, most = _distinct(h, w.first)
    by["distinct_words"], by["commonest_word"] = kinds / some, most / some
    for name, k in (("repeated_shingles", 5), ("repeated_pairs", 2)):
        values, first = shingles(w, k)
        kinds, _ = _distinct(values, first)
        by[name] = (np.diff(first) - kinds) / np.maximum(np.diff(first), 1)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.counts > 0]] = False
    by["next_same"] = _sums(same, w.first) / some
    shout = np.zeros(len(h), bool)
    if len(h):
        up, low = (np.concatenate([[0], np.cumsum(_KIND[data] == k, dtype=np.int32)]) for k in (1, 2))
        shout = (up[w.ends] - up[w.starts] > 1) & (low[w.ends] == low[w.starts])
    by["upper_words"] = _sums(shout, w.first) / some
    mean = by["word_length"]
    by["word_length_spread"] = np.sqrt(np.maximum(_sums(lens.astype(np.int64) ** 2, w.first) / some - mean**2, 0))
    # The second half alone: junk often follows a clean beginning.
    run = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
    mid = w.first[:-1] + w.counts // 2
    by["half_repeats"] = (run[w.first[1:]] - run[mid]) / np.maximum(w.first[1:] - mid, 1)
    return np.stack([by[x] for x in NAMES], 1)


@dataclass
class Trees:
    """feature, cut: (trees, 2 ** depth - 1) in breadth-first order; leaf: (trees, 2 ** depth); a row goes right where its value is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels y between 0 and 1."""
    none = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    if not len(y):
        return none
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    none.start = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    wide = binned + np.arange(x.shape[1]) * BINS
    total = np.full(len(y), none.start)
    features, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            width, lanes = 2**level, x.shape[1] * BINS
            key = (node[:, None] * lanes + wide).ravel()
            sums = [np.bincount(key, np.repeat(v, x.shape[1]), width * lanes).reshape(width, x.shape[1], BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[width - 1 + k], cut[width - 1 + k] = j, cuts[j][b]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > cut[at])
        top, bottom = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = RATE * top / (bottom + RIDGE)
        total = total + leaf[node]
        features.append(feature), values.append(cut), leaves.append(leaf)
    return Trees(np.array(features), np.array(values), np.array(leaves), none.start)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        rows = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, j]) for j in range(len(NAMES)))], names=["label", *NAMES])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees for labels.quality, fitted on at most max_rows documents that aren't held out."""
    known = labels.select(column(labels, "doc_id", "long").alias("_id"), column(labels, "quality", "double").alias("_q")).filter("_id is not null and _q is not null")
    once = known.filter(~held_out(F.col("_id"), FOLDS)).groupBy("_id").agg(F.avg("_q").alias("_q"))
    chosen = once.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(column(docs, "doc_id", "long").alias("_d"), column(docs, "text", "string").alias("text"))
    # At most max_rows pairs of numbers, whatever the tables' sizes.
    fitted = rows.join(F.broadcast(chosen), F.col("_d") == F.col("_id")).select("_q", "text").mapInArrow(_measured, "label double, " + ", ".join(f"{x} double" for x in NAMES))
    # An id with several rows must not widen what the driver gets.
    data = fitted.orderBy(F.xxhash64("label", *NAMES), *NAMES, "label").limit(max_rows).toPandas()
    return fit(data[NAMES].to_numpy(np.float64), data["label"].to_numpy(np.float64).clip(0, 1))


def classify(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the carried columns, a row for each document."""
    names = ["doc_id", *[c for c in carry if c != "doc_id"]]
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), *[F.col(f"`{c}`") for c in names[1:]], column(docs, "text", "string").alias("_t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", SLICE):
            score = trees.score(statistics(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*names, "score"])

    out = base.mapInArrow(scored, T.StructType([*base.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *[F.col(f"`{c}`") for c in names[1:]])
