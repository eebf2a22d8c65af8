"""LM scoring by online logistic mixing of hashed-context bit predictors.

A text is the sequence of its words, lower-cased in A-Z, and one end. It is
coded bit by bit: a common word has a Huffman code of its own; a rarer one has the code of its class, which are
the words of about its count, and is any of these alike; any other word is spelled by codes of its
bytes and a stop. So every text has a probability. Each bit of a code is
predicted in three contexts: none but the code so far; the latest of the FREQUENT commonest words, which tells
the language (while spelling, the two letters before); and the two symbols before (while spelling, up to
four). The last two look up a hashed slot for their context and place in the code. The predictions' log-odds are mixed by weights that a gate selects
(how sure either context is); a further table maps the mix to how often it was right.
Weights and table begin alike for each text and are refined online, after every STRIDE of its
first EARLY symbols and then, as they have settled, after every LATER, so a score depends on its text and the counts alone, and not on how rows are dealt. The sum of the bits'
logarithms is the text's log probability, and its bits per byte.

Every training text is counted, in passes that are narrow maps with sums: words of all (shuffled as counts by
hash); then the bits' slots (as blocks of partial sums of the two tables) of all but a fold of the training texts; then, on that
fold, whose texts the slots have not seen, how often a bit was 1 by what its three predictions said, to
which the weights that texts begin with are fitted; then scoring. What the driver and the tasks hold is bounded: the TOP commonest words' counts,
VOCABULARY codes, their classes' and two tables of slots. The word counts grow with the input: those of all rarer words stay in a
table, and the base scores of texts that use them are completed by a join. The tables of slots grow more slowly, doubling whenever the training
words are 2 ** GROWTH times as many (slot_bits), so that a task can still hold them: 2 x 4 MB up to 2 ** WORDS_BITS words (about 0.4 GB of
text), 2 x 16 MB at 30 GB, 2 x 256 MB at 100 TB. What a slot can't tell apart, contexts share.

Words are told apart by 64-bit hashes.

Defined cases: a null text is empty: one end. A null doc_id hashes as the empty text, which is held out. Repeated rows
count as often as they are there and get equal scores. Without training texts nothing is known, and all codes
are near 8 bits a byte. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold, held_out, written
from .text_arrays import Words, slices, texts, words

FOLDS = 10
TOP, VOCABULARY, FREQUENT = 1 << 20, 1 << 16, 64
BLOCK_BITS = 14
#: Slots of a table for up to 2 ** WORDS_BITS training words, and how many doublings of the words double it from there on.
SLOT_BITS, WORDS_BITS, GROWTH = 22, 26, 3
STOP, END = 32, 256
#: Symbols between refinements; step of the weights.
STRIDE, EARLY, LATER, STEP = 8, 512, 32, 0.02
#: The remainder of the training texts that the weights are fitted to.
WEIGHING = 1
#: Classes of rarer words to a power of two of the count.
CLASSES = 8
#: Log-odds are kept as bytes of this fraction.
SCALE = 16.0
LEVELS = 4
#: Weights before anything is learned; levels that a prediction's log-odds are summed by; what the start counts for in fitting.
EVEN, STEPS, RIDGE = 1 / 3, 32, 1.0
#: Cells of the last table, and the observations that its beginning counts for.
CELLS, PRIOR = 24, 60.0
SLICE = 1 << 20
#: The most bytes of text that a task sums slots of, so that little is lost with a task.
TASK_BYTES = 1 << 30
#: How many words a task gathers before it passes counts on.
GATHER = 1 << 20

_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32
U32 = np.uint32


def slot_bits(tokens: int) -> int:
    """Bits of the number of a slot, where so many words were counted."""
    return SLOT_BITS + max(0, tokens.bit_length() - 1 - WORDS_BITS) // GROWTH


@dataclass
class Codes:
    """Huffman codes: of symbol s the nodes and bits from begin[s] to begin[s + 1]; odds: log-odds of a 1 at each node."""

    begin: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    odds: np.ndarray


def huffman(weights: np.ndarray) -> Codes:
    """Codes for symbols of positive weights; ties are settled by number, so reruns agree."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    left, right, total = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(2 * n - 1)
    total[:n] = weights
    for k in range(n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        left[k], right[k], total[n + k] = i, j, a + b
        heapq.heappush(heap, (a + b, n + k))
    depth = np.zeros(2 * n - 1, np.int64)
    up, one = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8)
    up[left], up[right], one[right] = np.arange(n - 1) + n, np.arange(n - 1) + n, 1
    for k in range(n - 2, -1, -1):
        depth[left[k]] = depth[right[k]] = depth[n + k] + 1
    begin = np.concatenate([[0], np.cumsum(depth[:n])])
    node, bit = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int8)
    at, place = np.arange(n), begin[1:] - 1
    open_ = np.flatnonzero(depth[:n] > 0)
    while len(open_):
        s = at[open_]
        node[place[open_]], bit[place[open_]] = up[s] - n, one[s]
        at[open_] = up[s]
        place[open_] -= 1
        open_ = open_[place[open_] >= begin[open_]]
    return Codes(begin, node, bit, np.log(total[right] / total[left]).astype(np.float32))


@dataclass
class Vocabulary:
    """Sorted hashes of the commonest words with their counts and the symbol of each: of its own from first_word on, or its class's.

    alike: the logarithm of how many words a symbol stands for; tokens: words and ends counted, which the tables' size follows from.
    """

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    codes: Codes
    alike: np.ndarray
    first_word: int
    tokens: int
    distinct: int
    ends: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those that aren't there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def symbols(vocabulary: Vocabulary, found: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after the other, and the number of the first one of each."""
    word = vocabulary.symbols[at] if len(vocabulary.symbols) else np.zeros(len(at), np.int32)
    lens = found.ends - found.starts
    spelled = at < 0
    size = np.where(spelled, lens + 1, 1)
    doc = found.doc()
    place = np.cumsum(size) - size + doc
    sums = np.concatenate([[0], np.cumsum(size)])[found.first]
    first = sums + np.arange(len(sums))
    out = np.full(int(first[-1]), END, np.int32)
    out[place[~spelled]] = word[~spelled]
    n = lens[spelled]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(place[spelled], n) + inside] = _LOWER[found.data[np.repeat(found.starts[spelled], n) + inside]]
    out[place[spelled] + n] = STOP
    return out, first


def contexts(of: np.ndarray, first: np.ndarray, first_word: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashed contexts of each symbol; before a text's beginning lie ends."""
    before = []
    for k in (1, 2, 3, 4):
        p = np.full(len(of), END, np.int32)
        p[k:] = of[:-k]
        for j in range(k):
            at = first[:-1] + j
            p[at[at < first[1:]]] = END
        before.append(p.astype(U32))
    # Words are numbered from the commonest on. An end stands where none came yet.
    mark = np.zeros(len(of), np.int64)
    mark[1:] = np.where(((of >= first_word) & (of < first_word + FREQUENT))[:-1], np.arange(1, len(of)), 0)
    # Each text begins as after an end.
    starts = first[:-1][first[:-1] > 0]
    mark[starts] = starts
    mark = np.maximum.accumulate(mark)
    latest = np.where(mark > 0, of[mark - 1], END)
    spelling = (before[0] < 256) & (before[0] != STOP)
    two = ((before[0] + U32(1)) * U32(0x9E3779B1) ^ (before[1] + U32(7))) * U32(0x85EBCA6B)
    two ^= two >> U32(15)
    four = ((two ^ (before[2] + U32(77))) * U32(0xC2B2AE35) ^ (before[3] + U32(777))) * U32(0x27D4EB2F)
    return np.where(spelling, two, (latest.astype(U32) + U32(3)) * U32(0xC2B2AE35)), np.where(spelling, four ^ (four >> U32(13)), two)


def bits(codes: Codes, wide: int, of: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbol number, node, bit and slots of orders 1 and 2, of wide bits, of each bit."""
    n = (codes.begin[1:] - codes.begin[:-1])[of]
    symbol = np.repeat(np.arange(len(of), dtype=np.int32), n)
    at = np.arange(len(symbol)) + np.repeat(codes.begin[:-1][of] - (np.cumsum(n) - n), n)
    node = codes.node[at]
    step = (node.astype(U32) + U32(1)) * U32(0x27D4EB2F)
    slots = []
    for c in (one, two):
        h = (c[symbol] ^ step) * U32(0x165667B1)
        h ^= h >> U32(15)
        h *= U32(0x9E3779B1)
        slots.append((h >> U32(32 - wide)).astype(np.int32))
    return symbol, node, codes.bit[at], *slots


@dataclass
class Model:
    """begin: for each gate, the weights of orders 0, 1 and 2 that a text begins with."""

    vocabulary: Vocabulary
    tables: tuple[np.ndarray, np.ndarray]
    begin: np.ndarray

    def cells(self, of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many zeros and ones came after each combination of the three predictions' levels."""
        codes = self.vocabulary.codes
        _, node, bit, s1, s2 = bits(codes, slot_bits(self.vocabulary.tokens), of, *contexts(of, first, self.vocabulary.first_word))
        cell = _LEVEL[np.rint(codes.odds * SCALE).clip(-127, 127).astype(np.int8).view(np.uint8)][node]
        for table, s in zip(self.tables, (s1, s2), strict=True):
            cell = cell * np.int32(STEPS) + _LEVEL[table[s].view(np.uint8)]
        return np.bincount(cell * 2 + bit, minlength=2 * STEPS**3)

    def score(self, of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The natural log probability of each text, given its symbols."""
        texts_, codes = len(first) - 1, self.vocabulary.codes
        one, two = contexts(of, first, self.vocabulary.first_word)
        lens = np.diff(first)
        # Texts are numbered from the longest on, so that those which a stride still reaches are the first ones.
        rank = np.empty(texts_, np.int32)
        rank[np.argsort(-lens, kind="stable")] = np.arange(texts_)
        doc = np.repeat(rank, lens)
        place = np.arange(len(of)) - np.repeat(first[:-1], lens)
        stride = np.where(place < EARLY, place // STRIDE, EARLY // STRIDE + (place - EARLY) // LATER).astype(np.int32)
        # All texts' first strides, then all second ones, and so on.
        order = np.argsort(stride.astype(np.uint16) if len(stride) and stride.max() < 65536 else stride, kind="stable")
        of, one, two, doc, stride = of[order], one[order], two[order], doc[order], stride[order]
        symbol, node, bit, s1, s2 = bits(codes, slot_bits(self.vocabulary.tokens), of, one, two)
        x = [codes.odds[node]]
        sure = []
        for table, s in zip(self.tables, (s1, s2), strict=True):
            raw = table[s]
            sure.append(_SURE[raw.view(np.uint8)])
            x.append(raw.astype(np.float32) * np.float32(1 / SCALE))
        of_doc = doc[symbol]
        key = of_doc * np.int32(LEVELS * LEVELS) + (sure[1] * np.int32(LEVELS) + sure[0])
        weights = [np.tile(self.begin[:, k], texts_).astype(np.float32) for k in range(3)]
        right, seen = np.zeros(texts_ * CELLS, np.float32), np.zeros(texts_ * CELLS, np.float32)
        result = -np.bincount(doc, self.vocabulary.alike[of], texts_)
        bounds = np.searchsorted(stride, np.arange(int(stride[-1]) + 2)) if len(stride) else [0]
        ends = np.concatenate([[0], np.cumsum((codes.begin[1:] - codes.begin[:-1])[of])])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            lo, hi = int(ends[a]), int(ends[b])
            k, y, d = key[lo:hi], bit[lo:hi].astype(np.float32), of_doc[lo:hi]
            part = [v[lo:hi] for v in x]
            active = int(d.max()) + 1 if hi > lo else 0
            mixed = sum(w[k] * v for w, v in zip(weights, part, strict=True))
            np.clip(mixed, -11.5, 11.5, out=mixed)
            p = 1 / (1 + np.exp(-mixed))
            cell = d * np.int32(CELLS) + np.clip((mixed + 8) * np.float32(CELLS / 16), 0, CELLS - 1).astype(np.int32)
            refined = (right[cell] + np.float32(PRIOR) * p) / (seen[cell] + np.float32(PRIOR))
            final = np.float32(0.5) * (p + refined)
            result[:active] += np.bincount(d, np.log(np.abs(final - (1 - y))), active)
            # No use in learning from a chunk's last stride.
            if b < len(of):
                wrong = (y - p) * np.float32(STEP)
                gates, cells = active * LEVELS * LEVELS, active * CELLS
                for w, v in zip(weights, part, strict=True):
                    w[:gates] += np.bincount(k, wrong * v, gates).clip(-0.2, 0.2)
                both = np.bincount(cell * 2 + bit[lo:hi], minlength=2 * cells).reshape(-1, 2)
                right[:cells] += both[:, 1]
                seen[:cells] += both.sum(1)
        return result[rank]


#: How sure a kept log-odds is: unseen, weak, middling, strong.
_KEPT = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float64)
_SURE = np.digitize(np.abs(_KEPT) / SCALE, [0.05, 1.5, 3.0]).astype(np.int32)
#: The level of a kept log-odds: four to each unit near 0, wider ones further out; and what a level stands for.
_LEVEL = np.digitize(np.sign(_KEPT) * np.log1p(np.abs(_KEPT) / 8), np.linspace(-2.8, 2.8, STEPS - 1)).astype(np.int32)
_VALUE = np.array([_KEPT[_LEVEL == k].mean() if (_LEVEL == k).any() else 0.0 for k in range(STEPS)]) / SCALE
_SURE_OF_LEVEL = np.array([np.median(_SURE[_LEVEL == k]) if (_LEVEL == k).any() else 0 for k in range(STEPS)]).astype(int)


def fitted(cells: np.ndarray) -> np.ndarray:
    """The weights of each gate by logistic regression on cells (zeros and ones by levels of orders 0, 1 and 2), drawn towards EVEN by RIDGE."""
    zeros, ones = cells.reshape(-1, 2).T.astype(np.float64)
    level = np.indices((STEPS,) * 3).reshape(3, -1)
    gate = _SURE_OF_LEVEL[level[2]] * LEVELS + _SURE_OF_LEVEL[level[1]]
    out = np.full((LEVELS * LEVELS, 3), EVEN)
    for g in range(len(out)):
        own = (gate == g) & (zeros + ones > 0)
        x, n, y = _VALUE[level[:, own]].T, (zeros + ones)[own], ones[own]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ out[g], -30, 30)))
            slope = x.T @ (y - n * p) - RIDGE * (out[g] - EVEN)
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(3), slope)
            out[g] += np.clip(step, -0.5, 0.5)
            if np.abs(step).max() < 1e-6:
                break
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(n, at)


WORD, BYTE, DOCUMENT = 0, 1, 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n: words by hash, bytes by value, and texts."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    letters, docs, held = np.zeros(256, np.int64), 0, 0

    def batch(kind: int, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for part in slices(batches):
        data, offsets = texts(part.column(1))
        letters += np.bincount(_LOWER[data], minlength=256)
        docs += part.num_rows
        k, n = np.unique(words(data, offsets).hashes, return_counts=True)
        keys.append(k), counts.append(n)
        held += len(k)
        if held > GATHER:
            k, n = _merged(keys, counts)
            keys, counts, held = [k], [n], len(k)
            if held > GATHER // 2:
                yield batch(WORD, k, n)
                keys, counts, held = [], [], 0
    if docs:
        if held:
            yield batch(WORD, *_merged(keys, counts))
        yield batch(BYTE, np.arange(256), letters)
        yield batch(DOCUMENT, np.zeros(1), np.array([docs]))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From counts (kind, key, n). At most TOP words come to the driver."""
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    ends = totals[DOCUMENT]["n"] if DOCUMENT in totals else 0
    running = totals[WORD]["n"] if WORD in totals else 0
    distinct = totals[WORD]["rows"] if WORD in totals else 0
    found = counts.filter(F.col("kind") == WORD)
    # Steps of an eighth of a power of two: a few hundred rows.
    step = F.floor(F.log2(F.col("n").cast("double")) * CLASSES)
    least, room = None, TOP
    for r in found.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        # Words seen once are spelled whatever room there is: they show how often new words come, and how these are spelled.
        if room < 0 or r["step"] < CLASSES:
            break
        least = r["step"]
    top = found.filter(step >= least).select("key", "n").toArrow() if least is not None else None
    h = top["key"].to_numpy().astype(np.int64).view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    n = top["n"].to_numpy().astype(np.int64) if top is not None else np.zeros(0, np.int64)
    del top
    order = np.argsort(h)
    h, n = h[order], n[order]
    ranked = np.lexsort((h, -n))
    chosen, rarer = ranked[:VOCABULARY], ranked[VOCABULARY:]
    letters = np.ones(256)
    for r in counts.filter(F.col("kind") == BYTE).select("key", "n").collect():
        letters[r["key"]] += r["n"]
    return vocabulary_from(h, n, chosen, rarer, letters, running, distinct, ends)


def vocabulary_from(h: np.ndarray, n: np.ndarray, chosen: np.ndarray, rarer: np.ndarray, letters: np.ndarray, running: int, distinct: int, ends: int) -> Vocabulary:
    """chosen words have codes of their own, rarer ones those of their classes, all others are spelled."""
    spelled = running - int(n.sum())
    letters = letters.copy()
    letters[[9, 10, 11, 12, 13, STOP]] = 0
    letters = 1 + letters * spelled / max(1, running)
    letters[STOP] = 1 + spelled
    level, kind = np.unique(np.floor(np.log2(n[rarer]) * CLASSES), return_inverse=True)
    first_word = END + 1 + len(level)
    symbol = np.zeros(len(h), np.int32)
    symbol[rarer] = END + 1 + kind
    symbol[chosen] = first_word + np.arange(len(chosen))
    alike = np.zeros(first_word + len(chosen))
    alike[END + 1 : first_word] = np.log(np.bincount(kind, minlength=len(level)))
    weights = np.concatenate([letters, [ends + 1], np.bincount(kind, n[rarer], len(level)), n[chosen]])
    return Vocabulary(h, n, symbol, huffman(weights), alike, first_word, running + ends, distinct + bool(ends), ends)


def _sums(block: int, cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()]), pa.array([n.astype(np.int32).tobytes()])], names=["block", "cells", "counts"])


def _slots(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, cells, counts: partial sums of zeros and ones of the slots of both tables, by block.

    Sums are held in 16 bits; one that outgrows them is passed on and begins anew.
    """
    wide, width = slot_bits(vocabulary.tokens), 2 << BLOCK_BITS
    sums = np.zeros((2, 2 << wide), np.uint16)
    for part in slices(batches, most=SLICE):
        found = words(*texts(part.column(1)))
        of, first = symbols(vocabulary, found, vocabulary.find(found.hashes))
        _, _, bit, *slots = bits(vocabulary.codes, wide, of, *contexts(of, first, vocabulary.first_word))
        for number, s in enumerate(slots):
            cells, n = np.unique(s * 2 + bit, return_counts=True)
            n += sums[number, cells]
            full = np.flatnonzero(n > np.iinfo(np.uint16).max)
            block = cells[full] // width
            for k in np.unique(block):
                own = full[block == k]
                yield _sums((number * (2 << wide) // width) + int(k), cells[own] % width, n[own])
            n[full] = 0
            sums[number, cells] = n
    for block, held in enumerate(sums.reshape(-1, width)):
        cells = np.flatnonzero(held)
        if len(cells):
            yield _sums(block, cells, held[cells])


def _odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, odds: log-odds of the sums, a byte a slot."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells, counts in zip(*batch.columns, strict=True):
            table = held.setdefault(block.as_py(), np.zeros(2 << BLOCK_BITS, np.int64))
            table[np.frombuffer(cells.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), np.int32)
    for block, table in held.items():
        zeros, ones = table[::2] + 0.4, table[1::2] + 0.4
        odds = np.rint(np.log(ones / zeros) * SCALE).clip(-127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([odds.tobytes()])], names=["block", "odds"])


def _weighed(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, n: the sums of Model.cells."""
    sums = np.zeros(2 * STEPS**3, np.int64)
    for part in slices(batches, most=SLICE):
        found = words(*texts(part.column(1)))
        sums += model.cells(*symbols(model.vocabulary, found, model.vocabulary.find(found.hashes)))
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["cell", "n"])


def train(docs: DataFrame, folds: int = FOLDS) -> tuple[Model, DataFrame]:
    """A model of all texts of docs (doc_id, text), and the table of all word counts."""
    spark = docs.sparkSession
    counts = written(docs.mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    vocabulary = vocabulary_of(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    # Partial tables are as large for a small split as for a large one: no more tasks than keep the cores busy, unless one had over TASK_BYTES.
    size = counts.filter(F.col("kind") == BYTE).agg(F.sum("n")).first()[0] or 0
    few = max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    weighing = fold(F.col("doc_id"), folds) == WEIGHING
    partial = docs.filter(~weighing).coalesce(few).mapInArrow(lambda x: _slots(shared.value, x), "block int, cells binary, counts binary")
    blocks = partial.repartition("block").mapInArrow(_odds, "block int, odds binary").collect()
    tables = np.zeros((2 << slot_bits(vocabulary.tokens) - BLOCK_BITS, 1 << BLOCK_BITS), np.int8)
    for r in blocks:
        tables[r["block"]] = np.frombuffer(r["odds"], np.int8)
    model = Model(vocabulary, tuple(tables.reshape(2, -1)), np.full((LEVELS * LEVELS, 3), EVEN))
    unweighed = spark.sparkContext.broadcast(model)
    sums = docs.filter(weighing).mapInArrow(lambda x: _weighed(unweighed.value, x), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(2 * STEPS**3)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    model.begin = fitted(cells)
    unweighed.destroy()
    return model, counts


SCORED = "row long, doc_id long, n_tokens long, n_known long, n_bytes long, base_score double, score double, tail array<long>, tail_n array<int>"


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = model.vocabulary
    row, below = TaskContext.get().partitionId() << 33, v.tokens + 0.1 * (v.distinct + 1)
    logs = np.log10((v.counts + 0.1) / below)
    end = np.log10((v.ends + 0.1) / below)
    for part in slices(batches, most=SLICE):
        data, offsets = texts(part.column(1))
        found = words(data, offsets)
        at, doc, n = v.find(found.hashes), found.doc(), part.num_rows
        of, first = symbols(v, found, at)
        known = at >= 0
        base = np.bincount(doc[known], logs[at[known]] if len(logs) else None, n) + end
        # Rarer words, once a text, with their counts.
        rare, lens, times = np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(0, np.int32)
        if not known.all():
            d, h = doc[~known], found.hashes[~known]
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
            rare, times, lens = h[new], np.diff(np.append(new, len(h))).astype(np.int32), np.bincount(d[new], minlength=n)
        bounds = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n)),
                part.column(0),
                pa.array(found.counts + 1),
                pa.array(np.bincount(doc[known], minlength=n) + int(v.ends > 0)),
                pa.array(np.diff(offsets)),
                pa.array(base.astype(np.float64)),
                pa.array(model.score(of, first) / np.log(10)),
                pa.ListArray.from_arrays(bounds, pa.array(rare.view(np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(times)),
            ],
            names=[x.split()[0] for x in SCORED.split(", ")],
        )
        row += n


def lm_score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: a row for each document."""
    spark = docs.sparkSession
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    model, counts = train(base.filter(~held_out(F.col("doc_id"), folds)), folds)
    shared = spark.sparkContext.broadcast(model)
    scored = written(base.mapInArrow(lambda x: _scored(shared.value, x), SCORED), "scores")
    v = model.vocabulary
    tails = scored.filter(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("key"), F.col("t.tail_n").alias("times"))
    joined = tails.join(counts.filter(F.col("kind") == WORD).select("key", "n"), "key", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / float(v.tokens + 0.1 * (v.distinct + 1)))
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * log).alias("_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"))
    out = scored.drop("tail", "tail_n").join(rest, "row", "left")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
        per_byte.alias("bits_per_byte"),
    )
