"""Words of Arrow text columns as numpy arrays: no Python object for a word, whole texts, bounded memory.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D; A-Z are
lower-cased for hashing. White space is one byte in UTF-8, so bytes will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (a finaliser of a known shape: shift, multiply, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A scrambled number for each byte value, and the multiplier by which places in a word differ.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), U(_STEP))
    out[0] = U(1)
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of some texts: starts and ends are places in data; first[i] is the number of the first word of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, lower-cased."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
        letters = self.data[inside + np.repeat(self.starts, lens)]
        sums = np.add.reduceat(_BYTE[_LOWER[letters]] * _powers(int(lens.max()))[inside], at)
        return _mixed(sums + lens.astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    solid = ~blank[1:-1]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    starts = np.flatnonzero(solid & (blank[:-2] | bound[:-1]))
    ends = np.flatnonzero(solid & (blank[2:] | bound[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about ``most`` bytes of text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = texts(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to


def shingles(found: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, in order, and the number of the first one of each text.

    A text of fewer words gives its whole sequence as one; a text without words none.
    """
    h, n = found.hashes, found.counts
    factor = _mixed(np.arange(1, size + 1, dtype=np.uint64))
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(first[-1]), np.uint64)
    whole = np.flatnonzero(n >= size)
    if len(whole):
        lens = many[whole]
        inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        at = inside + np.repeat(found.first[whole], lens)
        total = h[at] * factor[0]
        for k in range(1, size):
            total += h[at + k] * factor[k]
        out[inside + np.repeat(first[whole], lens)] = _mixed(total)
    for i in np.flatnonzero((n > 0) & (n < size)):
        run = h[found.first[i] : found.first[i + 1]]
        out[first[i]] = _mixed((run * factor[: len(run)]).sum(keepdims=True) + U(len(run)))[0]
    return out, first
