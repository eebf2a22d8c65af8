"""Which rules can match a text at all: one pass of the texts, whatever the number of rules.

A rule's matches hold one of some strings, or a run of at least so many letters, digits, dashes and underscores. The strings of all rules are looked for together: of each
string, three characters (those that are rarest) are its anchor; bytes of lower-cased texts are looked up three at a time in one small table, and what is met is compared
with the whole string. Strings of two bytes have a table of their own. So the time a character hardly depends on the number of strings, where a search
for each of them takes a pass of its own.

The texts' bytes are read where Arrow holds them, ``CHUNK`` at a time with an overlap. What passes is a superset only where a run goes on from one text to the next;
rules decide themselves what matches. A null text holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes read at once.
CHUNK = 1 << 21
#: Runs are told from RUN bytes on.
RUN = 20
_COMMON = " etaoinsrhldcumfpgwybvkxjqz"
_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"]] = True


def _rarity(b: int) -> int:
    return _COMMON.index(chr(b)) if chr(b) in _COMMON else 30


def _three(x: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A hash of 16 bits for each three bytes."""
    return (two[:-1] * np.uint16(40503)) ^ (x[2:].astype(np.uint16) * np.uint16(31153))


class Gates:
    """Gate i of a text is open where it holds one of groups[i]; the gate after the last one, where it holds a run."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        self.words = len(groups) // 63 + 1
        of: dict[bytes, np.ndarray] = {}
        for i, strings in enumerate(groups):
            for s in strings:
                of.setdefault(s.encode(), np.zeros(self.words, np.int64))[i // 63] |= 1 << i % 63
        self.run = np.zeros(self.words, np.int64)
        self.run[len(groups) // 63] = 1 << len(groups) % 63
        self.longest = max([RUN, *map(len, of)])
        # Of each string: its bytes, where its anchor stands in it, the gates that it opens; by the size of the anchor and its hash.
        self.by: dict[int, dict[int, list[tuple[bytes, int, np.ndarray]]]] = {1: {}, 2: {}, 3: {}}
        for s, bits in of.items():
            n = min(3, len(s))
            at = max(range(len(s) - n + 1), key=lambda k: sum(map(_rarity, s[k : k + n])))
            self.by[n].setdefault(int(self._hash(np.frombuffer(s[at : at + n], np.uint8), n)[0]), []).append((s, at, bits))
        self.seen = {n: np.isin(np.arange(1 << 16), list(some)) for n, some in self.by.items() if some}

    @staticmethod
    def _hash(x: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return x.astype(np.uint16)
        two = (x[:-1].astype(np.uint16) << np.uint16(8)) | x[1:]
        return two if n == 2 else _three(x, two)

    def open(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of words of 63 gates for each text between neighbouring offsets of data."""
        out = np.zeros((len(offsets) - 1, self.words), np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        for begin in range(first, last, CHUNK):
            x = data[begin : min(begin + CHUNK + self.longest, last)]
            stops = np.concatenate([[-1], np.flatnonzero(~_IN_RUN[x]), [len(x)]])
            long = np.flatnonzero(np.diff(stops) > RUN)
            # A run may begin in one text and end in another: all that it touches.
            for a, b in zip(stops[long] + 1, stops[long + 1] - 1, strict=True):
                r = np.searchsorted(offsets, [begin + a, begin + b], "right") - 1
                out[r[0] : r[1] + 1] |= self.run
            for n, table in self.seen.items():
                if len(x) < n:
                    continue
                h = self._hash(x, n)
                at = np.flatnonzero(table[h])
                order = np.argsort(h[at], kind="stable")
                at, h = at[order], h[at[order]]
                keys = np.fromiter(self.by[n], np.int64)
                for key, a, b in zip(keys.tolist(), np.searchsorted(h, keys).tolist(), np.searchsorted(h, keys, "right").tolist(), strict=True):
                    for s, shift, bits in self.by[n][key] if b > a else ():
                        p = at[a:b] - shift
                        p = p[(p >= 0) & (p + len(s) <= len(x))]
                        for k, byte in enumerate(s):
                            p = p[x[p + k] == byte]
                        if len(p):
                            row = np.searchsorted(offsets, p + begin, "right") - 1
                            row = np.unique(row[p + begin + len(s) <= offsets[row + 1]])
                            out[row] |= bits
        return out


def open_gates(low: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<bigint> for a lower-cased text: bit i % 63 of element i // 63 tells whether gate i is open."""
    held = Gates(groups)

    @F.arrow_udf("array<bigint>")
    def opened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            body = texts.buffers()[2]
            bits = held.open(np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8), offsets)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(held.words)), pa.array(bits.ravel()))

    return opened(low)


def is_open(gates: Column, i: int) -> Column:
    return F.get(gates, F.lit(i // 63)).bitwiseAND(F.lit(1 << i % 63)) != 0
