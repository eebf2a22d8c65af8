"""Packing token streams into windows: order-preserving dynamic programming with a monotone queue.

Each partition of the table is packed as one stream, in the table's order, so
nothing is shuffled and no task holds more than RUN tokens at a time. Within a
run the windows' ends are chosen among all ends of documents and sentences, whole widths from a document's beginning, and places GRID apart where
none of these lies nearer, such that padding plus penalties for cutting is least:

    cost(e) = penalty(e) + min over s in [e - width, e) of cost(s) + width - (e - s)

As width - (e - s) splits into a part of e and one of s, the minimum over the
sliding range is the head of a queue of rising values. A run's last window is
carried over to the next run, so only a partition's last one may be short; it is not
padded where its length is a power of two.

Tokens are those of a public byte-level BPE, followed by END. Words recur, so of the
pieces between single spaces and line ends of about 2 MB of text each distinct one is
looked up once, and those not known are encoded in one call; texts with other white
space are encoded whole. Both give the tokenizer's own ids.

Defined cases: a null text is empty: its only token is END. Repeated rows are
packed each. An empty table gives no rows. A text of any length is cut freely;
each token lies in exactly one piece. Columns other than doc_id and text are ignored unless listed in
``carry``, which puts them on each piece; a carried column may not have the name of a result column.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays
from .common import column

WIDTH, END = 2048, 1
#: What cutting costs, in padding tokens: between documents, sentences, or within a sentence.
CUT_DOCUMENT, CUT_SENTENCE, CUT_INSIDE = 0, 8, 48
#: Tokens packed at a time, and how far apart places within a sentence are at which it may be cut.
RUN, GRID = 1 << 19, 32
#: Pieces of the last slice of text whose ids a task remembers at most (about 20 MB).
REMEMBERED = 1 << 17
#: Texts that are encoded whole: empty ones, and those with white space that isn't a single space or line end within, or with what may be a special token.
WHOLE = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|<\||[\x00-\x09\x0B-\x1F\x7F-\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer of the file gives them."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": 50256}
        self._special = set(special)
        self._encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._line = ranks[b"\n"]
        self.forget()
        #: Whether a token ends a sentence or a line.
        self.ends = np.zeros(50257, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))

    def forget(self) -> None:
        """The pieces go with the task: its worker lives on and would hold them through the stages that follow."""
        self._known: dict[str, int] = {}
        self._ids, self._lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text]))).tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, WHOLE)
        ids, bounds = self._in_pieces(*text_arrays.texts(texts.filter(pc.invert(whole))))
        places = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        for text, alone in zip(texts, whole.to_pylist(), strict=True):
            if alone:
                yield self._encoding.encode_to_numpy(text.as_py(), allowed_special=self._special)
            else:
                begin, end = next(places)
                yield ids[begin:end]

    def _in_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that aren't encoded whole, one after the other, and the bounds between them.

        A single space between two other characters always begins a new piece,
        and a single line end between two is one of its own.
        """
        line = data == 10
        begin = line | (data == 32)
        begin[1:] |= line[:-1]
        begin[offsets[:-1]] = True
        starts = np.flatnonzero(begin)
        buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
        ids, lengths = self._distinct(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        if len(data) > text_arrays.SLICE_BYTES:
            # A long text's pieces may be long, too.
            self.forget()
        which = pieces.indices.to_numpy()
        ends = np.cumsum(lengths[which])
        return _runs(ids, (np.cumsum(lengths) - lengths)[which], lengths[which]), np.append(0, ends)[np.searchsorted(starts, offsets)]

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has.

        Those that the last slice hadn't are encoded in one call, as lines, since a line end is a token of its own.
        """
        at = np.fromiter(map(self._known.get, pieces, repeat(-1)), np.int64, len(pieces))
        old, new = at >= 0, at < 0
        if "\n" in pieces:
            i = pieces.index("\n")
            old[i] = new[i] = False
        # No piece holds a special token.
        made = self._encoding.encode_to_numpy("\n".join(["", *compress(pieces, new.tolist())]), disallowed_special=())
        lines = np.append(np.flatnonzero(made == self._line), len(made))
        pool = np.concatenate([made, self._ids, np.array([self._line], np.uint32)])
        starts, lengths = np.full(len(pieces), len(pool) - 1), np.ones(len(pieces), np.int64)
        starts[new], lengths[new] = lines[:-1] + 1, np.diff(lines) - 1
        starts[old], lengths[old] = len(made) + (np.cumsum(self._lengths) - self._lengths)[at[old]], self._lengths[at[old]]
        ids = _runs(pool, starts, lengths)
        self._known = dict(zip(pieces, range(REMEMBERED), strict=False))
        self._lengths = lengths[: len(self._known)]
        self._ids = ids[: self._lengths.sum()]
        return ids, lengths


def _runs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, one after the other. There are fewer than 2^31, as an Arrow text has fewer bytes."""
    ends = np.cumsum(lengths)
    place = np.repeat((starts - ends + lengths).astype(np.int32), lengths)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place]


@lru_cache(1)
def encoder() -> Encoder:
    """One for a Python worker, so that tasks after the first needn't read the tokens."""
    return Encoder()


def choose(ends: np.ndarray, penalties: np.ndarray, width: int = WIDTH) -> list[int]:
    """Indices into ends (rising places, the first of them 0) of the cheapest windows' ends, the last of ends included."""
    n = len(ends)
    cost, back = [0.0] * n, [0] * n
    places, extra = ends.tolist(), penalties.tolist()
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, n):
        place = places[i]
        while places[queue[0][1]] < place - width:
            queue.popleft()
        value, s = queue[0]
        cost[i], back[i] = value + width - place + extra[i], s
        value = cost[i] + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    out, i = [], n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


def _places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end in a run, and what it costs."""
    cut = np.full(len(ids) + 1, -1, np.int16)
    for begin, end in zip(np.append(0, doc_ends), np.append(doc_ends, len(ids)), strict=True):
        cut[begin + width : end : width] = CUT_INSIDE
    cut[1:][sentence[ids]] = CUT_SENTENCE
    cut[doc_ends] = CUT_DOCUMENT
    cut[0] = cut[-1] = 0
    at = np.flatnonzero(cut >= 0)
    # Longer gaps are filled.
    step = max(1, min(GRID, width // 8))
    more = (np.diff(at) - 1) // step
    inside = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    cut[np.repeat(at[:-1], more) + step * (inside + 1)] = CUT_INSIDE
    at = np.flatnonzero(cut >= 0)
    return at, cut[at]


class _Packer:
    """Packs one stream of documents, run after run."""

    def __init__(self, sentence: np.ndarray, width: int, first_sequence: int):
        self.sentence, self.width, self.sequence = sentence, width, first_sequence
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # key, ids that are left, tokens before them, all
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        # A long document goes in by runs, so that no run is much longer than RUN.
        for at in range(0, len(ids), RUN):
            part = ids[at : at + RUN]
            self.docs.append((key, part, at, len(ids)))
            self.held += len(part)
            if self.held >= RUN:
                yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces of the run as (key, start, length, crc32, all tokens, sequence, offset)."""
        if not self.held:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        bounds = np.cumsum([0, *(len(d[1]) for d in self.docs)])
        whole = [b for b, d in zip(bounds[1:], self.docs, strict=True) if d[2] + len(d[1]) == d[3]]
        at, extra = _places(ids, np.array(whole, np.int64), self.sentence, self.width)
        chosen = at[choose(at, extra, self.width)]
        if not last and len(chosen) > 1:
            chosen = chosen[:-1]
        begin, doc = 0, 0
        raw = ids.astype("<u4").tobytes()
        for end in chosen.tolist():
            place = begin
            while place < end:
                while bounds[doc + 1] <= place:
                    doc += 1
                to = int(min(end, bounds[doc + 1]))
                key, _, before, total = self.docs[doc]
                yield key, before + place - int(bounds[doc]), to - place, zlib.crc32(raw[4 * place : 4 * to]), total, self.sequence, place - begin
                place = to
            self.sequence += 1
            begin = end
        left = []
        for i in range(len(self.docs)):
            if bounds[i + 1] > begin:
                key, part, before, total = self.docs[i]
                skip = max(0, begin - int(bounds[i]))
                left.append((key, part[skip:], before + skip, total))
        self.docs, self.held = left, len(ids) - begin


PIECES = pa.schema([(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _packed(names: list[str], width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_encoder = encoder()
    packer = _Packer(own_encoder.ends, width, TaskContext.get().partitionId() << 40)
    rows: list[tuple] = []
    last: pa.RecordBatch | None = None

    def batch() -> pa.RecordBatch:
        keys, *columns = zip(*rows, strict=True)
        held = pa.Table.from_batches([k.slice(i, 1) for k, i in keys]).combine_chunks() if more else None
        head = [held.column(c).combine_chunks() for c in names] if more else [pa.array(keys, kind)]
        return pa.RecordBatch.from_arrays([*head, *(pa.array(c, pa.int64()) for c in columns)], names=[*names, *PIECES.names])

    more, kind = len(names) > 1, pa.int64()
    for part in (x for b in batches for x in text_arrays.slices([b], b.schema.names[-1])):
        own = part.select(names)
        ids = own.column(0).to_pylist()
        for i, tokens in enumerate(own_encoder.encode_all(part.column(part.num_columns - 1))):
            rows += packer.add((own, i) if more else ids[i], np.append(tokens, np.uint32(END)))
            if len(rows) >= 20_000:
                yield batch()
                rows.clear()
        last = part
    if last is not None:
        rows += packer.pack(True)
    own_encoder.forget()
    if rows:
        yield batch()


def pack(docs: DataFrame, width: int = WIDTH, carry: list[str] = ()) -> DataFrame:
    """doc_id, the carried columns and a row for each piece: start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", *[c for c in carry if c != "doc_id"]]
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), *[F.col(f"`{c}`") for c in names[1:]], column(docs, "text", "string").alias("_text"))
    schema = T.StructType([*base.schema.fields[:-1], *(T.StructField(x, T.LongType()) for x in PIECES.names)])
    return base.mapInArrow(lambda x: _packed(names, width, x), schema)


def padded(length: int, width: int = WIDTH) -> int:
    """What a sequence of that many tokens takes: its width, or less where it is a power of two."""
    return length if length & (length - 1) == 0 else width
