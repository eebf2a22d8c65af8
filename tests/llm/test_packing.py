import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import packing


def brute(ends, penalties, width):
    best = [0.0] + [float("inf")] * (len(ends) - 1)
    for i in range(1, len(ends)):
        best[i] = min((best[j] + width - (ends[i] - ends[j]) + penalties[i] for j in range(i) if ends[i] - ends[j] <= width), default=float("inf"))
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_choose_is_cheapest(seed):
    r = random.Random(seed)
    ends = np.cumsum([0, *(r.randint(1, 20) for _ in range(r.randint(1, 40)))])
    penalties = np.array([0, *(r.choice([0, 8, 48]) for _ in ends[1:])])
    got = packing.choose(ends, penalties, 40)
    cost, was = 0.0, 0
    for i in got:
        assert 0 < ends[i] - ends[was] <= 40
        cost += 40 - (ends[i] - ends[was]) + penalties[i]
        was = i
    assert was == len(ends) - 1
    assert cost == brute(ends.tolist(), penalties.tolist(), 40)


def test_a_text_without_sentences_fills_its_windows():
    ids = np.arange(9000)
    at, extra = packing._places(ids, np.array([9000]), np.zeros(9001, bool), 2048)
    ends = at[packing.choose(at, extra)]
    assert ends.tolist() == [2048, 4096, 6144, 8192, 9000]
    assert np.diff(at).max() <= packing.GRID


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [
    None, "", " ", "a", "\n", "Hello world.\nNext line", "two  spaces", "a \n b", " lead", "trail ", "it's we'll nbsp x", "<|endoftext|> in text",
    "tab\there", "é à em", "1234 5678 ***&&&", "line\r\nend", "ÄÖÜ ß!! WORD!!", "​zero", "🙂 smile 🙂🙂", "x " * 9000, "Sentence one. " * 3000,
]


def test_ids_are_the_tokenizers():
    encoder = packing.Encoder()
    got = [[*np.frombuffer(encoder.encode(x or ""), np.uint32).tolist(), 1] for x in TEXTS]
    assert got == tokens(TEXTS)


def test_ids_of_a_batch_are_the_tokenizers():
    r, encoder = random.Random(8), packing.Encoder()
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace()]
    odd = ["a", "B", "é", "'s", "'ll", "12", ".", "!?", "<|", "<|endoftext|>", "\u0301", "\u200b", "\ufeff", "🙂", "\x00", "\x7f", "\xad", "-" * 70]
    for plain in (True, False):
        between = [" ", " ", "\n"] if plain else [" ", "\n", "  ", "\n\n", " \n", "\n ", *spaces]
        texts = ["".join(r.choice(odd) + r.choice(["", "", r.choice(between)]) for _ in range(r.randint(0, 30))) for _ in range(700)]
        texts += [f"a{x}b" for x in spaces] + [f"a b{x}" for x in spaces] + [f"{x}b c" for x in spaces] + [None, ""]
        for part in (texts, texts[::-1], texts[350:], []):
            got = [[*ids.tolist(), 1] for ids in encoder.encode_all(pa.array(part, pa.string()))]
            assert got == tokens(part)


class Counted:
    def __init__(self, of):
        self.of, self.calls = of, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.of, name)


def test_the_new_pieces_of_a_slice_are_encoded_at_once(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    encoder = packing.Encoder()
    encoder._encoding = Counted(encoder._encoding)
    monkeypatch.setattr(packing, "encoder", lambda: encoder)
    monkeypatch.setattr(packing, "TaskContext", Task)
    texts = [" ".join(f"w{1000 * i + k:x}" for k in range(1000)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": texts})
    pieces = pa.Table.from_batches(packing._packed(["doc_id"], 2048, iter([batch]))).to_pylist()
    assert sum(x["length"] for x in pieces) == sum(map(len, tokens(texts)))
    assert encoder._encoding.calls <= 5


def test_a_long_text_is_forgotten():
    encoder = packing.Encoder()
    next(encoder.encode_all(pa.array(["few words\n" * 2 + "end"])))
    assert encoder._known
    text = " ".join(f"{i:x}" + "y" * 100 for i in range(30_000))
    ids = next(encoder.encode_all(pa.array([text])))
    assert [[*ids.tolist(), 1]] == tokens([text])
    assert not encoder._known and not len(encoder._ids)


def test_a_worker_remembers_few_pieces_and_those_that_recur():
    encoder, n = packing.Encoder(), 300_000
    words = [f"w{i:x}" for i in range(n)]
    texts = [" ".join(["often", *words[i : i + 1000]]) for i in range(0, n, 1000)]
    got = [np.frombuffer(encoder.encode(x), np.uint32).tolist() for x in texts]
    held = [v for v in vars(encoder).values() if isinstance(v, dict)]
    assert sum(map(len, held)) <= 1 << 18
    assert any("often" in x for x in held) and any(" " + words[-1] in x for x in held) and not any(" " + words[1] in x for x in held)
    some = [*range(0, len(texts), 29), len(texts) - 1]
    assert [[*got[i], 1] for i in some] == tokens([texts[i] for i in some])


def test_a_worker_forgets_its_pieces_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string").coalesce(1)

    def held(batches):
        list(packing._packed(["doc_id"], 2048, batches))
        left = sum(len(v) for v in vars(packing.encoder()).values() if isinstance(v, dict))
        yield pa.RecordBatch.from_pylist([{"doc_id": left}], pa.schema([("doc_id", pa.int64())]))

    assert [r.doc_id for r in docs.select("doc_id", "text").mapInArrow(held, "doc_id long").collect()] == [0]


def test_every_token_lies_in_one_piece(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "a", "x")], "doc_id long, text string, length string")
    rows = packing.pack(docs).collect()
    want = {(i, None if t is None else t): ids for (i, t), ids in zip(enumerate(TEXTS), tokens(TEXTS), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (i, _), ids in want.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if i == 3:
            assert [(r.start, r.length, r.doc_tokens) for r in pieces] == [(0, 2, 2)] * 2
            continue
        at = 0
        for r in pieces:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= packing.WIDTH
    assert len(by_doc[None]) == 1


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    sizes = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    held = sum(packing.padded(r.n) for r in sizes)
    assert sum(r.n for r in sizes) >= 0.97 * held


def test_carried_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "q"), (2, "c" * 5000, None, "q")], "doc_id long, text string, source string, other string")
    got = packing.pack(docs, carry=["source"]).collect()
    assert {(r.doc_id, r.source) for r in got} == {(1, "s"), (2, None)}
    assert packing.pack(docs.filter("false")).count() == 0
    assert packing.pack(docs.drop("text")).count() == 2
