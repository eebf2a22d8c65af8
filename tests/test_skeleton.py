"""Skeletons against a character-by-character reading, and spans of disguised texts against those of the plain ones."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.functions.arrays import blocks, cut, scanned
from spanloom.operators import detect, skeleton
from spanloom.operators.rules import PORTABLE, catalogue

HIDDEN = ["​", "­", "⁠", "﻿", "‍", "️"]


def hidden(c):
    return any(a <= ord(c) <= b for a, b in skeleton.IGNORABLE)


def by_hand(text):
    out, starts, ends, i = "", [], [], 0
    while i < len(text):
        if hidden(text[i]):
            i += 1
            continue
        start, shown, end = i, text[i], i + 1
        i += 1
        j = i
        while j < len(text) and (hidden(text[j]) or unicodedata.category(text[j])[0] == "M"):
            if not hidden(text[j]):
                shown, end, i = shown + text[j], j + 1, j + 1
            j += 1
        c = shown[0]
        if 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        elif unicodedata.category(c) == "Nd":
            c = str(unicodedata.decimal(c))
        new = unicodedata.normalize("NFC", c + shown[1:])
        out, starts, ends = out + new, starts + [start] * len(new), ends + [end] * len(new)
    return None if out == text else (out, starts, ends)


def test_skeleton_by_hand():
    r = random.Random(1)
    alphabet = [*"abé 09@.-", "é", "́", "̧", "０", "＠", "ａ", "٣", "९", "𝟗", "한", "하", "🙂", "\n", "　", "\xa0", *HIDDEN]
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        got = skeleton.skeleton(text)
        want = by_hand(text)
        assert (got and (got[0], got[1].tolist(), got[2].tolist())) == want, repr(text)


@pytest.mark.parametrize("text", ["", "plain", "Hélène Cortès, 12\xa0rue", "🙂 日本語　한글", "　"])
def test_ordinary_texts_have_none(text):
    assert skeleton.skeleton(text) is None


CASES = [
    ("mail jean​.dupont@acme.fr merci", "jean​.dupont@acme.fr"),
    ("mail jean.dupont＠acme.fr", "jean.dupont＠acme.fr"),
    ("card 4539​1488 0343 6467.", "4539​1488 0343 6467"),
    ("card ４５３９ １４８８ ０３４３ ６４６７.", "４５３９ １４８８ ０３４３ ６４６７"),
    ("ip ١٠.٢٠.٣٠.٤٠ here", "١٠.٢٠.٣٠.٤٠"),
    ("key AKIA­IOSFODNN7EXAMPLE end", "AKIA­IOSFODNN7EXAMPLE"),
    ("plain a@b.org", "a@b.org"),
]


def test_disguised_values_are_found_as_they_stand(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(98, None, "x"), (99, "", "x"), (100, "​" * 5000 + "a@b.org " + "٣" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    found = skeleton.with_mapped_spans(docs, catalogue()).collect()
    by = {r.doc_id: r for r in found}
    for i, (text, value) in enumerate(CASES):
        assert value in [s.value for s in by[i].spans], text
    for r in found:
        assert all(r.text[s.start : s.end] == s.value for s in r.spans)
    assert by[98].spans == by[99].spans == [] and "a@b.org" in [s.value for s in by[100].spans]
    assert set(found[0].asDict()) == {"doc_id", "text", "value", "spans"}


def test_plain_texts_stay_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a@b.org é 12"), (2, "ａ@b.org")], "doc_id long, text string")
    plain, other = (r.skeleton for r in skeleton.with_skeleton(docs).orderBy("doc_id").collect())
    assert (plain.text, plain.start) == (None, None) and other.text == "a@b.org"
    same = detect.with_spans(docs.filter("doc_id = 1"), PORTABLE).collect()
    assert skeleton.with_mapped_spans(docs.filter("doc_id = 1"), PORTABLE).collect() == same


def test_blocks_cut_as_substring_does(spark):
    r = random.Random(4)
    texts = ["", "a", "🙂é" * 10, "abcdefgh" * 8, None]
    rows = [(t, a, b) for t in texts for _ in range(40) for a, b in [sorted((r.randint(0, len(t or "")), r.randint(0, len(t or ""))))]]
    df = spark.createDataFrame(rows, "text string, a int, b int").withColumn("p", blocks(F.col("text"), 8))
    for x in df.withColumn("got", cut(F.col("p"), F.col("a"), F.col("b"), 8)).collect():
        assert x.got == (x.text or "")[x.a : x.b]
        assert "".join(x.p) == (x.text or "")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_scanned_is_a_running_state(spark, n):
    df = spark.range(1).select(F.array(*[F.lit(i) for i in range(n)]).cast("array<long>").alias("x"))
    sums = scanned(F.col("x"), F.struct(F.lit(0).cast("long").alias("t")), lambda s, x: F.struct((s["t"] + x).alias("t")), lambda s, x: F.when(x % 3 != 0, s["t"] + x), "bigint", lambda s: s["t"])
    want = [sum(range(i + 1)) for i in range(n) if i % 3] + [sum(range(n))]
    assert df.select(sums).first()[0] == want
