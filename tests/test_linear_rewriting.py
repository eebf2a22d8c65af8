"""Rewriting of rows with many values, in time that grows with their number; restoring in one pass."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions.arrays import looked_up
from spanloom.operators import detect, rewrite
from spanloom.operators.rules import PORTABLE


@pytest.mark.parametrize(("n", "seconds"), [(10_000, 10), (50_000, 60)])
def test_rows_of_many_values(spark, n, seconds):
    text = " ".join(f"write to user{i % (n // 2)}@example{i % 7}.com or 10.1.{i % 250}.7;" for i in range(n // 2))
    docs = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    rewrite.redact(docs, PORTABLE).collect()  # the code is made once
    began = time.perf_counter()
    row = rewrite.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), PORTABLE).select("redacted", "vault", F.size("spans").alias("n"), rewrite.restore(F.col("redacted"), F.col("vault")).alias("back")).first()
    took = time.perf_counter() - began
    assert row.n == n and row.back == text and "@" not in row.redacted
    assert len({e.placeholder for e in row.vault}) == len(row.vault) == len({e.value for e in row.vault})
    assert took < seconds, took


def test_claims_by_hand(spark):
    r = random.Random(8)
    rows = []
    for i in range(150):
        spans = [(s, s + r.randint(1, 9), "v", "t", "c", r.randint(0, 4)) for s in (r.randint(0, 60 if i % 2 else 3000) for _ in range(r.choice([0, 1, 5, 40, 300])))]
        rows.append((i, list(dict.fromkeys(spans))))
    df = spark.createDataFrame(rows, f"i long, spans array<{detect.SPAN}>")
    for x in df.withColumn("got", detect.claimed(F.col("spans"))).collect():
        held = []
        for s in sorted(x.spans, key=lambda s: (s.rank, *s)):
            if all(s.end <= h.start or h.end <= s.start for h in held):
                held.append(s)
        assert x.got == held


def test_looked_up(spark):
    df = spark.createDataFrame([(["b", "a", "z", "b", ""], [("a", "1"), ("b", "2"), ("c", None), ("b", "3")]), ([], []), (["a"], [])], "k array<string>, e array<struct<key:string,value:string>>")
    assert [r[0] for r in df.select(looked_up(F.col("k"), F.col("e"))).collect()] == [["2", "1", None, "2", None], [], [None]]


def test_restored_values_are_not_read_again(spark):
    def back(text, vault, **more):
        df = spark.createDataFrame([(text, vault)], f"text string, vault array<{rewrite.ENTRY}>")
        return df.select(rewrite.restore(F.col("text"), F.col("vault"), **more)).first()[0]

    chain = [("[A1]", "see [B1] there", "x"), ("[B1]", "secret", "y")]
    assert back("[A1] and [B1]", chain) == "see [B1] there and secret"
    assert back("[A1] and [B1]", chain, disabled=["y"]) == "see [B1] there and [B1]"
    fakes = [("Anna", "Berta", "x"), ("Berta", "Clara", "x"), ("Anna Berg", "Dora (x) $1 \\ |", "x"), ("+1 (2)", "phone", "y")]
    assert back("Anna Berg, Anna, Berta: +1 (2)", fakes) == "Dora (x) $1 \\ |, Berta, Clara: phone"
    assert back("[A1]", None) == back("[A1]", []) == "[A1]" and back(None, chain) is None
    assert back("[A12][A1]x[C1]", chain) == "[A12]see [B1] therex[C1]"


def test_texts_without_spans(spark):
    df = spark.createDataFrame([(1, "plain"), (2, ""), (3, None), (4, "a@b.org"), (5, "x a@b.org")], "doc_id long, text string")
    out = rewrite.redact(df, PORTABLE).withColumn("parts", rewrite.segments(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [r.redacted for r in out] == ["plain", "", "", "[REDACTED_EMAIL_1]", "x [REDACTED_EMAIL_1]"]
    assert [r.parts and [tuple(p) for p in r.parts] for r in out] == [[("text", "plain")], [], None, [("redaction", "a@b.org")], [("text", "x "), ("redaction", "a@b.org")]]
