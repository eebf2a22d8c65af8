import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import detect, gatekeeper
from spanloom.operators.rules import PORTABLE, Rule, _in_a_row, catalogue

GROUPS = [("tel", "phone"), ("@",), ("né", "20"), ("ab",), ("abcabd", "xyz"), *[(f"s{i}q",) for i in range(130)]]


def _texts():
    r = random.Random(5)
    words = ["tel", "phon", "phone", "né", "n", "é", "2", "20", "ab", "abcab", "abcabd", "xy", "xyz", "s7q", "s129q", "-" * 19, "k" * 20, " ", ".", "🙂"]
    return ["", *["".join(r.choices(words, k=r.randint(0, 12))) for _ in range(400)], "tel", "", "@"]


def test_gates_are_those_of_contains(monkeypatch):
    texts = _texts()
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    for chunk in (1 << 21, 7, 64):
        monkeypatch.setattr(gatekeeper, "CHUNK", chunk)
        got = gatekeeper.Gates(GROUPS).open(data, offsets)
        for i, group in enumerate(GROUPS):
            assert [bool(row[i // 63] >> (i % 63) & 1) for row in got] == [any(s in t for s in group) for t in texts]
        n = len(GROUPS)
        for t, row in zip(texts, got, strict=True):
            run = max(map(len, "".join(c if c.isascii() and (c.isalnum() or c in "-_") else " " for c in t).split(" ")))
            assert run < gatekeeper.RUN or row[n // 63] >> (n % 63) & 1


def test_gates_in_spark(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3).filter("i % 7 <> 0")
    got = df.select("i", gatekeeper.open_gates(F.col("t"), GROUPS).alias("g")).select("i", *[gatekeeper.is_open(F.col("g"), k).alias(f"g{k}") for k in (0, 2, 4, 134)]).collect()
    assert sorted((r.i, r.g0, r.g2, r.g4, r.g134) for r in got) == [(i, *[any(s in t for s in GROUPS[k]) for k in (0, 2, 4, 134)]) for i, t in enumerate(texts) if i % 7]


def test_runs_in_patterns():
    assert _in_a_row("[a-z]{3}(?:ab|c)x") == 5 and _in_a_row(r"a[.]b{4}|c{9}") == 4 and _in_a_row(r"(?:ab[0-9])?x{2,}\d") == 3 and _in_a_row("[^a]{30}") == 0
    assert Rule("t", "t", "(?:bc1[a-z]{11}|[13][a-z]{25})").branches == ((frozenset({"bc1"}), 14), (frozenset(), 26))
    assert Rule("t", "t", "(?:a(?:b|c)|d)").branches == () and Rule("t", "t", "[ab]").branches == ()


def test_a_large_catalogue_searches_for_its_strings_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = lambda rules: detect.with_spans(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan(catalogue()) and "ArrowEvalPython" not in plan(PORTABLE)


def test_the_gates_hide_no_match(spark):
    """The whole catalogue against each rule alone, whose strings the JVM looks for."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = ["bc1" + "q" * 39, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "tel: 06 12 34 56 78", "a@b.co\x01\x02", None, "", "sk-" + "aB3" * 12, "0123456789abcdef0123456789abcdef01234567"]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    def found(of):
        return {(r.doc_id, r.start, r.type, r.value) for rules in of for r in detect.spans(docs, rules, "doc_id", resolve=False).collect()}
    whole = catalogue()
    one = found([whole])
    assert one == found([whole[i : i + 15] for i in range(0, len(whole), 15)]) and len(one) > 20
