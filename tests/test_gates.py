"""Gates on spans against loops, and reports on nulls and empty tables."""

import random

from pyspark.sql import functions as F

from spanloom.operators import detect, gates, reports

KIND = f"i int, text string, spans array<{detect.SPAN}>"


def rows(n=60):
    r = random.Random(3)
    out = []
    for i in range(n):
        text = "".join(r.choice("ab 1.\n\"") for _ in range(40))
        spans = []
        for _ in range(r.randint(0, 9)):
            a = r.randint(0, 38)
            b = r.randint(a + 1, min(40, a + 12))
            spans.append((a, b, text[a:b], "t", r.choice(["name", "location", "card", "other"]), r.randint(0, 5)))
        out.append((i, text, spans))
    return [*out, (n, None, None), (n + 1, "", [])]


def got(spark, gate):
    return {r.i: r.s and [tuple(x) for x in r.s] for r in spark.createDataFrame(rows(), KIND).select("i", gate(F.col("spans")).alias("s")).collect()}


def test_denested(spark):
    found = got(spark, gates.denested)
    for i, _, spans in rows():
        if not spans:
            assert not found[i]
            continue
        reach, free = -1, set()
        for s in sorted(spans, key=lambda s: (s[0], -s[1], s[5], s[2])):
            if s[1] > reach:
                free.add(s[2])
            reach = max(reach, s[1])
        assert found[i] == [s for s in spans if s[2] in free]


def test_trimmed_and_by_line(spark):
    marks = " \n\"“”«»,;:.!?–-'"
    found, lines = got(spark, gates.trimmed), got(spark, lambda s: gates.by_line(s, ["name"]))
    for i, text, spans in rows():
        want = []
        for a, b, v, t, c, k in spans or []:
            core = v.lstrip(marks + "([{").rstrip(marks + ")]}")
            if core:
                at = a + len(v) - len(v.lstrip(marks + "([{"))
                want.append((at, at + len(core), core, t, c, k))
                assert text[at : at + len(core)] == core
        assert (found[i] or []) == want
        want = []
        for a, b, v, t, c, k in spans or []:
            if c != "name" or "\n" not in v:
                want.append((a, b, v, t, c, k))
                continue
            for line in v.split("\n"):
                if line.strip(" "):
                    want.append((a, a + len(line), line, t, c, k))
                a += len(line) + 1
        assert (lines[i] or []) == want


def test_numbers_terms_and_places(spark):
    spans = [(0, 3, "123", "t", "other", 0), (4, 7, "123", "t", "card", 0), (8, 11, "The Team", "t", "company", 0), (12, 15, "The Acme Team", "t", "company", 0)]
    df = spark.createDataFrame([(1, "", spans), (2, "", [(0, 3, "Paris", "t", "location", 0)])], KIND)
    terms = F.array(F.lit("the"), F.lit("team"))
    row = df.select("i", gates.numbers_with_meaning(F.col("spans")).alias("a"), gates.without_terms(F.col("spans"), terms).alias("b"), gates.anchored_places(F.col("spans")).alias("c")).orderBy("i").collect()
    assert [s.category for s in row[0].a] == ["card", "company", "company"]
    assert [s.value for s in row[0].b] == ["123", "123", "The Acme Team"]
    assert len(row[0].c) == 4 and row[1].c == []


def test_reports_of_nulls_and_nothing(spark):
    vault = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (None, "ab", None), (2, None, "y"), (2, "", "y")], "conv_id long, value string, category string")
    turns = spark.createDataFrame([(1, 0, "ab ab"), (1, 1, None), (None, 0, "ab"), (3, 0, "ab")], "conv_id long, turn long, text string")
    assert [tuple(r) for r in reports.message_breakdown(turns, vault).collect()] == [("x", 1, 1)]
    assert {r.conv_id: r.total for r in reports.conversation_events(vault).collect()} == {1: 1, None: 1, 2: 2}
    nothing = vault.filter("false")
    assert reports.message_breakdown(turns, nothing).count() == reports.conversation_events(nothing).count() == reports.protected_entries(nothing).count() == 0
    assert [r.spaced for r in spark.createDataFrame([(1234567,), (-1234,), (12,), (None,)], "n long").select(reports.spaced_thousands(F.col("n")).alias("spaced")).collect()] == ["1 234 567", "-1 234", "12", None]
