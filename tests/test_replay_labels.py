"""Forward replay, labelled values and valid prefixes: against loops, and on nulls, ties and odd characters."""

import random
import re

from pyspark.sql import functions as F

from spanloom.functions import checks
from spanloom.operators import gates, labels, replay, rewrite

VAULT = f"array<{rewrite.ENTRY}>"


def run(spark, rows, f):
    docs = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], f"i int, text string, vault {VAULT}")
    return [r.out for r in docs.select("i", f(F.col("text"), F.col("vault")).alias("out")).orderBy("i").collect()]


def by_loop(text, vault):
    """Longest value first; what is replaced is not looked at again."""
    pieces = [(False, text)]
    for placeholder, value, _ in sorted((e for e in vault if e[1].strip()), key=lambda e: (-len(e[1]), e[1], e[0])):
        out = []
        for settled, part in pieces:
            if settled:
                out.append((settled, part))
                continue
            found = re.split(rf"(?<!\w){re.escape(value)}(?!\w)", part)
            for k, x in enumerate(found):
                out += ([(True, placeholder)] if k else []) + [(False, x)]
        pieces = out
    return "".join(p for _, p in pieces)


def test_applied_equals_a_loop(spark):
    r = random.Random(5)
    rows = []
    for _ in range(80):
        vault = [(f"[A{k}]", "".join(r.choice("ab .A1") for _ in range(r.randint(0, 4))), "name") for k in range(r.randint(0, 4))]
        rows.append(("".join(r.choice("ab .A1[]") for _ in range(60)), vault))
    assert run(spark, rows, replay.applied) == [by_loop(*x) for x in rows]


def test_replay_of_odd_values(spark):
    ann, mail = ("[PERSON1]", "Ann Lee", "name"), ("[EMAIL1]", "a+b@melvio.com", "email")
    rows = [
        ("ANN-LEE met ann  lee, annlee and Ann Leeds", [ann]),
        ("a+b@melvio.com, aab@melvio.com, A+B@MELVIO.COM", [mail]),
        ("Bo, BO and bo", [("[PERSON1]", "Bo", "name")]),
        ("the PERSON is PERSON1", [("[PERSON1]", "the PERSON", "name"), ("[X]", "PERSON", "name")]),
        ("cost $5 (net) \\E", [("[X$1\\]", "$5 (net)", "amount")]),
        (None, [ann]),
        ("Ann Lee", None),
        ("", [ann]),
        ("Ann Lee", [("[A]", "", "name"), ("[B]", " ", "name")]),
    ]
    assert run(spark, rows, replay.replayed) == [
        "[PERSON1] met [PERSON1], [PERSON1] and Ann Leeds",
        "[EMAIL1], aab@melvio.com, [EMAIL1]",
        "[PERSON1], BO and bo",
        "[PERSON1] is PERSON1",
        "cost [X$1\\] \\E",
        None,
        "Ann Lee",
        "",
        "Ann Lee",
    ]


def test_replay_is_undone_by_restoring(spark):
    vault = [("[PERSON1]", "Ann Lee", "name"), ("[PERSON2]", "Ann", "name")]
    text = "Ann Lee and Ann; Anna isn't Ann."
    assert run(spark, [(text, vault)], replay.applied) == ["[PERSON1] and [PERSON2]; Anna isn't [PERSON2]."]
    assert run(spark, [(text, vault)], lambda t, v: rewrite.restore(replay.applied(t, v), v)) == [text]


def told(spark, f, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [[tuple(x) for x in r.out] for r in docs.select("i", f(F.col("text")).alias("out")).orderBy("i").collect()]


def test_blocks(spark):
    long = "\n".join(["Name"] * 21 + ["v"] * 21)
    most = "\n".join(["Name"] * 20 + [f"v{k}" for k in range(20)])
    got = told(spark, labels.blocks, ["Nom:\nPrénom\nVille :\r\nA\nB\nC\nD", "Name\nCity\nA\nB", "Name\nCity\nPhone\nA\nB", "Name\nCity\nPhone\nA\n\nC", "Name\nCity\nPhone", long, most, "", None, "x\nName\nCity\nTel\n1\n2\n3\nName\nCity\nTel\n4\n5\n6"])
    assert got[0] == [("Nom", "name", "A"), ("Prénom", "name", "B"), ("Ville", "location", "C")]
    assert got[1:6] == [[]] * 5 and got[7:9] == [[]] * 2
    assert [x[2] for x in got[6]] == [f"v{k}" for k in range(20)]
    assert [x[2] for x in got[9]] == ["1", "2", "3", "4", "5", "6"]


def test_fields(spark):
    got = told(spark, labels.fields, ["Name: Ann Lee\nunknown: x\nTel = 1:2", "Geburtsdatum:\n1. 2. 1990", "City:\nName: Ann", "City:\n\nBonn", "City:", "see name here: x", "", None, "Name: a\nName: a"])
    assert got == [
        [("Name", "name", "Ann Lee"), ("Tel", "phone", "1:2")],
        [("Geburtsdatum", "date", "1. 2. 1990")],
        [("Name", "name", "Ann")],
        [],
        [],
        [],
        [],
        [],
        [("Name", "name", "a")] * 2,
    ]


def test_longest_valid(spark):
    values = ["4111 1111 1111 1111 12 34", "4111 1111 1111 1111", "1 2", "", None, "4111 1111 1111 1111" + " 1" * 13]
    docs = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.out for r in docs.select("i", gates.longest_valid(F.col("v"), checks.card).alias("out")).orderBy("i").collect()]
    assert got == ["4111 1111 1111 1111", "4111 1111 1111 1111", None, None, None, None]
