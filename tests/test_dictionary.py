"""Lists of values against a search for each value, whole words or anywhere, as they stand or loosely."""

import random
import re

import pytest

from spanloom.operators import detect, dictionary

WORD = r"[^\W]"


def by_hand(text, value, edges, loose):
    if not value or not text:
        return []
    pattern = re.escape(value)
    words = [w for w in re.split(r"[\s._-]+", value) if w]
    if loose and len("".join(words)) > dictionary.SHORT:
        pattern = "(?i:" + r"[\s._-]*".join(map(re.escape, words)) + ")"
    if edges:
        pattern = rf"(?<!\w){pattern}(?!\w)"
    found, at = [], 0
    while m := re.compile(pattern).search(text, at):
        found.append((m.start(), m.end(), value))
        at = m.start() + 1
    return found


def random_texts(r, n):
    words = ["ab", "a", "abab", "Jean", "Dupont", "jean-dupont", "x_y", "é", "🙂", "1.2", "JEAN", "dupont"]
    return ["".join(r.choice(words) + r.choice([" ", "", ".", "-", "  ", "\n", ", "]) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("edges", [True, False])
@pytest.mark.parametrize("loose", [True, False])
def test_places_by_hand(edges, loose, monkeypatch):
    r = random.Random(7)
    for block in (1 << 20, 8):
        monkeypatch.setattr(dictionary, "BLOCK", block)
        for _ in range(60):
            texts = random_texts(r, 6)
            pool = [t[a : a + r.randint(1, 20)] for t in texts if t for a in [r.randrange(len(t))]] + ["Jean Dupont", "jeandupont", "ab", "a", "absent"]
            values = sorted({v for v in pool if v and not (loose and re.fullmatch(r"[\s._-]+|[\s._-].*|.*[\s._-]", v, re.S))})
            matcher = dictionary.Matcher(values, edges, loose)
            for t in texts:
                assert sorted(matcher.found(t)) == sorted(x for v in values for x in by_hand(t, v, edges, loose)), (t, values)


def test_scan_and_settle(spark):
    r = random.Random(9)
    texts = random_texts(r, 60)
    values = sorted({t[a : a + r.randint(1, 12)] for t in texts if len(t) > 2 for a in [r.randrange(len(t) - 1)]})
    rows = [(i % 50, i, t, "x", "x") for i, t in enumerate(texts)] + [(1, 998, None, "x", "x"), (1, 999, "", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, row long, text string, value string, start string").repartition(3)
    listed = spark.createDataFrame([(v, 1) for v in values * 2] + [(None, 1), ("", 1)], "value string, start int")
    want = sorted((i, *x) for _, i, t, *_ in rows for v in values for x in by_hand(t, v, True, False))
    for part in (dictionary.PART, 40):  # in one part and in many
        found = dictionary.scan(docs, listed, "row", part=part)
        assert sorted(map(tuple, found.collect())) == want
    held = {}
    for row, s, e, v in sorted(want, key=lambda x: (x[1] - x[2], x[3], x[1])):
        if all(e <= a or b <= s for a, b, _ in held.setdefault(row, [])):
            held[row].append((s, e, v))
    assert sorted(map(tuple, dictionary.settled(found, "row").collect())) == sorted((row, *x) for row, xs in held.items() for x in xs)
    assert dictionary.scan(docs, listed.filter("false"), "row").count() == 0
    once = dictionary.scan(docs, listed, "row", once=True)
    assert sorted(map(tuple, once.collect())) == sorted(min((x for x in want if x[0] == row and x[3] == v)) for row, v in {(x[0], x[3]) for x in want})


def test_many_values_that_share_a_beginning(spark):
    """Thousands of values of one anchor are looked up by key, not one after the other."""
    stem = "https://example.com/a/long/path/that/all/values/share/and/then/some/"
    values = [f"{stem}{i:06d}" for i in range(20_000)]
    text = " ".join(values[::100] + ["other"] * 1000)
    matcher = dictionary.Matcher(values, True, False)
    assert [v for *_, v in sorted(matcher.found(text))] == values[::100]


def test_exact_secrets_are_found_anywhere(spark):
    docs = spark.createDataFrame([(1, "xhunter22y user:pass1.", "v"), (2, None, "v"), (3, "abc", "v")], "doc_id long, text string, value string")
    secrets = spark.createDataFrame([(" hunter22 ",), ("user:pass1",), ("abc",), (None,), ("hunter22",)], "value string")
    assert sorted(map(tuple, detect.exact(docs, secrets, "doc_id").collect())) == [(1, "hunter22"), (1, "user:pass1")]


def test_values_that_may_not_end_are_not_compared():
    """What ends inside a word is turned away by arrays, before it is handled one by one."""
    from spanloom.operators.dictionary import Matcher

    matcher = Matcher(["th", "the", "the end", "é"], True, False)
    text = "the then th the end. théé é"
    assert sorted(matcher.found(text)) == [(0, 3, "the"), (9, 11, "th"), (12, 15, "the"), (12, 19, "the end"), (26, 27, "é")]
    ends = [not (c.isalnum() or c == "_") for c in text + " "]
    assert {text[s:e] for s, e, _ in matcher.plain.places(text, None, __import__("numpy").array(ends))} == {"th", "the", "the end", "é"}
