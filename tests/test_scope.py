"""Tokens over scopes against one pass in memory, and reruns that keep what was stored."""

import random
import re

from spanloom.operators import scope

KIND = "scope string, value string, category string, first long"
WORDS = {"name": "PERSON"}


def key(category, value):
    return re.sub(r"[\s._-]+", "", value.lower()) if category in scope.CASED else value


def form(category, value):
    if category not in scope.CASED or not any(c.isalpha() for c in value):
        return 0
    return 1 if value == value.lower() else 2 if value == value.upper() else 0


def by_hand(rows):
    """Of each (scope, word) the entities, by union of names that share a word, numbered by first appearance."""
    first = {}
    for s, v, c, at in rows:
        if v:
            first[s, c, v] = min(at, first.get((s, c, v), at))
    groups, of = [], {}
    for (s, c, v), at in first.items():
        links = {(s, c, key(c, v))} | ({(s, w.lower()) for w in re.split(r"[\s._-]+", v) if re.fullmatch(r"[^\W\d_]{4,}", w)} if c == "name" else set())
        merged = [g for g in groups if g[0] == (s, c) and g[1] & links]
        new = ((s, c), links.union(*[g[1] for g in merged]), [(s, c, v), *[x for g in merged for x in g[2]]])
        groups = [g for g in groups if g not in merged] + [new]
    counters = {}
    for sc, _, members in sorted(groups, key=lambda g: min(first[m] for m in g[2])):
        counters[sc] = counters.get(sc, 0) + 1
        for m in members:
            of[m] = counters[sc]
    return of


def test_numbers_by_hand(spark):
    r = random.Random(2)
    names = ["Léa Morvan", "L. Morvan", "Morvan", "LÉA MORVAN", "léa morvan", "Jean Petit", "Jean-Petit", "Ann Li", "Bo Li", "Petit", "Karl Studio"]
    rows = [(r.choice(["a", "b", None]), r.choice(names), "name", i) for i in range(60)] + [(r.choice(["a", None]), f"u{r.randint(0, 9)}@x.org", "email", 100 + i) for i in range(30)] + [("a", "", "name", 1), ("a", None, "name", 2)]
    got = scope.allocate(spark.createDataFrame(rows, KIND).repartition(4)).collect()
    want = by_hand(rows)
    assert {(x.scope, x.category, x.value) for x in got} == set(want) and len(got) == len(want)
    assert len({(x.scope, x.token) for x in got}) == len(got)
    for x in got:
        m = re.fullmatch(scope.TOKEN, x.token)
        assert int(m[2]) == want[x.scope, x.category, x.value], x
        f = form(x.category, x.value)
        assert m[1] == (WORDS.get(x.category, x.category.upper()).lower() if f == 1 else WORDS[x.category].capitalize() if f == 2 else WORDS.get(x.category, x.category.upper()))


def test_stored_tokens_stay(spark):
    made = lambda rows: spark.createDataFrame(rows, KIND)
    vault = lambda df: {(x.scope, x.value): x.token for x in df.collect()}
    first = [("s", "Ann Berg", "name", 5), ("s", "Bo Ek", "name", 9), ("s", "a@b.org", "email", 1)]
    one = scope.allocate(made(first)).checkpoint()
    assert vault(one) == {("s", "Ann Berg"): "[PERSON1]", ("s", "Bo Ek"): "[PERSON2]", ("s", "a@b.org"): "[EMAIL1]"}
    more = [("s", "A. Berg", "name", 1), ("s", "BERG", "name", 2), ("s", "Zoe Quist", "name", 0), ("t", "Ann Berg", "name", 0), *first]
    two = scope.allocate(made(more), one, spark.createDataFrame([("s", "[Person7]"), ("t", "no token")], "scope string, token string")).checkpoint()
    assert vault(two) == vault(one) | {("s", "A. Berg"): "[PERSON1b]", ("s", "BERG"): "[Person1c]", ("s", "Zoe Quist"): "[PERSON8]", ("t", "Ann Berg"): "[PERSON1]"}
    assert vault(scope.allocate(made(more), two)) == vault(two)
    assert vault(scope.allocate(made([]), two)) == vault(two) and scope.allocate(made([])).count() == 0


def test_more_spellings_than_letters(spark):
    rows = [("s", f"{chr(97 + i // 26)}{chr(97 + i % 26)} Morvan", "name", i) for i in range(60)]
    got = {x.value: x.token for x in scope.allocate(spark.createDataFrame(rows, KIND)).collect()}
    ordered = [got[v] for _, v, *_ in rows]
    assert len(set(ordered)) == 60 and ordered[0] == "[PERSON1]" and ordered[1] == "[PERSON1b]" and ordered[25] == "[PERSON1z]" and ordered[26] == "[PERSON2]"
