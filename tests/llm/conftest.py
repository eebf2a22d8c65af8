import pytest

#: Nulls in any column, empty and blank texts, ties, repeated rows and a long text; other columns have names that operators use inside.
ODD = [
    (0, "a quick brown fox jumps over the lazy dog and runs away", "en", "web"),
    (1, "a quick brown fox jumps over the lazy dog and runs away", "en", "web"),
    (1, "a quick brown fox jumps over the lazy dog and runs away", "en", "web"),
    (2, None, "en", "web"),
    (3, "", None, None),
    (4, " \n\t ", "en", ""),
    (None, "text without an id", "en", "web"),
    (None, None, None, None),
    (5, "one", "en", "news"),
    (6, "Übergroße Größe — 🙂 emoji " * 3000, "de", "news"),
    (7, "A QUICK brown fox jumps over the lazy dog and runs away", "en", None),
]
CLASHING = ["size", "class", "score", "_t", "value", "key", "row", "kept", "taken", "hash", "count", "id", "label", "n"]


@pytest.fixture(scope="session")
def odd(spark):
    names = ["doc_id", "text", "lang", "source", *CLASHING]
    kinds = ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"`{c}` string" for c in CLASHING)])
    return spark.createDataFrame([(*r, *["x"] * (len(names) - 4)) for r in ODD], kinds)
