"""Substitutes pass the check of the original's scheme."""

from pyspark.sql import functions as F

from spanloom.functions.drawing import seed
from spanloom.operators import checksummed, fakes
from spanloom.queries import _passes

SEEDS = 10_000


def test_specimens_and_substitutes_pass_their_check(spark):
    """Over 10,000 seeds, dealt to all schemes."""
    names = F.array(*[F.lit(s["name"]) for s in checksummed.SCHEMES])
    one = spark.range(SEEDS).repartition(8).select((F.col("id") % len(checksummed.SCHEMES)).cast("int").alias("n"), seed("k", "t", F.col("id").cast("string")).alias("s"))
    made = one.select(F.get(names, "n").alias("name"), "s", checksummed.specimen(F.col("s"), F.col("n")).alias("v"))
    out = made.withColumn("new", checksummed.substitute(F.col("v"), F.col("s"), name=F.col("name")))
    # Not a filter: pushed down, it would write the whole solver into each check.
    told = out.select("name", "v", "new", _passes(F.col("name"), F.col("v")).alias("was"), _passes(F.col("name"), F.col("new")).alias("ok")).collect()
    wrong = [(r.name, r.v, r.new) for r in told if not (r.was and r.ok and r.v != r.new and len(r.v) == len(r.new))]
    assert len(told) == SEEDS and wrong == []
    assert len(checksummed.NAMES) >= 40


def test_marks_and_case_stay(spark):
    values = ["529.982.247-25", "12.345.678-5", "12345678z", "732 829 320", "131052-308T", "x1234567L"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select("v", checksummed.substitute(F.col("v"), seed("k", "id", F.col("v"))).alias("new")).collect()
    shape = lambda x: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in x)
    for r in got:
        assert r.new != r.v and len(r.new) == len(r.v)
        # A check character may be a digit where the original has a letter.
        assert shape(r.new)[:-1] == shape(r.v)[:-1]


def test_what_passes_no_check(spark):
    rows = spark.createDataFrame([(None,), ("",), ("12345",), ("529.982.247-26",), ("text",)], "v string")
    got = [r.new for r in rows.select(checksummed.substitute(F.col("v"), seed("k", "id", F.col("v")), name=F.lit("cpf")).alias("new")).collect()]
    assert got == [None] * 5


def test_fakes_of_numbers_are_valid(spark):
    rows = spark.createDataFrame([("529.982.247-25", "national_id"), ("732 829 320", "company_id"), ("A-17/99", "national_id")], "v string, c string")
    got = rows.select("v", fakes.fake(F.col("v"), F.col("c"), "k").alias("new"), F.col("c")).collect()
    ok = spark.createDataFrame(got[:2]).select(F.when(F.col("c") == "company_id", _passes(F.lit("siren"), F.col("new"))).otherwise(_passes(F.lit("cpf"), F.col("new"))).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, True]
    assert got[2].new != "A-17/99" and got[2].new[1] == "-" and got[2].new[4] == "/"


def test_substitutes_depend_on_the_key_only(spark):
    rows = spark.createDataFrame([("529.982.247-25",)], "v string")
    new = lambda k: checksummed.substitute(F.col("v"), seed(k, "id", F.col("v")))
    r = rows.select(new("a").alias("a"), new("a").alias("again"), new("b").alias("b")).first()
    assert r.a == r.again != r.b
