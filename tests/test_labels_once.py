from pyspark.sql import functions as F

from spanloom.operators import labels


def test_each_line_is_looked_up_once(spark):
    """Lines of a long text don't each read all its lines again."""
    block = ["Name", "E-Mail:", "Ciudad", "Ann", "a@b.co", "Rome", "bye"]
    df = spark.createDataFrame([(1, "\n".join(block * 600)), (2, None), (3, "")], "id long, text string")
    found = df.select("id", labels.blocks(F.col("text")).alias("b"))
    assert found._jdf.queryExecution().analyzed().toString().count("translate(") == 1
    got = {r.id: [tuple(x) for x in r.b] for r in found.collect()}
    assert got == {1: [("Name", "name", "Ann"), ("E-Mail", "email", "a@b.co"), ("Ciudad", "location", "Rome")] * 600, 2: [], 3: []}
