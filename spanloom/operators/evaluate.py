"""Scoring spans against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """key, start, end: overlapping and touching spans as one; islands by the running maximum of ends."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(key, "start", "end").withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(order)).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _cut(spans: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Spans cut at multiples of a width, with the number of each cut's stretch as _b: overlaps are found by an equal join on key and stretch."""
    stretches = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    cut = spans.filter("end > start").withColumn("_b", stretches)
    return cut.withColumn("_from", F.greatest("start", F.col("_b") * width)).withColumn("_to", F.least("end", (F.col("_b") + 1) * width))


def _overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows of a, cut, with _n: how many characters each shares with a cut of b in its stretch. b's spans don't overlap."""
    other = _cut(b.select(key, "start", "end"), key).select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.col("_from").alias("_s"), F.col("_to").alias("_e"))
    joined = _cut(a, key).join(other, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("_n", F.least("_to", "_e") - F.greatest("_from", "_s")).filter("_n > 0")


def character_f1(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of characters, pooled over all keys."""
    p, g = merged_intervals(predicted, key), merged_intervals(gold, key)
    size = F.sum(F.col("end") - F.col("start"))
    shared = _overlaps(p, g, key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("tp"))
    row = shared.join(p.agg(F.coalesce(size, F.lit(0)).alias("_p")), F.lit(True)).join(g.agg(F.coalesce(size, F.lit(0)).alias("_g")), F.lit(True))
    precision, recall = F.try_divide("tp", "_p"), F.try_divide("tp", "_g")
    return row.select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), F.col("_p") + F.col("_g")), 6).alias("f1"))


def mention_consistency(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """bucket, entities, complete: entities by how many mentions they have, and those of which every mention is covered."""
    asked = gold.select(key, "entity", "start", "end").distinct()
    shared = _overlaps(asked, merged_intervals(predicted, key), key).select(key, "entity", "start", "end", "_n")
    # Covered is a mention of which all characters are.
    each = asked.withColumn("_n", F.lit(0)).unionByName(shared).groupBy(key, "entity", "start", "end").agg(F.sum("_n").alias("_n"))
    mentions = each.select(key, "entity", (F.col("_n") == F.col("end") - F.col("start")).cast("int").alias("hit"))
    entities = mentions.groupBy(key, "entity").agg(F.count("*").alias("n"), F.min("hit").alias("all"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").otherwise("11+")
    return entities.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entities"), F.sum("all").alias("complete"))


def token_recall(truths: DataFrame, predicted: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """category, truths, found: truths (key, value, category) of whose words at least that share is in a predicted value of their document."""
    words = lambda v: F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = truths.select(key, "value", "category", F.explode(words(F.col("value"))).alias("word"))
    given = predicted.select(F.col(key).alias("_k"), F.explode(words(F.col("value"))).alias("_w")).distinct()
    hit = asked.join(given, (F.col(key) == F.col("_k")) & (F.col("word") == F.col("_w")), "left")
    each = hit.groupBy(key, "value", "category").agg(F.avg(F.col("_w").isNotNull().cast("double")).alias("share"))
    return each.groupBy("category").agg(F.count("*").alias("truths"), F.count_if(F.col("share") >= share).alias("found"))
