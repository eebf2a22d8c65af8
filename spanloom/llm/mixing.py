"""Mixing sources to target weights, with DataFrame functions only.

A document's place is a 60-bit hash of its id, source and text. Its source's
target says how often the whole source is repeated and how many words are to
be taken once more; the documents that give those are the ones whose hash lies
below a threshold. The threshold is found without sorting: words are summed by
source and hash bucket, the bucket in which the budget ends is the only one
that is split into finer buckets, and so on. As thresholds only rise with the
budget, a larger mix holds every smaller one.

Defined cases: a null text has no words and is taken with 0. A null source is
a source of its own, last in order. Rows that agree in id, source and text share
a hash and are taken alike. An empty table gives no rows. Where all texts are
empty, targets are 0. Columns other than those named are ignored unless
listed in ``carry``; a carried column may not have the name of a result column.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, column, key_text, whole, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The most times that a source may be taken.
MAX_REPEATS = 3
#: Bits of the hash, and of those that each round of refining reads.
HASH_BITS, ROUND_BITS = 60, 12


def size_of(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(f"{NOT_SPACE}+")).cast("long")


def place() -> Column:
    """The hash of a document as a number of HASH_BITS bits."""
    digest = F.md5(F.concat_ws("|", key_text(F.col("doc_id")), F.coalesce("source", F.lit("")), F.md5(whole(F.col("_text")))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their number from 0 in an order, as _i: sorted by ranges, counted by range, and numbered on from the ranges before."""
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_row", 33)
    # A number for each range that has rows.
    counts = ranged.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, offsets = 0, {}
    for r in counts:
        offsets[r["p"]] = before
        before += r["count"]
    table = F.from_json(F.lit(json.dumps(offsets)), "map<string,bigint>")
    return ranged.withColumn("_i", F.element_at(table, part.cast("string")) + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Each source's share of all words is by weight; what a share exceeds
    max_repeats times its source goes to the others by weight until none is
    above. That is one level for all. It is found in rounds, a row each: what the capped sources leave is shared anew, until no more are capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    capped = written(numbered(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(max_repeats)).alias("_cap")), "sources")
    all_words = capped.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    level, n_capped = (all_words["n"] or 0) / (all_words["w"] or 1.0), 0
    while True:
        over = F.col("_w") * level > F.col("_cap")
        row = capped.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_cap"))).alias("caps"), F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        if row["n"] == n_capped or not row["w"]:
            break
        level, n_capped = (all_words["n"] - row["caps"]) / row["w"], row["n"]
    return capped.select("source", "source_size", F.least(F.lit(float(level)) * F.col("_w"), F.col("_cap")).alias("target"))


def thresholds(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """_key, below: the hash below which a source's documents are taken once more.

    placed: _key, hash, size; budgets: _key, budget (words). Each round sums
    words by source and the next ROUND_BITS bits; only the documents of the bucket
    in which the budget ends are summed again, by finer bits. At the last
    bit the boundary hash is taken where that comes nearer to the budget.
    """
    state = budgets.select("_key", F.col("budget").alias("_left"), F.lit(0).cast("long").alias("_at"))
    done = budgets.select("_key", F.lit(0).cast("long").alias("below")).limit(0)
    for upto in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        rest = HASH_BITS - upto
        inside = placed.join(state, "_key").filter(F.shiftright("hash", rest + ROUND_BITS) == F.col("_at"))
        sums = inside.groupBy("_key", "_left", F.shiftright("hash", rest).alias("_at")).agg(F.sum("size").alias("_n"), (F.min("hash") == F.max("hash")).alias("_one"))
        run = Window.partitionBy("_key").orderBy("_at")
        ends = sums.withColumn("_to", F.sum("_n").over(run)).filter(F.col("_to") > F.col("_left"))
        first = ends.withColumn("_r", F.row_number().over(run)).filter("_r = 1")
        step = written(first.select("_key", (F.col("_left") - (F.col("_to") - F.col("_n"))).alias("_left"), "_at", "_n", "_one"), "threshold")
        # A bucket of one hash can't be split: it is taken if at least half of it fits.
        settled = step.filter("_one").select("_key", F.shiftleft(F.col("_at") + (2 * F.col("_left") >= F.col("_n")).cast("long"), rest).alias("below"))
        done = done.unionByName(settled)
        state = step.filter("not _one").select("_key", "_left", "_at")
        if state.isEmpty():
            break
    return done


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the carried columns; a row for each document.

    taken is size times the number of copies in the mix: 0 to max_repeats.
    """
    more = [c for c in carry if c not in ("doc_id", "source")]
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "source", "string").alias("source"), column(docs, "text", "string").alias("_text"), *[F.col(f"`{c}`") for c in more])
    # A key without nulls that joins may hash and split.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("_key")
    placed = written(base.select("doc_id", "source", key, place().alias("hash"), size_of(F.col("_text")).alias("size")), "placed")
    sizes = placed.groupBy("source", "_key").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes.select("source", "source_size"), weights, max_repeats), "targets").select(key, "source_size", "target")
    whole_times = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    budgets = goals.withColumn("_times", F.least(whole_times, F.lit(max_repeats))).withColumn("budget", F.when(F.col("_times") >= max_repeats, 0.0).otherwise(F.col("target") - F.col("_times") * F.col("source_size")))
    # Where a budget ends in no bucket, the whole source is within it (its words are 0).
    limits = written(budgets.join(thresholds(placed.select("_key", "hash", "size"), budgets.filter("budget > 0").select("_key", "budget")), "_key", "left"), "limits")
    rows = base.withColumn("_hash", place()).withColumn("size", size_of(F.col("_text"))).withColumn("_key", key) if more else placed.withColumnRenamed("hash", "_hash")
    copies = F.col("_times") + F.when(F.col("_hash") < F.col("below"), F.lit(1)).otherwise(F.lit(0))
    joined = rows.join(limits, "_key").withColumn("_copies", copies)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).cast("long").alias("taken"), *(["source"] if "source" in carry else []), *[F.col(f"`{c}`") for c in more])


#: The same mix by sorting: the running sum of each source in the order of the hash.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i FROM s
), l AS (
  SELECT o.source, o.source_size, o.w,
         ((SELECT sum(source_size) FROM o)::DOUBLE - coalesce((SELECT sum(3.0 * p.source_size) FROM o p WHERE p.i < o.i), 0)::DOUBLE)
         / ((SELECT sum(w) FROM o) - coalesce((SELECT sum(p.w) FROM o p WHERE p.i < o.i), 0)) AS level
  FROM o
), t AS (
  SELECT source, source_size,
         least(coalesce((SELECT max(level) FROM l k WHERE k.level * k.w <= 3.0 * k.source_size) * w, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target
  FROM l
), b AS (
  SELECT *, CASE WHEN times >= 3 THEN 0.0 ELSE target - times * source_size END AS budget
  FROM (SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3) AS times FROM t)
), g AS (
  SELECT d.source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d GROUP BY d.source, h
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.times + CASE WHEN b.budget > 0 AND (g.upto <= b.budget OR g.upto - g.n <= b.budget AND 2 * (b.budget - (g.upto - g.n)) >= g.n) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h
"""
