"""Tokens over a scope: one number for each entity of all of a scope's texts, resumed from a stored vault.

Spellings of a name that share a word of at least ``LINK`` letters are one entity: names are linked to the least name that has the word, and the links' connected components are
the entities. An entity's spellings get letters (``[PERSON1]``, ``[PERSON1b]``), its casings other casings of the token. Numbers follow the order of first
appearance. They are found without a window over a scope: distinct values are sorted by ranges, each range is counted, and a number is the
place in its range and the counts of the ranges before.

A value that the stored vault has keeps its token, whatever else comes; a further spelling of a stored entity takes the next letter of its smallest number. An
entity of more spellings than there are letters goes on under a new number.

Null and empty values, and those of no category, get no token. Scopes are strings. A null scope is a scope of its own. Repeated rows count once. An empty table gives the stored vault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key
from .memory import _checkpoints, clusters
from .rewrite import word

#: Categories whose spellings are one entity whatever case and separators, and whose tokens mirror the case.
CASED = ("name", "company", "location", "address", "health", "username")
#: Letters of a word that links names; spellings under one number: a token without a letter, then b to z.
LINK, SPELLINGS = 4, 26
TOKEN = r"^\[([A-Za-z_]+?)([0-9]+)([a-z]?)\]$"


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """rows with their place from 0 among those of equal keys, which aren't null, in an order."""
    _checkpoints(rows.sparkSession)
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)).checkpoint()
    counts = ranged.groupBy(*keys, "_part").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    # A row for each range that the keys reach into.
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "_part", (F.col("_from") - earlier).alias("_zero"))
    return ranged.join(starts, [*keys, "_part"]).select(*rows.columns, (F.col("_row") - F.col("_zero")).alias(into))


def case_form(value: Column) -> Column:
    """0: the token as it is, 1: all letters are small, 2: all are capitals."""
    letters = F.regexp_replace(value, r"[^\p{L}]", "")
    return F.when(letters == "", 0).when(value == F.lower(value), 1).when(value == F.upper(value), 2).otherwise(0)


def link_words(value: Column) -> Column:
    """The words by which spellings of a name are known to be one: particles and initials are too short."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"[\s._-]+"), F.lower), lambda w: w.rlike(rf"^\p{{L}}{{{LINK},}}$")))


def _entities(values: DataFrame) -> DataFrame:
    """values with word, key (what makes an entity without links) and id."""
    key = F.when(F.col("category").isin(*CASED), entity_key(F.col("value"))).otherwise(F.col("value"))
    named = values.withColumn("word", word(F.col("category"))).withColumn("key", key)
    return named.withColumn("id", F.xxhash64("scope", "word", "key"))


def _clustered(entities: DataFrame) -> DataFrame:
    """id, cluster of all entities that are linked with another."""
    carried = entities.filter("category = 'name'").select("scope", "id", F.explode(link_words(F.col("value"))).alias("_w")).distinct()
    hubs = carried.groupBy("scope", "_w").agg(F.min("id").alias("b"))
    links = carried.join(hubs, ["scope", "_w"]).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return clusters(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))), links)


def allocate(found: DataFrame, stored: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """scope, token, value, category: the stored vault, and a token for each other value of found (scope, value, category, first: what values are ordered by).

    written: tokens (scope, token) that the texts themselves hold; numbers begin after theirs.
    """
    _checkpoints(found.sparkSession)
    # Within, a scope isn't null.
    scoped = lambda df: df.withColumn("scope", F.coalesce(F.concat(F.lit("s"), F.col("scope").cast("string")), F.lit("null")))
    values = scoped(found).filter((F.col("value") != "") & F.col("category").isNotNull()).groupBy("scope", "category", "value").agg(F.min("first").alias("first"))
    told = (scoped(stored) if stored is not None else values.limit(0).withColumn("token", F.col("value"))).select("scope", "token", "value", "category").checkpoint()
    head, n, letter = (F.regexp_extract("token", TOKEN, i) for i in (1, 2, 3))
    n = n.try_cast("long")
    known = _entities(told).withColumn("n", n).withColumn("_k", F.when(letter == "", 0).otherwise(F.ascii(letter) - 97))
    fresh = _entities(values.join(told.select("scope", "category", "value"), ["scope", "category", "value"], "left_anti")).checkpoint()

    linked = _clustered(fresh.select("scope", "category", "value", "id").unionByName(known.select("scope", "category", "value", "id")))
    cluster = lambda df: df.join(linked, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    # Of a stored entity its smallest number, and the letters that are gone under it.
    of_known = cluster(known).groupBy("cluster").agg(F.min(F.struct("n", "scope", "word")).alias("_o")).select("cluster", "_o.n", "_o.scope", "_o.word")
    gone = known.groupBy("scope", "word", "n").agg((F.max("_k") + 1).alias("_gone"))
    resumed = of_known.join(gone, ["scope", "word", "n"]).select("cluster", F.col("n").alias("_n0"), "_gone").checkpoint()

    # A slot is a token's number and letter; casings of one spelling share it.
    formed = cluster(fresh).withColumn("form", F.when(F.col("category").isin(*CASED), case_form(F.col("value"))).otherwise(0))
    spelled = numbered_within(formed, ["scope", "word", "key", "form"], ["first", "value"], "_j").checkpoint()
    slots = spelled.groupBy("scope", "word", "cluster", "key", "_j").agg(F.min("first").alias("first"))
    at = F.col("_k") + F.coalesce("_gone", F.lit(0))
    lettered = numbered_within(slots, ["scope", "word", "cluster"], ["first", "key", "_j"], "_k").join(resumed, "cluster", "left")
    placed = lettered.withColumn("_run", F.floor(at / SPELLINGS)).withColumn("_letter", at % SPELLINGS).checkpoint()
    new = placed.filter((F.col("_run") > 0) | F.col("_n0").isNull()).groupBy("scope", "word", "cluster", "_run").agg(F.min("first").alias("first"))
    tokens = told.select("scope", "token") if written is None else told.select("scope", "token").unionByName(scoped(written).select("scope", "token"))
    highest = tokens.groupBy("scope", F.upper(head).alias("word")).agg(F.max(n).alias("_most"))
    numbers = numbered_within(new, ["scope", "word"], ["first", "cluster", "_run"], "_i").join(highest, ["scope", "word"], "left")
    numbers = numbers.select("scope", "word", "cluster", "_run", (F.col("_i") + 1 + F.coalesce("_most", F.lit(0))).alias("_new"))
    settled = placed.join(numbers, ["scope", "word", "cluster", "_run"], "left").select("scope", "word", "cluster", "key", "_j", F.coalesce("_new", "_n0").alias("_number"), "_letter").checkpoint()

    name = F.when(F.col("form") == 1, F.lower("word")).when(F.col("form") == 2, F.initcap("word")).otherwise(F.col("word"))
    suffix = F.when(F.col("_letter") == 0, "").otherwise(F.char(F.col("_letter") + 97))
    token = F.concat(F.lit("["), name, F.col("_number").cast("string"), suffix, F.lit("]"))
    given = spelled.join(settled, ["scope", "word", "cluster", "key", "_j"]).select("scope", token.alias("token"), "value", "category")
    return told.unionByName(given).withColumn("scope", F.when(F.col("scope") != "null", F.expr("substring(scope, 2)")))
