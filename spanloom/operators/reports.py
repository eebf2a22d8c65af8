"""Reports over messages, vaults, cards and logs: sums and joins by key, no unbounded list in a row.

Null keys are keys of their own where rows are grouped and match nothing where they are joined, unless said otherwise. Empty inputs give
no rows. Repeated rows count as often as they are there, but for what is told as distinct. Columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key
from .dictionary import scan


def message_breakdown(messages: DataFrame, vault: DataFrame) -> DataFrame:
    """category, messages, mentions: in how many of messages (conv_id, turn, text), and how often in all, distinct originals of their own conversation's vault (conv_id, value, category) stand."""
    originals = vault.filter(F.length("value") > 0).select("conv_id", "value", "category").distinct()
    # One pass of the messages for all originals of all conversations, then an equality join with each conversation's own.
    held = scan(messages, originals, "conv_id", "turn", edges=False, once=True).select("conv_id", "turn", "value")
    hits = held.join(originals, ["conv_id", "value"])
    return hits.groupBy("category").agg(F.countDistinct("conv_id", "turn").alias("messages"), F.count("*").alias("mentions"))


def conversation_events(vault: DataFrame) -> DataFrame:
    """conv_id, total, kinds: distinct originals of each conversation (conv_id, value, category), and as JSON how many of each kind."""
    counts = vault.select("conv_id", "value", "category").distinct().groupBy("conv_id", "category").agg(F.count("*").alias("n"))
    # A conversation has as many rows here as there are kinds.
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ",")
    return counts.groupBy("conv_id").agg(F.sum("n").alias("total"), kinds.alias("kinds"))


def protected_entries(vault: DataFrame) -> DataFrame:
    """category, entries: distinct entities (category, value), spellings of one being one, without those that are a word of a longer entity of their category."""
    keyed = vault.select("category", "value", entity_key(F.col("value")).alias("_k")).filter("_k <> ''")
    once = keyed.groupBy("category", "_k").agg(F.min("value").alias("value"))
    words = once.select("category", F.explode(F.split("value", r"\s+")).alias("_w"), "_k").filter(entity_key(F.col("_w")) != F.col("_k"))
    parts = words.select("category", entity_key(F.col("_w")).alias("_k")).distinct()
    return once.join(parts, ["category", "_k"], "left_anti").groupBy("category").agg(F.count("*").alias("entries"))


def audit_page(rows: DataFrame, size: int, page: int = 0) -> DataFrame:
    """A page of rows (conv_id, at, id) as they are told: conversations by their latest row, newest first, and within each the newest first.

    Only the pages up to the one asked for are sorted on; what is beyond is cut by the limit in each task.
    """
    latest = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max("at").alias("_latest"))
    placed = rows.join(latest, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "at", "id", "_latest")
    order = [F.desc("_latest"), F.col("conv_id"), F.desc("at"), F.col("id")]
    first = placed.orderBy(*order).limit(size * (page + 1))
    numbered = first.withColumn("nth", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.filter(F.col("nth") >= size * page).select("conv_id", "at", "id", "nth")


def usage_index(uses: DataFrame, skips: DataFrame) -> DataFrame:
    """card, conversations, last_used, skipped_since: from uses (card, conv_id, at) and skips (card, at); the latest skip is told only if it is later than the last use."""
    used = uses.groupBy("card").agg(F.countDistinct("conv_id").alias("conversations"), F.max("at").alias("last_used"))
    skipped = skips.groupBy("card").agg(F.max("at").alias("_s"))
    both = used.join(skipped, "card", "full")
    newer = F.col("last_used").isNull() | (F.col("_s") > F.col("last_used"))
    return both.select("card", F.coalesce("conversations", F.lit(0).cast("long")).alias("conversations"), "last_used", F.when(newer, F.col("_s")).alias("skipped_since"))


def first_active(members: DataFrame, groups: DataFrame) -> DataFrame:
    """user, group: of each member's (user, group) active groups (group, created, active) the one created first."""
    own = members.join(groups.filter("active"), "group")
    return own.groupBy("user").agg(F.min(F.struct("created", "group")).alias("_g")).select("user", F.col("_g.group").alias("group"))


def stale(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """Cards (id, model, text) whose embedding is missing from stored (id, model, text_hash) or was made of another text."""
    now = cards.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = (now["id"] == stored["id"]) & (now["model"] == stored["model"]) & (now["_h"] == stored["text_hash"])
    return now.join(stored, same, "left_anti").select("id", "model", F.col("_h").alias("text_hash"))


def grouped_rates(marked: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and f1 of rows (tp, fp, fn and the columns by) in all, and by each of the columns alone: one pass by grouping sets."""
    sets = [[], *[[c] for c in by]]
    found = marked.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping_id().alias("_g"))
    name, value = F.lit("all"), F.lit("")
    for i, c in enumerate(by):
        own = F.shiftright(F.col("_g"), len(by) - 1 - i).bitwiseAND(1) == 0
        name, value = F.when(own, c).otherwise(name), F.when(own, F.col(c).cast("string")).otherwise(value)
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return found.select(name.alias("by"), value.alias("value"), "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def neighbours(links: DataFrame) -> DataFrame:
    """id, neighbour: both directions of links (a, b), each once."""
    return links.select(F.col("a").alias("id"), F.col("b").alias("neighbour")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("neighbour"))).filter("id <> neighbour").distinct()


def tiered_search(lexical: DataFrame, semantic: DataFrame, k: int = 4, least: float = 0.88) -> DataFrame:
    """id, tier, score, nth: the best k of lexical hits (id, score), then of semantic ones (id, cosine) of at least that cosine which no word has found."""
    first = lexical.filter("score > 0").select("id", F.lit(0).alias("tier"), F.col("score").cast("double").alias("score"))
    then = semantic.filter(F.col("cosine") >= least).join(first.select("id"), "id", "left_anti").select("id", F.lit(1).alias("tier"), F.col("cosine").alias("score"))
    order = [F.col("tier"), F.desc("score"), F.col("id")]
    best = first.unionByName(then).orderBy(*order).limit(k)
    return best.withColumn("nth", F.row_number().over(Window.orderBy(*order)))


def credit_period(now: Column, begin: Column, end: Column) -> Column:
    """struct<period_start, period_end>: the subscription's period where now lies in it, else the calendar month of now (UTC)."""
    inside = (begin <= now) & (now < end)
    month = F.date_trunc("MONTH", now)
    own = F.coalesce(inside, F.lit(False))
    return F.struct(F.when(own, begin).otherwise(month).alias("period_start"), F.when(own, end).otherwise(F.add_months(month, 1).cast("timestamp")).alias("period_end"))


def epoch_seconds(v: Column) -> Column:
    """A time in seconds or milliseconds since 1970, as seconds."""
    return F.when(F.abs(v) >= 1_000_000_000_000, v / 1000).otherwise(v).cast("double")


def spaced_thousands(v: Column) -> Column:
    """An integer with a blank between groups of three digits."""
    return F.regexp_replace(v.cast("long").cast("string"), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ")
