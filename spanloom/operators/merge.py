"""Merging records of several devices: latest wins, tombstones, vaults and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key by order. A maximum of structs: summed before the shuffle, and no sort of a key's rows."""
    rest = [c for c in records.columns if c not in keys and c not in order]
    best = records.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def without_tombstones(records: DataFrame, tombstones: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Records that are strictly later than their key's last tombstone."""
    last = tombstones.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_dead"))
    out = records.join(last, keys, "left")
    return out.filter(F.col("_dead").isNull() | (F.struct(*order) > F.col("_dead"))).drop("_dead")


def merged_vaults(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """scope, placeholder, value, first_seen: a placeholder of both keeps mine's value and the earliest time."""
    both = mine.withColumn("_rank", F.lit(0)).unionByName(theirs.withColumn("_rank", F.lit(1)))
    return both.groupBy("scope", "placeholder").agg(F.min(F.struct("_rank", "value"))["value"].alias("value"), F.min("first_seen").alias("first_seen"))


def merged_policy(organisation: Column, connector: Column) -> Column:
    """Two lists of categories as one, in order, each once."""
    return F.array_union(F.coalesce(organisation, F.array().cast("array<string>")), F.coalesce(connector, F.array().cast("array<string>")))


def loosens(was: Column, now: Column) -> Column:
    """Whether a policy masks less than before; where either is unknown it counts as looser."""
    return F.coalesce(F.size(F.array_except(was, now)) > 0, F.lit(True))
