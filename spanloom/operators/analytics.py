"""Reports on usage, egress and redactions: groupings whose rows are summed before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def egress_groups(log: DataFrame) -> DataFrame:
    """origin, contacts, refused, last_at, sources, last_reason from (origin, source, verdict, reason, at)."""
    refused = F.col("verdict") == "refused"
    return log.groupBy("origin").agg(
        F.count("*").alias("contacts"),
        F.count_if(refused).alias("refused"),
        F.max("at").alias("last_at"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.max(F.when(refused, F.struct("at", "reason")))["reason"].alias("last_reason"),
    )


def egress_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("origins"), F.coalesce(F.sum("contacts"), F.lit(0)).alias("contacts"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"))


def daily(rows: DataFrame, at: str, series: str, days: int) -> DataFrame:
    """day, series, n for the last days up to the latest one, with zeros: a calendar of days times the series that occur.

    The calendar has days rows and a row for each series: both sides are small and keyed by a constant number of days.
    """
    counted = rows.groupBy(F.to_date(F.date_trunc("DAY", at)).alias("day"), F.col(series).alias("series")).agg(F.count("*").alias("n"))
    end = counted.agg(F.max("day").alias("_end"))
    spans = counted.select("series").distinct().join(end, F.lit(True))
    calendar = spans.select("series", F.explode(F.sequence(F.date_sub("_end", days - 1), F.col("_end"))).alias("day"))
    return calendar.join(counted, ["day", "series"], "left").select("day", "series", F.coalesce("n", F.lit(0)).alias("n"))


def top_series(rows: DataFrame, series: str, value: Column, keep: int = 5, other: str = "__other__") -> DataFrame:
    """series, total: the largest by name, the others as one."""
    totals = rows.groupBy(F.col(series).cast("string").alias("series")).agg(F.sum(value).alias("total"))
    best = totals.orderBy(F.desc("total"), F.asc("series")).limit(keep).select(F.col("series").alias("_best"))
    named = totals.join(F.broadcast(best), totals["series"].eqNullSafe(best["_best"]), "left")
    label = F.when(F.col("_best").isNotNull(), F.col("series")).otherwise(F.lit(other))
    return named.groupBy(label.alias("series")).agg(F.sum("total").alias("total"))


def cost_cents(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, cached: Column | None = None, written: Column | None = None, rate: float = 0.92) -> Column:
    """Cents of a call, rounded up: prices are per million tokens; what the cache gives costs a tenth, what it takes a quarter more."""
    total = tokens_in * price_in + tokens_out * price_out
    if cached is not None:
        total = total + cached * price_in * F.lit(0.1)
    if written is not None:
        total = total + written * price_in * F.lit(1.25)
    # Rounded first: a sum of exact cents must not go up by a rounding error.
    return F.ceil(F.round(total / 1_000_000 * rate * 100, 6)).cast("long")


def credit_balance(accounts: DataFrame, usage: DataFrame) -> DataFrame:
    """account, allotted, used, balance, blocked: accounts (account, seats, allotment, period_start, period_end), usage (account, credits, billable, at)."""
    inside = usage.withColumnRenamed("account", "_account").join(accounts, (F.col("_account") == F.col("account")) & (F.col("at") >= F.col("period_start")) & (F.col("at") < F.col("period_end")) & F.col("billable"))
    used = inside.groupBy("_account").agg(F.sum("credits").alias("used"))
    out = accounts.join(used, F.col("account") == F.col("_account"), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.select("account", (F.col("seats") * F.col("allotment")).alias("allotted"), "used", (F.col("seats") * F.col("allotment") - F.col("used")).alias("balance"), (F.col("used") >= F.col("seats") * F.col("allotment")).alias("blocked"))


def levels(counts: DataFrame, label: str, n: str, top: int = 8, height: int = 7) -> DataFrame:
    """label, n, level: the top labels with a level from 0 to height, relative to the largest."""
    best = counts.orderBy(F.desc(n), F.asc(label)).limit(top)
    return best.select(label, n, F.floor(F.col(n) / F.max(n).over(Window.partitionBy(F.lit(0))) * height + 0.5).cast("long").alias("level"))


def capped(rows: DataFrame, signature: Column, order: str, most: int = 5) -> DataFrame:
    """The first rows of each signature, by order."""
    ranked = rows.withColumn("signature", signature).withColumn("nth", F.row_number().over(Window.partitionBy("signature").orderBy(order)))
    return ranked.filter(F.col("nth") <= most)


def history_window(turns: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """conv_id, turn, cost, total of the latest turns within a budget of tokens; the last one always, and none before the first user turn."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    run = turns.withColumn("cost", tokens).withColumn("total", F.sum("cost").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(back))
    fits = run.filter((F.col("total") <= budget) | (F.col("_nth") == 1))
    first_user = F.min(F.when(F.col("role") != "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    led = fits.withColumn("_from", first_user).filter((F.col("turn") >= F.col("_from")) | (F.col("_nth") == 1))
    return led.select("conv_id", "turn", "role", "cost", "total")


def mask_plan(chars: Column) -> Column:
    """ok, long or refuse, by the number of characters."""
    return F.when(chars <= 80_000, "ok").when(chars <= 1_000_000, "long").otherwise("refuse")
