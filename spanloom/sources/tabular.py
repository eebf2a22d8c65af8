"""Delimited text: which delimiter, where the header is, and rows as annotated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t"]


def sniffed(text: Column, default: str = ",", lines: int = 20) -> Column:
    """The delimiter that most of the first lines agree on: the commonest number of columns must be over one, in at least two lines and 60 in 100."""
    first = F.slice(F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x) != ""), 1, lines)

    def rated(delimiter: str) -> Column:
        counts = F.transform(first, lambda x: F.size(F.split(F.regexp_replace(x, '"[^"]*"', ""), f"\\{delimiter}" if delimiter != "\t" else "\t", -1)))
        kinds = F.transform(F.array_distinct(counts), lambda c: F.struct(F.size(F.filter(counts, lambda x: x == c)).alias("n"), c.alias("columns")))
        best = F.array_max(kinds)
        enough = (best["columns"] > 1) & (best["n"] >= F.greatest(F.least(F.lit(2), F.size(counts)), F.ceil(F.size(counts) * 0.6)))
        return F.struct(F.when(enough, best["columns"]).otherwise(0).alias("columns"), F.lit(-DELIMITERS.index(delimiter)).alias("order"), F.lit(delimiter).alias("delimiter"))

    best = F.array_max(F.array(*map(rated, DELIMITERS)))
    return F.when(best["columns"] > 1, best["delimiter"]).otherwise(default)


def quoted_lines(text: Column) -> Column:
    """A text's lines; a line end within quotes doesn't end one. Every second part of a split at quotes is quoted."""
    parts = F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("\n"), F.lit("\x1e"))).otherwise(x))
    return F.split(F.array_join(parts, '"'), "\x1e", -1)


def cells(line: Column, delimiter: Column | str) -> Column:
    """A line's cells: quoted ones without their quotes, doubled quotes single. A quoted delimiter stays inside."""
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    # Quoted parts are kept whole by moving delimiters outside quotes to a control character: every second part of a split at quotes is quoted.
    parts = F.split(line, '"', -1)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.replace(x, d, F.lit("\x1f"))).otherwise(x)), '"')
    return F.transform(F.split(joined, "\x1f", -1), lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(c, '(?s)^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def annotated(headers: Column, row: Column) -> Column:
    """header: value | header: value; empty headers are named by their place, empty values are left out."""
    pairs = F.zip_with(headers, row, lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    named = F.transform(pairs, lambda p, i: F.when(F.coalesce(F.trim(p["v"]), F.lit("")) != "", F.concat(F.when(F.coalesce(F.trim(p["h"]), F.lit("")) == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(F.trim(p["h"])), F.lit(": "), p["v"])))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), " | ")


def annotate(df: DataFrame, *columns: str) -> Column:
    """The same of a table's columns."""
    return annotated(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))


def records(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, record: each file's lines under its header; lines before it are kept as they are.

    The header is the first line of the full width of which at least half of the cells are named. A line end within quotes stays in its cell.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    base = files.select(path, body.alias("_t"), sniffed(body).alias("_d"))
    grids = base.select(path, F.transform(F.filter(quoted_lines(F.col("_t")), lambda x: F.trim(x) != ""), lambda x: cells(x, F.col("_d"))).alias("_g"))
    wide = F.array_max(F.transform("_g", lambda r: F.size(r)))
    named = lambda r: 2 * F.size(F.filter(r, lambda c: F.trim(c) != "")) >= F.col("_w")
    at = F.array_position(F.transform("_g", lambda r: (F.size(r) == F.col("_w")) & named(r)), True).cast("int")
    found = grids.withColumn("_w", wide).withColumn("_h", F.greatest(at, F.lit(1)))
    rows = found.select(path, "_h", F.element_at("_g", F.col("_h")).alias("_head"), F.posexplode("_g").alias("line", "_r"))
    return rows.filter(F.col("line") + 1 != F.col("_h")).select(path, "line", F.when(F.col("line") + 1 < F.col("_h"), F.array_join("_r", " | ")).otherwise(annotated(F.col("_head"), F.col("_r"))).alias("record"))


def cut_row(lines: DataFrame, most: int, key: str, row: str = "row", text: str = "text") -> DataFrame:
    """key, cut: the first row whose line goes beyond a number of characters; null where all fit."""
    from pyspark.sql import Window

    run = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(row))
    return lines.select(key, row, run.alias("_run")).groupBy(key).agg(F.min(F.when(F.col("_run") > most, F.col(row))).alias("cut"))
