"""Chat formatting by perspective rotation, with DataFrame functions.

Each participant of a dialogue is the assistant once: its turns are marked as
the assistant's and are what the mask covers; all others are users with their names. Turns of
``STAYING`` roles are instructions, not participants, and keep their role in every perspective.

A dialogue longer than PIECE turns is rendered in pieces of that many turns, so no task or row holds an unbounded
dialogue. ``whole`` gives each participant every piece, with an empty mask where it is silent: its pieces in order, one
after the other, are the whole dialogue, system turns at their own places. ``rotate`` gives it those in which it speaks.
Turns get their places by a range partitioning over (conversation, turn, role, text), counts of each
range and a running sum of these counts, so that one huge dialogue is spread over tasks too.

The text of a turn has ``<|`` written as ``<||``, so it can't hold a marker; ``unescape`` undoes that.
The mask is an array of start and end in code points, in the piece's text: the assistant's
words with their end marker.

Defined cases: a null text is empty. A null role is a participant named ``unknown``; so is an empty one. A null turn
comes after all others; equal turns are ordered by role and text. A null conversation id is an id of its own.
Repeated rows are turns each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

PIECE = 64
STAYING = ("system",)
START, STOP, UNKNOWN = "<|im_start|>", "<|im_end|>", "unknown"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def placed(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, place (from 0 in its dialogue), piece, pieces (of its dialogue), role, text."""
    role = F.trim(F.regexp_replace(F.coalesce(column(turns, "role", "string"), F.lit("")), r"\s+", " "))
    base = turns.select(column(turns, "conv_id", "long").alias("conv_id"), column(turns, "turn", "long").alias("turn"), F.when(role == "", UNKNOWN).otherwise(role).alias("role"), F.coalesce(column(turns, "text", "string"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    ordered = base.repartitionByRange(*order).sortWithinPartitions(*order)
    # In a sorted partition this number rises by one a row; its high bits are the partition's.
    rows = written(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "turns")
    counts = rows.groupBy("conv_id", "_part").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    # A row for each partition that a dialogue reaches into.
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = F.ceil(F.sum("_n").over(Window.partitionBy("conv_id")) / piece)
    starts = written(counts.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), "_from", earlier.alias("_earlier"), pieces.alias("pieces")), "starts")
    joined = rows.join(starts, rows["conv_id"].eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    place = F.col("_row") - F.col("_from") + F.col("_earlier")
    return joined.select("conv_id", place.alias("place"), F.floor(place / piece).alias("piece"), "pieces", "role", "text")


def _segment(turn: Column, speaker: Column) -> Column:
    own = turn["role"] == speaker
    stays = turn["role"].isin(*STAYING)
    role = F.when(own, "assistant").when(stays, turn["role"]).otherwise(F.concat(F.lit("user name="), escape(turn["role"])))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    return F.struct(head.alias("head"), F.concat(escape(turn["text"]), F.lit(STOP)).alias("body"), own.alias("own"))


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("_turns"))


def _spoken(pieces: DataFrame) -> DataFrame:
    """Each piece once for each participant that speaks in it."""
    speakers = F.array_distinct(F.transform("_turns", lambda x: x["role"]))
    return pieces.select("conv_id", "piece", "_turns", F.explode(F.filter(speakers, lambda x: ~x.isin(*STAYING))).alias("perspective"))


def rotate(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, perspective, n_turns, text, mask: each piece of a dialogue once for each participant that speaks in it."""
    return _rendered(_spoken(_pieces(placed(turns, piece))))


def whole(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """As rotate, but each piece of a dialogue once for each participant of the dialogue."""
    rows = written(placed(turns, piece), "placed")
    long = rows.filter("pieces > 1")
    participants = long.filter(~F.col("role").isin(*STAYING)).groupBy("conv_id", "role").agg(F.max("pieces").alias("_last"))
    # A key for each piece, so that one huge dialogue is spread over tasks.
    views = participants.select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last") - 1)).alias("_p"))
    pieces = _pieces(long)
    silent_too = pieces.join(views, pieces["conv_id"].eqNullSafe(F.col("_c")) & (pieces["piece"] == F.col("_p"))).select("conv_id", "piece", "_turns", "perspective")
    return _rendered(_spoken(_pieces(rows.filter("pieces = 1"))).unionByName(silent_too))


def _rendered(views: DataFrame) -> DataFrame:
    rendered = views.select("conv_id", "piece", "perspective", F.transform("_turns", lambda x: _segment(x, F.col("perspective"))).alias("_s"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        spans = F.when(s["own"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return rendered.select(
        "conv_id",
        "piece",
        "perspective",
        F.size("_s").cast("long").alias("n_turns"),
        F.array_join(F.transform("_s", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("_s", zero, step, lambda s: s["spans"]).alias("mask"),
    )


#: The same over whole dialogues ordered by a window: every participant with every piece. Masks are written as start-end, comma-separated, an empty one as the empty text.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place
  FROM (SELECT conv_id, turn, text, CASE WHEN coalesce(trim(role), '') = '' THEN '{UNKNOWN}' ELSE trim(role) END AS role FROM conversations)
), p AS (SELECT *, place // {PIECE} AS piece FROM t),
v AS (SELECT a.conv_id, b.piece, a.perspective FROM (SELECT DISTINCT conv_id, role AS perspective FROM p WHERE role <> 'system') a JOIN (SELECT DISTINCT conv_id, piece FROM p) b ON a.conv_id IS NOT DISTINCT FROM b.conv_id),
s AS (
  SELECT v.conv_id, v.piece, v.perspective, p.place, p.role = v.perspective AS own,
         '{START}' || CASE WHEN p.role = v.perspective THEN 'assistant' WHEN p.role = 'system' THEN 'system' ELSE 'user name=' || replace(p.role, '<|', '<||') END || chr(10) AS head,
         replace(p.text, '<|', '<||') || '{STOP}' AS body
  FROM v JOIN p ON p.conv_id IS NOT DISTINCT FROM v.conv_id AND p.piece = v.piece
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, piece, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM s
)
SELECT conv_id, CAST(piece AS BIGINT) AS piece, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT) END, ',' ORDER BY place), '') AS mask
FROM o GROUP BY conv_id, piece, perspective
"""
