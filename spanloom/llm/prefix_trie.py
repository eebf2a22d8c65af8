"""A trie of conversation prefixes: chained digests, prefixes grouped by depth and digest, sums over subtrees.

A prefix's digest is made from that of the prefix before and the next turn's. So that no task walks along one
huge conversation, the chain has levels: turns are chained within blocks of ``BLOCK``, the full blocks' digests are chained in
the same way, and a prefix's digest is that of the chain of blocks before with that of the chain in its block. Blocks begin at the same places in all
conversations, so equal prefixes have equal digests.

A node is met once for each of its members; counts are combined in each task before they are shuffled. For sums over
subtrees a node is exploded to its ancestors, of which its smallest member's chain tells the digests: to those in its own block, and what
the first nodes of a block have summed up goes to all of the block before. The first nodes of blocks are a trie themselves, so their sums are found
in the same way; a node is exploded to at most ``BLOCK`` ancestors a level, however deep it lies.

Conversations that end at a node are listed as text by ranges of ``SPAN`` ids, and a node's ranges pass one hasher in their order: it holds one range.

Defined cases: a null role or text is empty. Turns of one number are taken in the order of their digests; repeated rows are turns each. A null conv_id is
a conversation of its own with the empty text as its number: it comes after all others, is no smallest member beside another, and has no shared beginning. Without turns there is the
root alone if a conversation exists, and no row for an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, column, key_text, whole, written

#: Turns, or blocks of the level below, in a block.
BLOCK = 64
#: Ids in a range whose text is made in one place.
SPAN = 1024
#: Conversations of one hundred begin alike: a hash of the number modulo this one says with how many turns of the hundred's first one.
SHARED, HUNDRED = 6, 100
#: The digest of the empty prefix.
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes of a turn: its role's length tells where its text begins."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, n (code points of the text): texts are read once and not shuffled.

    Turns are sorted by ranges and numbered by range, so one huge conversation is spread over tasks.
    """
    role, text = whole(column(turns, "role", "string")), whole(column(turns, "text", "string"))
    base = turns.select(column(turns, "conv_id", "long").alias("conv_id"), column(turns, "turn", "long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("n"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    ordered = base.repartitionByRange(*order).sortWithinPartitions(*order)
    # In a sorted partition this number rises by one a row; its high bits are the partition's.
    rows = written(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "turns")
    counts = rows.groupBy("conv_id", "_part").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    # A row for each partition that a conversation reaches into.
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), (F.col("_from") - earlier).alias("_zero"))
    # Few rows of a partition share a conversation's start, except where one conversation fills it: the key has both.
    joined = rows.join(starts, rows["conv_id"].eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return written(joined.select("conv_id", (F.col("_row") - F.col("_zero")).alias("place"), "digest", "n"), "placed")


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, size (turns), shared (turns that it takes from the hundred's first one instead of its own), base."""
    shared = F.crc32(key_text(F.col("conv_id")).cast("binary")) % SHARED
    return rows.groupBy("conv_id").agg(F.count("*").alias("size")).select("conv_id", "size", shared.alias("shared"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length, and what led to it) and their turns (conv_id, pos from 0, digest, n, last), the shared beginnings in place."""
    found = written(conversations(rows), "conversations")
    bases = found.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    start = F.least(F.col("shared"), F.coalesce("base_size", F.lit(0)))
    length = (start + F.greatest(F.col("size") - F.col("shared"), F.lit(0))).alias("length")
    known = written(found.join(bases, "base", "left").select("conv_id", "size", "shared", "base", start.alias("start"), length), "lengths")
    # A key a block, so that the rows of one huge conversation meet their conversation in many tasks.
    blocks = known.select(F.col("conv_id").alias("_c"), "start", "length", "shared", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))).alias("_b"))
    own = rows.join(blocks, rows["conv_id"].eqNullSafe(F.col("_c")) & (F.floor(rows["place"] / BLOCK).cast("int") == F.col("_b"))).filter("place >= shared")
    own = own.select("conv_id", (F.col("start") + F.col("place") - F.col("shared")).alias("pos"), "digest", "n", "length")
    # At most HUNDRED conversations meet a turn of their first one.
    first = rows.filter(F.col("place") < SHARED).select(F.col("conv_id").alias("base"), F.col("place").alias("pos"), "digest", "n")
    begins = known.filter("start > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("start").cast("long") - 1)).alias("pos"))
    heads = begins.join(first, ["base", "pos"]).select("conv_id", "pos", "digest", "n", "length")
    turns = own.unionByName(heads)
    return known, turns.select("conv_id", "pos", "digest", "n", (F.col("pos") == F.col("length") - 1).alias("last"))


def _chain(items: Column) -> Column:
    """The digests of an array's prefixes, one after the other."""

    def step(state: Column, x: Column) -> Column:
        digest = F.unhex(F.sha2(F.concat(state["at"], x), 256))
        return F.struct(digest.alias("at"), F.array_append(state["out"], digest).alias("out"))

    zero = F.struct(F.lit(ROOT).alias("at"), F.array().cast("array<binary>").alias("out"))
    return F.aggregate(items, zero, step, lambda s: s["out"])


def chained(items: DataFrame, block: int) -> DataFrame:
    """Blocks (conv_id, b, keys, more) of items (conv_id, pos, digest, more): keys are the digests of the prefixes that end in the block, more what the items carry."""
    grouped = items.groupBy("conv_id", F.floor(F.col("pos") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "more"))).alias("_x"))
    blocks = written(grouped.select("conv_id", "b", _chain(F.transform("_x", lambda x: x["digest"])).alias("keys"), F.transform("_x", lambda x: x["more"]).alias("more")), "blocks")
    if blocks.filter("b > 0").isEmpty():
        return blocks
    full = blocks.filter(F.size("keys") == block).select("conv_id", F.col("b").alias("pos"), F.element_at("keys", -1).alias("digest"), F.lit(0).alias("more"))
    above = chained(full, block)
    heads = above.select("conv_id", F.posexplode("keys").alias("_i", "head"), F.col("b").alias("_b")).select(F.col("conv_id").alias("_c"), (F.col("_b") * block + F.col("_i") + 1).alias("_at"), "head")
    joined = blocks.join(heads, blocks["conv_id"].eqNullSafe(F.col("_c")) & (F.col("b") == F.col("_at")), "left")
    keys = F.when(F.col("b") == 0, F.col("keys")).otherwise(F.transform("keys", lambda k: F.unhex(F.sha2(F.concat("head", k), 256))))
    return written(joined.select("conv_id", "b", keys.alias("keys"), "more"), "blocks")


def subtree_sums(values: DataFrame, paths: DataFrame, block: int) -> DataFrame:
    """key and the sums of leaves and saved over each node's subtree.

    values: key, conv_id, pos (the place of the node in the chain of a member that all of one node's rows agree on), leaves, saved;
    paths: conv_id, b, keys of at least these members.
    """
    p = paths.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), "keys")
    sums = lambda f: f.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    def met(v: DataFrame, b: Column) -> DataFrame:
        return v.join(p, v["conv_id"].eqNullSafe(F.col("_c")) & (b == F.col("_b")))

    inside = met(values, F.floor(F.col("pos") / block)).select(F.explode(F.slice("keys", F.lit(1), (F.col("pos") % block + 1).cast("int"))).alias("key"), "leaves", "saved")
    own = sums(inside)
    if values.filter(F.col("pos") >= block).isEmpty():
        return own
    own = written(own, "sums")
    tops = values.filter(F.col("pos") % block == 0).select("key", "conv_id", (F.col("pos") / block).cast("long").alias("pos"))
    firsts = paths.select("conv_id", F.col("b").alias("pos"), F.col("keys")[0].alias("key"))
    upper = firsts.groupBy("conv_id", F.floor(F.col("pos") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("_x")).select("conv_id", "b", F.transform("_x", lambda x: x["key"]).alias("keys"))
    top_sums = subtree_sums(written(tops.join(own, "key"), "tops"), written(upper, "paths"), block)
    below = tops.filter("pos > 0").join(top_sums, "key").drop("key")
    passed = met(below, F.col("pos") - 1).select(F.explode("keys").alias("key"), "leaves", "saved")
    return sums(own.unionByName(passed))


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of rows sorted by key and range: one hasher at a time."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in rows:
        done = []
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["key", "ends_sha256"])
    if state is not None:
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, conv_id), a row for each conversation that ends at a node."""
    ranges = members.groupBy("key", F.floor(F.col("conv_id") / SPAN).alias("_r")).agg(F.array_sort(F.collect_list(F.coalesce("conv_id", F.lit((1 << 63) - 1)))).alias("_ids"))
    text = F.array_join(F.when(F.col("_r").isNull(), F.array(F.lit(""))).otherwise(F.transform("_ids", lambda x: x.cast("string"))), ",")
    ordered = ranges.select("key", F.coalesce("_r", F.lit((1 << 63) - 1)).alias("_r"), text.alias("ids")).repartition("key").sortWithinPartitions("key", "_r")
    return ordered.select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    known, items = rebuilt(placed(turns))
    paths = chained(items.select("conv_id", "pos", "digest", F.struct("n", "last").alias("more")), block)
    at = paths.select("conv_id", F.col("b"), F.posexplode(F.arrays_zip("keys", "more")).alias("_i", "x"), "keys")
    met = at.select("conv_id", (F.col("b") * block + F.col("_i")).alias("pos"), F.col("x.keys").alias("key"), F.when(F.col("_i") > 0, F.get("keys", F.col("_i") - 1)).alias("_before"), F.col("x.more.n").alias("n"), F.col("x.more.last").alias("last"))
    # The first of a block has its parent at the end of the block before.
    ended = paths.select(F.col("conv_id").alias("_c"), ((F.col("b") + 1) * block).alias("_at"), F.element_at("keys", -1).alias("_end")).filter(F.size("keys") == block)
    later = met.filter((F.col("pos") % block == 0) & (F.col("pos") > 0)).join(ended, met["conv_id"].eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_at"))).select("conv_id", "pos", "key", F.col("_end").alias("parent"), "n", "last")
    rest = met.filter((F.col("pos") % block != 0) | (F.col("pos") == 0)).select("conv_id", "pos", "key", F.coalesce("_before", F.lit(ROOT)).alias("parent"), "n", "last")
    prefixes = written(rest.unionByName(later), "prefixes")

    counted = prefixes.groupBy("pos", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n").alias("n"), F.first("parent").alias("parent"))
    nodes = written(counted, "nodes")
    children = written(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    judged = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = judged.select("key", "conv_id", "pos", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    own = written(own, "values")
    sums = written(subtree_sums(own, paths, block), "subtrees")

    # A conversation without turns ends at the root.
    turnless = known.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    hashes = written(ends(prefixes.filter("last").select("key", "conv_id").unionByName(turnless)), "ends")
    top = known.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    total = own.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    of_root = F.broadcast(children.filter(F.col("key") == F.lit(ROOT)).select("n_children"))
    # Tables of one row each.
    root = top.join(F.broadcast(total)).join(of_root, how="left").select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    smallest = root.select("key", "conv_id", "n_children").unionByName(nodes.join(children, "key").select("key", "conv_id", "n_children"))
    parents = written(smallest.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n")), "parents")
    named = attached(nodes, parents, "parent", "_n", nodes.count())
    summed = named.join(sums, "key").join(children, "key", "left")
    below = summed.select("key", "conv_id", (F.col("pos") + 1).alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return root.unionByName(below).join(hashes, "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: The same with whole prefixes as keys: each conversation's list of turns, cut at every depth, and each node held against its prefixes.
ORACLE_SQL = r"""
WITH bits AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS place,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n FROM conversations
), c AS (
  SELECT conv_id, size, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce([4294967295] || list_transform(range(length(s)), lambda i: ascii(s[i + 1])), lambda c, v: xor(c // 256, t[1 + xor(c % 256, v)]))) % 6 AS h
  FROM (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS s, count(*) AS size FROM o GROUP BY conv_id), bits
), r AS (
  SELECT c.conv_id, place, digest, n, 0 AS part FROM c JOIN o ON o.conv_id = c.base AND place < h
  UNION ALL SELECT c.conv_id, place, digest, n, 1 FROM c JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND place >= h
), l AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS ds, coalesce(list(n ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS ns
  FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, d, len(ds) AS size, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, sha256(array_to_string(ds[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(ds[1:d - 1], ',')) END AS parent
  FROM (SELECT *, CAST(unnest(range(len(ds) + 1)) AS INTEGER) AS d FROM l)
), g AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, any_value(parent) AS parent, coalesce(string_agg(coalesce(CAST(conv_id AS VARCHAR), ''), ',' ORDER BY conv_id NULLS LAST) FILTER (size = d), '') AS ids FROM p GROUP BY d, k
), k AS (SELECT g.*, coalesce(m, 0) AS n_children FROM g LEFT JOIN (SELECT d - 1 AS d, parent, count(*) AS m FROM g WHERE d > 0 GROUP BY 1, 2) x ON x.d = g.d AND x.parent = g.k),
s AS (
  SELECT p.d, p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * k.n) AS saved
  FROM k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.d <= k.d GROUP BY p.d, p.k
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.k = k.k LEFT JOIN k u ON u.d = k.d - 1 AND u.k = k.parent
"""
