"""Near-duplicate documents by bottom-k sketches, inverted lists, a union-sketch estimate and exact Jaccard.

1. A text's set of five-word shingles is hashed once; texts with equal sets
   are one class. A class keeps its k smallest hashes, its sketch.
2. Sketch values are listed with the classes that hold them. Two sets of a
   Jaccard similarity of 0.75 share at least SHARED of the values of their
   sketches but for about one pair in a million, so they meet in the list of one
   of the rarer values of either; commoner values need no list. This leaves out
   passages that many different texts share.
3. A list of at most LIST classes gives its pairs; pairs whose union sketch
   has too few shared values go. A longer list, whose pairs would grow with its
   square, gives each class's link to its first class instead.
4. The classes that such links connect are candidates of each other. They are
   dealt into blocks of at most about BLOCK texts of similar size; for each
   two blocks of one such group all exact similarities come from one
   product of 0/1 matrices, and only a spanning forest of the true links is kept.
5. Components of the links, by minimum labels along edges and halving of paths.

Step 4 copies each text of a large group to a block for each part of its own
and the neighbouring bands: of m candidates in one band about m * m / (BLOCK / 2)
rows with their texts are shuffled. Rows and arithmetic (half a microsecond a
pair of short texts) both grow with the square of such groups.

Defined cases: a null or empty text, or one of blanks, has an empty set and is
linked with nothing. A null doc_id takes part but names no component, unless
all of a component are null (then component_id is null); it is kept if its component has no id.
Repeated rows share one class and one answer. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written
from .text_arrays import shingles, slices, texts, words

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, SIMILAR = 5, (75, 100)
#: Values kept of a set, and those that two linked sets share at least (each of the K is shared with a chance of 0.75 or more: below 12 once in a million).
K, SHARED = 32, 12
LIST, BLOCK, BLOCK_BYTES = 40, 256, 16 << 20
#: Columns of a 0/1 matrix at a time.
COLUMNS = 16384
#: Texts of a group up to which pairs are compared one by one.
FEW = 16


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = texts(batch.column(batch.schema.get_field_index("text")))
    values, first = shingles(words(data, offsets), SHINGLE)
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _class(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, n_bytes, class and sketch of each text, and its number if it has one. An empty set has no class."""
    for batch in slices(batches):
        sets = _sets(batch)
        _, offsets = texts(batch.column(1))
        sketch = [s[:K].view(np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(map(_class, sets), pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32()), pa.array(np.concatenate(sketch), pa.int64())),
                *batch.columns[2:],
            ],
            names=["doc_id", "n_shingles", "n_bytes", "class", "sketch", *batch.schema.names[2:]],
        )


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class and text of each text."""
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(map(_class, _sets(batch)), pa.binary()), batch.column(1)], names=["class", "text"])


def needed(n: F.Column) -> F.Column:
    """How many sketch values a set of n shares at least with any set like it: of a set kept whole, its share of a union."""
    return F.when(n <= K, F.greatest(F.ceil(n * SIMILAR[0] / SIMILAR[1]), F.lit(1))).otherwise(F.lit(SHARED)).cast("int")


def needed_of_pair(n: F.Column, m: F.Column) -> F.Column:
    return F.least(needed(n), needed(m), F.lit(SHARED))


def _alike(n: str, m: str) -> F.Column:
    """Whether sizes allow the similarity."""
    return (F.col(n) * SIMILAR[1] >= F.col(m) * SIMILAR[0]) & (F.col(m) * SIMILAR[1] >= F.col(n) * SIMILAR[0])


def candidates(classes: DataFrame) -> DataFrame:
    """Links a, b between classes (id, n, sketch) that may be alike, such that all that are alike are connected."""
    values = classes.select("id", "n", F.explode("sketch").alias("value"))
    listed = written(values.groupBy("value").count().filter("count > 1"), "listed")
    joined = values.join(listed, "value")
    # Rarest first; a value held once comes before all others and needs no list.
    kept = joined.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("_v"))
    alone = F.least(F.col("n"), F.lit(K)).cast("int") - F.size("_v")
    ahead = F.least(F.col("n"), F.lit(K)).cast("int") - F.least(needed(F.col("n")), F.lit(SHARED)) + 1 - alone
    lists = written(kept.filter(ahead > 0).select("id", "n", F.explode(F.slice("_v", F.lit(1), ahead)).alias("_v")).select("id", "n", F.col("_v.value").alias("value"), F.col("_v.count").alias("count")), "lists")
    short, long = lists.filter(F.col("count") <= LIST), lists.filter(F.col("count") > LIST)
    left, right = (short.select("value", F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = left.join(right, "value").filter((F.col("a") < F.col("b")) & _alike("n_a", "n_b")).select("a", "b").distinct()
    sketches = classes.select("id", "n", "sketch")
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a").join(sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    # Small sets are kept whole, so their shared values count as they are.
    estimated = both.filter(shared >= needed_of_pair(F.col("n_a"), F.col("n_b"))).select("a", "b")
    firsts = written(long.groupBy("value").agg(F.min("id").alias("b")), "firsts")
    return estimated.unionByName(long.join(firsts, "value").filter(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of the links a, b: the least node that it is connected with.

    Each round a node takes the least label of its neighbours and then its
    label's label. Rounds are written to the shared folder, so that none depends on an
    executor; they end when no label changes, after about the logarithm of the longest path.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "_near").alias("_l"), F.col("label").alias("_was"))
        up = labels.select(F.col("node").alias("_up"), F.col("label").alias("_over"))
        step = written(lower.join(up, F.col("_l") == F.col("_up"), "left").select("node", F.least("_l", "_over").alias("label"), "_was"), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> _was").isEmpty():
            return labels


class _Forest:
    """Links that join what wasn't joined before."""

    def __init__(self, names: list[int]):
        self.names, self.root, self.links = names, list(range(len(names))), []

    def top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def link(self, i: int, j: int) -> None:
        x, y = self.top(i), self.top(j)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((self.names[i], self.names[j]))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from products of 0/1 matrices."""
    n = np.array([len(s) for s in sets])
    values, at = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    # Only values that two texts share make a difference.
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, at = (np.cumsum(times > 1) - 1)[column[shared]], at[shared]
    order = np.argsort(column, kind="stable")
    column, at = column[order], at[order]
    common = np.zeros((len(n), len(n)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        one = np.zeros((len(n), int(column[b - 1]) - low + 1), np.float32)
        one[at[a:b], column[a:b] - low] = 1
        common += one @ one.T
    return common


def _forest(names: list[int], sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """True links among texts, or between those of two sides, that span what all of their true links connect."""
    out, n = _Forest(names), np.array([len(s) for s in sets])
    if len(names) <= FEW:
        for i in range(len(names)):
            for j in range(i):
                if out.top(i) != out.top(j) and SIMILAR[1] * min(n[i], n[j]) >= SIMILAR[0] * max(n[i], n[j]):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if SIMILAR[1] * common >= SIMILAR[0] * (n[i] + n[j] - common):
                        out.link(i, j)
        return out.links
    common = _common(sets)
    like = SIMILAR[1] * common >= SIMILAR[0] * (n[:, None] + n[None, :] - common)
    if sides.min() != sides.max():
        like &= sides[:, None] != sides[None, :]
    for i, j in zip(*np.nonzero(np.triu(like, 1)), strict=True):
        out.link(int(i), int(j))
    return out.links


def _verified(block: pd.DataFrame) -> pd.DataFrame:
    """The links of one block: of two parts of a large group, or of some whole small groups."""
    links: list[tuple[int, int]] = []
    block = block.drop_duplicates("id").sort_values("id")
    for _, rows in block.groupby("group"):
        if len(rows) > 1:
            sets = _sets(pa.RecordBatch.from_pandas(rows[["text"]], preserve_index=False))
            links += _forest(rows["id"].tolist(), rows["side"].to_numpy(), sets)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def verify(members: DataFrame) -> DataFrame:
    """True links a, b within the groups of members (id, group, n, n_bytes, text) that connect all that are linked.

    Groups up to a block's size are packed together; a larger one is dealt by
    size band and hash into parts, and each pair of parts of a band or of neighbouring bands is a block.
    """
    # Of sets that are alike the larger has at most 4/3 of the smaller one: they lie in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIMILAR[1] / SIMILAR[0])) + 1e-9).cast("int")
    facts = members.select("group", "n", "n_bytes", band.alias("band"))
    whole = facts.groupBy("group").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("mb"))
    small = (F.col("m") <= BLOCK) & (F.col("mb") <= BLOCK_BYTES)
    packed = whole.filter(small).agg(F.sum("m").alias("m"), F.sum("mb").alias("mb")).first()
    packs = int(max(1, (packed["m"] or 0) // BLOCK, (packed["mb"] or 0) // BLOCK_BYTES))
    bands = facts.join(written(whole.filter(~small).select("group"), "large"), "group").groupBy("group", "band").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("mb"))
    parts = written(bands.select("group", "band", F.greatest(F.ceil(F.col("m") / (BLOCK // 2)), F.ceil(F.col("mb") / BLOCK_BYTES)).cast("int").alias("parts")), "parts")
    near = {k: parts.select("group", (F.col("band") + by).alias("band"), F.col("parts").alias(k)) for k, by in (("over", -1), ("under", 1))}
    dealt = written(parts.join(near["over"], ["group", "band"], "left").join(near["under"], ["group", "band"], "left"), "dealt")

    def upto(n: str) -> F.Column:
        return F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def block(i: F.Column | int, step: int, j: F.Column | int, side: int, of: F.Column) -> F.Column:
        as_column = lambda x: F.lit(x) if isinstance(x, int) else x
        return F.struct(of.cast("int").alias("of"), as_column(i).cast("int").alias("i"), F.lit(step).alias("step"), as_column(j).cast("int").alias("j"), F.lit(side).alias("side"))

    own, at = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.col("band")
    blocks = F.concat(
        F.transform(upto("parts"), lambda j: F.when(own <= j, block(own, 0, j, 0, at)).otherwise(block(j, 0, own, 1, at))),
        F.transform(upto("over"), lambda j: block(own, 1, j, 0, at)),
        F.transform(upto("under"), lambda j: block(j, 1, own, 1, at - 1)),
    )
    split = members.withColumn("band", band).join(dealt, ["group", "band"], "left")
    pack = F.pmod(F.xxhash64("group"), F.lit(packs))
    one = F.array(block(0, -1, 0, 0, pack))
    rows = split.select("id", "group", "text", F.col("parts").isNull().alias("_s"), F.explode(F.when(F.col("parts").isNull(), one).otherwise(blocks)).alias("_b"))
    rows = rows.select("id", "group", "text", F.when(~F.col("_s"), F.col("group")).alias("_g"), "_b.*")
    return rows.groupBy("_g", "of", "i", "step", "j").applyInPandas(lambda x: _verified(x[["id", "group", "text", "side"]]), "a long, b long")


def _answered(docs: DataFrame, *number: str) -> DataFrame:
    """doc_id, n_shingles, class, component_id, component, number: a row for each document. component is a group's own number, as ids may repeat."""
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), *number)
    sketched = written(base.mapInArrow(_sketched, ", ".join(["doc_id long, n_shingles long, n_bytes long, class binary, sketch array<long>", *(f"`{n}` long" for n in number)])), "sketches")
    sets = sketched.filter("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("n_bytes").alias("n_bytes"), F.min("doc_id").alias("doc_id"))
    # The number of a class is any number of its own; once written it stays.
    classes = written(sets.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = components(candidates(classes.select("id", "n", "sketch")))
    members = written(groups.select(F.col("node").alias("id"), F.col("label").alias("group")).join(classes.drop("sketch"), "id"), "members")
    wanted = members.select(F.col("doc_id").alias("_d")).distinct()
    found = base.join(wanted, base["doc_id"].eqNullSafe(F.col("_d")), "left_semi").select("doc_id", "text").mapInArrow(_classed, "class binary, text string")
    links = written(verify(members.join(found, "class").select("id", "group", "n", "n_bytes", "text")), "links")
    linked = written(components(links).join(classes.select("id", "class", "doc_id"), F.col("node") == F.col("id")).select("label", "id", "class", "doc_id"), "linked")
    least = written(linked.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    named = linked.join(least, "label").select("class", "component_id", F.col("label").alias("component"))
    alone = classes.join(linked.select("id"), "id", "left_anti").select("class", F.col("doc_id").alias("component_id"), F.col("id").alias("component"))
    answer = written(named.unionByName(alone), "answer")
    return sketched.select("doc_id", "n_shingles", "class", *number).join(answer, "class", "left")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    rows = _answered(docs)
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def kept_rows(docs: DataFrame, number: str) -> DataFrame:
    """The numbers of the rows that stay of docs (doc_id, text, number): one of each group, that of the least doc_id and then the least number.

    Rows without shingles are no copies of each other, but of those that repeat an id one stays.
    """
    rows = _answered(docs, number)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", number)).alias("_k")
    groups = rows.filter("class is not null").groupBy("component").agg(first).select(f"_k.{number}")
    empty = rows.filter("class is null")
    return groups.unionByName(empty.filter("doc_id is not null").groupBy("doc_id").agg(F.min(number).alias(number)).select(number)).unionByName(empty.filter("doc_id is null").select(number))
