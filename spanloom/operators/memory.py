"""Search, duplicates and clusters among remembered entities and their embeddings."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalized

#: Queries searched in one pass over the rows: what a pass broadcasts is bounded by it.
QUERY_BLOCK = 4096
#: Queries and rows whose products are held at once.
TILE = 1024
#: Rows in a block of a key's vectors, about, and of a block whose products with another's are held at once; partitions of blocks, at most.
CELL, STRIP, MOST_PARTS = 4096, 256, 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, similarity, nth: the k rows of the greatest cosine for each query, itself left out.

    rows and queries have vec_id and embedding. Queries go in blocks of QUERY_BLOCK; each block meets every row once, and a
    partition passes on its own best k for each query.
    """
    blocks = queries.select(F.col("vec_id"), F.col("embedding"))
    n = blocks.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(parts):
        own = blocks.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toPandas()
        found = rows.select("vec_id", "embedding").mapInPandas(_best_of(own, k), "query_id long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")))
    return ranked.filter(F.col("nth") <= k)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best_of(queries: pd.DataFrame, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(queries):
            return
        q, ids = _unit(queries["embedding"]), queries["vec_id"].to_numpy()
        held: list[pd.DataFrame | None] = [None] * -(-len(ids) // TILE)
        # What a row must reach to be among a query's best k so far.
        floor = np.full(len(ids), -np.inf)
        for whole in batches:
            whole = whole[whole["embedding"].notna()]
            for begin in range(0, len(whole), TILE):
                batch = whole.iloc[begin : begin + TILE]
                others, rows = batch["vec_id"].to_numpy(), _unit(batch["embedding"]).T
                for b, first in enumerate(range(0, len(ids), TILE)):
                    part = slice(first, first + TILE)
                    s = np.round(q[part] @ rows, 6)
                    # A query and k others at least, and all that tie with the last of them.
                    edge = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if len(batch) > k + 1 else np.full(len(s), -np.inf)
                    at, near = np.nonzero(s >= np.maximum(edge, floor[part])[:, None])
                    if not len(at):
                        continue
                    found = pd.DataFrame({"_q": at, "query_id": ids[part][at], "vec_id": others[near], "similarity": s[at, near]})
                    found = found[found["query_id"] != found["vec_id"]]
                    if held[b] is not None:
                        found = pd.concat([held[b], found])
                    best = found.sort_values(["_q", "similarity", "vec_id"], ascending=[True, False, True])
                    nth = best.groupby("_q").cumcount()
                    last = best[nth == k - 1]
                    floor[first + last["_q"].to_numpy()] = last["similarity"].to_numpy()
                    held[b] = best[nth < k]
        for some in held:
            if some is not None:
                yield some.drop(columns="_q")

    return run


def similar_pairs(rows: DataFrame, least: float, key: str) -> DataFrame:
    """a, b, key, similarity of pairs within a key of at least that cosine, a before b.

    A key's rows go in blocks of CELL by their ids' hashes; two blocks meet in one cell, whose products are made STRIP rows at a time. So all pairs are
    computed, in tasks of bounded size, and a row is shuffled as often as its key has blocks. Rows without an id, a key or a length have no pairs, nor
    have vectors of different sizes.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField(key, kinds[key]), T.StructField("similarity", T.DoubleType())])
    return _cells(rows, key).mapInArrow(lambda x: _pairs_of(x, least, schema.names), schema)


def similar_links(rows: DataFrame, least: float, key: str) -> DataFrame:
    """a, b: enough of the links of similar_pairs to connect what they connect; a cell gives fewer than it has rows."""
    return _cells(rows, key).mapInArrow(lambda x: _links_of(x, least), "a long, b long")


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """_key, _dim, _lo, _hi, _second, _id, _e: the rows of both blocks of each cell (_lo, _hi) together, the second block's last."""
    base = rows.select(F.col(f"`{key}`").alias("_key"), F.size("embedding").alias("_dim"), F.col("vec_id").cast("long").alias("_id"), F.col("embedding").alias("_e"))
    base = base.filter(F.col("_key").isNotNull() & F.col("_id").isNotNull() & F.exists("_e", lambda x: x != 0) & F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x)))
    many = F.ceil(F.col("_n") / CELL)
    sizes = base.groupBy("_key", "_dim").agg(F.count("*").alias("_n")).select("_key", "_dim", many.alias("_blocks"))
    cells = sizes.agg(F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2)).first()[0] or 1
    # Groups of more than one block: at most one for each CELL rows.
    large = F.broadcast(sizes.filter("_blocks > 1"))
    held = base.join(large, ["_key", "_dim"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    held = held.withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = held.select("_key", "_dim", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), (F.col("_block") > F.col("_other")).alias("_second"), "_id", "_e")
    cell = ["_key", "_dim", "_lo", "_hi"]
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, min(int(cells), MOST_PARTS))
    return dealt.repartition(parts, *cell).sortWithinPartitions(*cell, "_second")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray, int, bool]]:
    """Of each cell its key, ids and unit vectors, how many of them are of the first block, and whether the cell is one block with itself."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined():
        t = pa.Table.from_batches(held)
        e = t["_e"].combine_chunks()
        v = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(e), -1)
        # Scaled first: squares of very large or small numbers would leave the range.
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        second = t["_second"].to_numpy()
        return t["_key"][0], t["_id"].to_numpy(), v, len(v) - int(second.sum()), t["_lo"][0] == t["_hi"][0]

    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        places = np.stack([code, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))])
        begins = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(begins, begins[1:], strict=False):
            part = batch.slice(a, b - a)
            cell = tuple(part.column(i)[0].as_py() for i in range(4))
            if held and cell != last:
                yield joined()
                held = []
            last = cell
            held.append(part)
    if held:
        yield joined()


def _strips(v: np.ndarray, n: int, alone: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs between a cell's two blocks and their cosines, STRIP rows of the first block at a time."""
    for at in range(0, n, STRIP):
        shift = at if alone else n
        s = v[at : min(at + STRIP, n)] @ v[shift:].T
        # What rounds to the bound is at the bound.
        i, j = np.nonzero(s >= least - 1e-6)
        close = np.round(s[i, j], 6)
        good = (close >= least) & (i < j) if alone else close >= least
        yield i[good] + at, j[good] + shift, close[good]


def _pairs_of(batches: Iterator[pa.RecordBatch], least: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    for key, ids, v, n, alone in _whole_cells(batches):
        for i, j, close in _strips(v, n, alone, least):
            x, y = ids[i], ids[j]
            apart = x != y
            x, y, close = x[apart], y[apart], close[apart]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.repeat(key, len(x)), pa.array(close)], names=names)


def _links_of(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for _, ids, v, n, alone in _whole_cells(batches):
        label = np.arange(len(ids))
        for i, j, _ in _strips(v, n, alone, least):
            label = _connected(label, i, j)
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        a, b = low[label], ids
        apart = a != b
        if apart.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], names=["a", "b"])


def _connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the place of one of its component, after links between places i and j."""
    while True:
        x, y = label[i], label[j]
        new = label.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        new = new[label]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def lexical(cards: DataFrame, words: list[str], k: int = 4) -> DataFrame:
    """id, score, at: cards (id, text, at) by how many of the words they contain, then the latest."""
    score = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(normalized(F.col("text")), w)))
    return cards.select("id", score.alias("score"), "at").filter("score > 0").orderBy(F.desc("score"), F.desc("at"), "id").limit(k)


def hybrid(files: DataFrame, k: int = 10) -> DataFrame:
    """id, rank_score, nth from (id, lexical, cosine): half and lexical where there is any, else half of the cosine scaled between the least and the greatest."""
    ends = files.agg(F.min("cosine").alias("_low"), F.max("cosine").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high > low, (F.col("cosine") - low) / (high - low)).otherwise(0.0)
    score = F.round(F.when(F.col("lexical") > 0, 0.5 + 0.5 * F.col("lexical")).otherwise(0.5 * scaled), 6)
    best = files.crossJoin(F.broadcast(ends)).select("id", score.alias("rank_score")).orderBy(F.desc("rank_score"), "id").limit(k)
    return best.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("rank_score"), "id")))


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's shared folder; only a session of this machine alone may do without one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spanloom-"))


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, cluster: the least id that a node (id) is connected with over links (a, b).

    Least labels of neighbours, then labels of labels, checkpointed each round, until no label changes: about the logarithm of the longest path.
    """
    _checkpoints(nodes.sparkSession)
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("id", F.col("id").alias("cluster")).distinct().checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("_near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("cluster").alias("_was"), F.least("cluster", "_near").alias("_low"))
        up = labels.select(F.col("id").alias("_up"), F.col("cluster").alias("_over"))
        step = lower.join(up, F.col("_low") == F.col("_up"), "left").select("id", "_was", F.least("_low", "_over").alias("cluster")).checkpoint()
        labels = step.select("id", "cluster")
        if step.filter("cluster <> _was").isEmpty():
            return labels


def budgeted(cards: DataFrame, scope: str, budget: int) -> DataFrame:
    """Cards (scope, id, score, size) taken greedily by score within a budget: one that is too large is skipped and the next is tried.

    Cards are dealt by ranges of (scope, score, id, size). Each scope's cards in its first range are read at once; where a scope reaches over
    several, these are read one after the other, and only what is used so far is carried. A range with no card that is small enough isn't read.
    """
    spark = cards.sparkSession
    _checkpoints(spark)
    base = cards.select(F.col(scope).alias("scope"), (-F.col("score")).alias("s"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    order = [F.col(c).asc_nulls_first() for c in ("scope", "s", "id", "size")]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = dealt.select("scope", "id", "size", "row", F.shiftright("row", 33).alias("part")).checkpoint()
    ends = rows.groupBy("part").agg(F.min_by(F.struct("scope"), "row").alias("first"), F.max_by(F.struct("scope"), "row").alias("last")).orderBy("part").collect()
    # Ranges that go on with the scope that the range before ends with; on the driver there is a row for each range.
    on = {p["part"]: before["part"] for before, p in zip(ends, ends[1:], strict=False) if before["last"] == p["first"]}
    kind = rows.schema["scope"].dataType

    def heads(of: list[tuple[int, int, int]]) -> DataFrame:
        first = {p["part"]: p["first"]["scope"] for p in ends}
        schema = T.StructType([T.StructField("p", T.LongType()), T.StructField("used", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("of", kind)])
        return F.broadcast(spark.createDataFrame([(p, used, nth, first[p]) for p, used, nth in of], schema))

    def read(some: DataFrame) -> DataFrame:
        ordered = some.select("scope", "part", "row", "id", "size", "used", "nth").repartition("scope", "part").sortWithinPartitions("scope", "part", "row")
        return ordered.mapInArrow(lambda x: _taken(x, budget), T.StructType([T.StructField("scope", kind), *(T.StructField(c, T.LongType()) for c in ("part", "id", "size", "nth"))])).checkpoint()

    match = F.col("scope").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p"))
    waiting = heads([(p, 0, 0) for p in on])
    least = {r["part"]: r["least"] for r in rows.join(waiting, match).groupBy("part").agg(F.min("size").alias("least")).collect()} if on else {}
    out = read(rows.join(waiting, match, "left_anti").withColumns({"used": F.lit(0).cast("long"), "nth": F.lit(0).cast("long")}))
    # Used and taken so far of the last scope of each range that another goes on with.
    lasts = {p["part"]: p["last"]["scope"] for p in ends if p["part"] in on.values() and not (p["part"] in on and p["first"] == p["last"])}
    tails = T.StructType([T.StructField("p", T.LongType()), T.StructField("of", kind)])
    state = {p: (0, 0) for p in lasts}
    if lasts:
        own = F.broadcast(spark.createDataFrame(list(lasts.items()), tails))
        state |= {r["part"]: (r["used"], r["n"]) for r in out.join(own, match).groupBy("part").agg(F.sum("size").alias("used"), F.count("*").alias("n")).collect()}
    goes_on = {before: p for p, before in on.items()}
    one = {p["part"] for p in ends if p["first"] == p["last"]}
    front = {goes_on[p]: held for p, held in state.items()}
    while front:
        # Past the ranges that hold nothing small enough.
        ready: dict[int, tuple[int, int]] = {}
        for p, held in front.items():
            at: int | None = p
            while at is not None and (least.get(at) is None or least[at] > budget - held[0]):
                at = goes_on.get(at) if at in one else None
            if at is not None:
                ready[at] = held
        if not ready:
            break
        more = read(rows.join(heads([(p, *held) for p, held in ready.items()]), match))
        ready |= {r["part"]: (ready[r["part"]][0] + r["used"], ready[r["part"]][1] + r["n"]) for r in more.groupBy("part").agg(F.sum("size").alias("used"), F.count("*").alias("n")).collect()}
        out = out.unionByName(more)
        front = {goes_on[p]: held for p, held in ready.items() if p in one and p in goes_on}
    total = out.groupBy(F.col("scope").alias("of")).agg(F.sum("size").alias("used"))
    return out.join(total, F.col("scope").eqNullSafe(F.col("of"))).select(F.col("scope").alias(scope), "used", F.col("nth").cast("int").alias("nth"), "id")


def _taken(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """scope, part, id, size and nth of the cards taken, of cards in order; used and nth tell where each scope's range begins."""
    held, used, nth = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        scope, part = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = scope.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
        there = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        size = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        rows, numbers = [], []
        for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            key = (batch.column(0)[int(a)].as_py(), int(part[a]))
            if key != held:
                held, used, nth = key, batch.column(5)[int(a)].as_py(), batch.column(6)[int(a)].as_py()
            fits = there[a:b] & (size[a:b] <= budget - used)
            # A size below nothing makes room for others.
            for i in np.flatnonzero(there[a:b] if (size[a:b] < 0).any() else fits) + a:
                if used + size[i] <= budget:
                    rows.append(i), numbers.append(nth)
                    used, nth = used + int(size[i]), nth + 1
        if rows:
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(3), kept.column(4), pa.array(numbers, pa.int64())], names=["scope", "part", "id", "size", "nth"])
