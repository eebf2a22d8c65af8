"""Exact dedup with a persistent index of digests, with DataFrame and SQL functions only.

Texts are equal when they are identical after each run of white space is replaced by one space (ends are not
trimmed). The index is a Parquet table of the SHA-256 digests of the texts that stay, in hash buckets that are sorted by digest, one
partition of files a batch. A batch is reduced to one row a digest (combined before the shuffle), the digests that the index
has are taken away by a sort-merge anti-join that shuffles the batch only, and what is left is appended. Adding a
batch again gives the same index: its files are replaced, and its rows are compared with the other batches' only.

Rows of a digest that more than one in ``HOT`` rows have meet its answer by a broadcast; there are fewer than ``HOT`` of these. All others
are joined by digest, so no task holds a larger share.

Defined cases: a null text is an empty one, and all empty texts are equal; a blank text is one space. Of equal texts in one batch
the row of the smallest id stays, a null id coming last; of rows that repeat an id exactly one stays. Between batches the
earlier one's stays, whatever its id. An empty table gives no rows and an index without digests. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, SPACE, attached, column, shared_path, whole, written

#: Digests in a bucket, at most, when an index is laid out: about 150 MB.
BUCKET_ROWS = 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE + "+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), row (a number of its own for each row), as a table: texts are read once and not shuffled."""
    found = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.unhex(F.sha2(normalised(column(docs, "text", "string")), 256)).alias("digest"))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def _firsts(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, n: one row a digest."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("_f")
    return rows.groupBy("digest").agg(first, F.count("*").alias("n")).select("digest", F.col("_f.doc_id").alias("keep_id"), F.col("_f.row").alias("keep_row"), "n")


class DigestIndex:
    """The digests of all texts that stay: digest, keep_id, keep_row, batch; at a path that the driver and all executors share.

    An index that exists there is opened with its own number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [m[1] for x in (system.listStatus(at) if system.exists(at) else []) if (m := re.fullmatch(r"buckets-(\d+)", x.getPath().getName()))]
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), int(found[0]) if found else buckets
        self.table = "digests_" + re.sub(r"\W", "_", self.path)[-100:]
        if self.buckets:
            self._open()

    def _open(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets-{self.buckets}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets-{self.buckets}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, found: DataFrame, batch: str) -> None:
        view = f"{self.table}_new"
        # One task a bucket, so that a batch is one file a bucket.
        found.repartition(self.buckets, "digest").sortWithinPartitions("digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{batch}') SELECT digest, keep_id, keep_row FROM {view}")
        self.spark.catalog.dropTempView(view)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the digests of rows (as digests() gives them) that no other batch of the index has."""
        if not re.fullmatch(r"\w+", batch):
            raise ValueError("a batch is named by letters, digits and underscores")
        if not self.buckets:
            shuffles = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = max(shuffles, rows.count() // BUCKET_ROWS + 1)
            self._open()
        known = self.rows().filter(F.col("batch") != batch).select("digest")
        # Groups are written first, so that they are dealt as the index is, however many shuffle partitions there are; what is left too, since a table can't be replaced while it is read.
        self._append(written(written(_firsts(rows).drop("n"), "firsts").join(known.hint("merge"), "digest", "left_anti"), "new-digests"), batch)

    def answers(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, row, digest, keep_id, group_size (rows of the digest), kept: a row for each of rows, all of whose digests the index has.

        With a batch, rows that equal a text of another batch are not kept, even if row numbers agree.
        """
        own = F.lit(True) if batch is None else F.col("batch") == batch
        found = written(_firsts(rows).select("digest", "n"), "sizes").join(self.rows().hint("merge"), "digest")
        table = written(found.select("digest", "keep_id", "keep_row", F.col("n").alias("group_size"), own.alias("_own")), "groups")
        joined = attached(rows, table, "digest", "group_size", rows.count(), HOT)
        return joined.select("doc_id", "row", "digest", "keep_id", "group_size", (F.col("_own") & (F.col("row") == F.col("keep_row"))).alias("kept"))

    def rebucketed(self, path: str, buckets: int) -> DigestIndex:
        """The same index at another path in another number of buckets, one file each for all batches' digests of a bucket."""
        out = DigestIndex(self.spark, path, buckets)
        for r in self.rows().select("batch").distinct().collect():  # a row a batch
            out._append(self.rows().filter(F.col("batch") == r["batch"]), r["batch"])
        return out


def new_texts(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """docs without those whose text the index or an earlier row has; the index is given the rest.

    Texts are only shuffled if those that go are too many to be broadcast. Of rows that agree in id and text one stays.
    """
    rows = digests(docs)
    index.add(rows, batch)
    judged = written(index.answers(rows, batch), "judged")
    digest = F.unhex(F.sha2(normalised(column(docs, "text", "string")), 256))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), digest.alias("_digest"), column(docs, "doc_id", "long").alias("_id"))

    def at(found: DataFrame, how: str) -> DataFrame:
        f = found.select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"))
        return keyed.join(f, (keyed["_digest"] == f["_d"]) & keyed["_id"].eqNullSafe(f["_i"]), how)

    keys = judged.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    once = at(keys.filter("rows > 1 or not kept"), "left_anti")
    again = at(keys.filter("rows > 1 and kept"), "left_semi").dropDuplicates(["_digest", "_id"])
    return once.unionByName(again).select("_doc.*")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each of docs, against a new index.

    Two batches, the lower half of the ids first: the second one meets an index that has digests, and the smallest id stays all the same.
    """
    rows = digests(docs)
    index = index or DigestIndex(docs.sparkSession, shared_path(docs.sparkSession, "digest-index"))
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    lower = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    index.add(rows.filter(lower), "lower")
    index.add(rows.filter(~lower), "upper")
    return index.answers(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
