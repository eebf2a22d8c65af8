"""What several operators of this subpackage share: words, shared tables, row ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java (and RE2) character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session of this machine alone gets a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver ends."""
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, is made once and outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for an empty or null text."""
    trimmed = F.call_function("btrim", whole(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.expr("array()").cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def key_text(doc_id: Column) -> Column:
    """doc_id as text; null counts as empty."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id's text modulo folds. A null id hashes as the empty text, whose crc32 is 0."""
    return F.crc32(key_text(doc_id).cast("binary")) % folds


def held_out(doc_id: Column, folds: int) -> Column:
    """True in fold 0, a null id's too."""
    return fold(doc_id, folds) == 0


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its exact name, or nulls of the kind where df has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: Keys that more than one in so many rows have are hot; there are fewer of them than this.
HOT = 2048


def attached(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, hot: int = HOT) -> DataFrame:
    """rows joined with a table of one row a key, whose column n says how many of the rows, total in all, have that key.

    Keys of more than total / hot rows are fewer than hot and are broadcast; no other key gives a task more than that share. The table and the rows
    are read twice, so both should be written. A null key meets nothing.
    """
    often = F.col(n) * hot > total
    few = F.broadcast(table.filter(often))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.filter(~often), key))
