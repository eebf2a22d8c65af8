"""A training corpus from documents, in five stages: each reads what the one before has written.

quality classifier and quality rules drop what they reject, near-dedup keeps
one document of each group, mixing takes documents as often as the sources'
targets say, and packing cuts the mix into windows. All but the last stage return the columns of documents.

Each stage carries a document's row as one struct, so extra columns may have any names. Columns doc_id, text and source
that are missing or null are read as nulls. Rows may repeat, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from spanloom.llm.common import written


#: The whole row of a document as one column, so that operators carry it whatever its columns are called.
ROW = "_document"
NUMBER = "_number"


def _whole(docs: DataFrame, *needed: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    return docs.select(*[F.col(f"`{c}`") for c in needed if c in docs.columns], row)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of the documents that it is given.

    A null text is scored as an empty one; a null id has no label. Without labels of both kinds all documents share one score. Repeated rows are judged alike.
    """
    trees = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(_whole(docs, "doc_id", "text"), trees, carry=[ROW]).filter("predicted = 1").select(f"{ROW}.*")


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; repeated rows are judged alike."""
    return quality_rules.quality_rules(_whole(docs, "doc_id", "text"), carry=[ROW]).filter("kept").select(f"{ROW}.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id, then of the least number in the stage's input.

    Null, empty and blank texts are copies of nothing: with a null id all stay, of those that repeat an id one does. A null id comes after all others in its group.
    """
    rows = written(_whole(docs).withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")
    texts = rows.select(NUMBER, *[F.col(f"{ROW}.`{c}`").alias(c) for c in ("doc_id", "text") if c in docs.columns])
    return rows.join(near_dedup.kept_rows(texts, NUMBER), NUMBER, "left_semi").select(f"{ROW}.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    A document without words stays once. A null source is a source of its own. Rows that agree in id, source and text are taken alike.
    """
    taken = mixing.mix(_whole(docs, "doc_id", "source", "text"), carry=[ROW])
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    times = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return taken.select(ROW, F.explode(times).alias("_copy")).select(f"{ROW}.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is one end token; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("near-dedup", deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: No SQL: stages learn a model, estimate weights and tokenize. tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
