"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_formatting, exact_dedup, lm_scoring, media, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, spelling, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.with_gaps(warc.archived(_table(spark, sf_dir, "pages")))
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), F.col("content_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), "gap_bytes")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "posterior")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return chat_formatting.whole(_table(spark, sf_dir, "conversations")).withColumn("mask", mask)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(_table(spark, sf_dir, "documents")))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_near_dedup, op4_lm_scoring, op5_warc, op6_url_filters, op7_quality_rules, op8_packing, op9_chat_formatting, op10_media, op11_exact_dedup, op12_prefix_trie, op13_spelling)}
ORACLES = {
    "op1_mixing": mixing.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op6_url_filters": url_filters.ORACLE_SQL, "op9_chat_formatting": chat_formatting.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL,
}
