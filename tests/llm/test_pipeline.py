"""The pipeline's stages against brute force over what each was given."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing

from .test_operators import brute_components
from .test_packing import tokens

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_filters_keep_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for before, after in ((steps[0], steps[1]), (steps[1], steps[2])):
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
    was, now = (d.join(labels, "doc_id").groupBy("quality").count().collect() for d in (steps[0], steps[2]))
    was, now = ({r["quality"]: r["count"] for r in x} for x in (was, now))
    assert now[1] >= 0.95 * was[1] and now.get(0, 0) <= 0.4 * was[0]


def test_one_of_each_group_stays(steps):
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in steps[2].collect()]).items() if i == c}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_mixing_repeats_by_target(steps):
    got = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    for r in mixing.mix(steps[3]).collect():
        assert got.get(r.doc_id, 0) == (r.taken // r.size if r.size else 1)


def test_packing_covers_the_mix(steps):
    docs = {r.doc_id: r.text for r in steps[4].collect()}
    times = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    rows = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.collect_list(F.struct("start", "length", "ids_crc32")).alias("p")).collect()
    ids = dict(zip(docs, tokens(list(docs.values())), strict=True))
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.n == times[r.doc_id] * len(ids[r.doc_id])
        for p in r.p:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][p.start : p.start + p.length], "<u4").tobytes())


def test_repeated_and_missing_ids_leave_one_of_each_group(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (None, a), (None, ""), (None, "c d e f g h"), (None, "c d e f g h"), (4, ""), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (2, b), (None, "c d e f g h"), (5, "")]
    for given, empties in ((docs, 1), (docs.unionByName(docs), 2)):
        got = [tuple(r) for r in corpus_pipeline.deduplicated(spark, given, DIR).collect()]
        # Of the two empty texts of id 4 either may be first.
        rest = [(i, t) for i, t in got if i != 4 and (i, t) != (None, "")]
        assert sorted(rest, key=str) == sorted(want, key=str)
        assert sum(i == 4 for i, _ in got) == 1 and got.count((None, "")) == empties


def test_run_gives_all_rows(spark, steps):
    # How a document is cut depends on the order of rows; what is told of all its pieces doesn't.
    total = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert total(corpus_pipeline.run(spark, DIR)) == total(steps[5])
