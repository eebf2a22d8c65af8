"""Every operator and stage on nulls, empty, blank, repeated and long texts, clashing names and empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import chat_formatting, lm_scoring, media, mixing, near_dedup, packing, quality_classifier, quality_rules, url_filters, warc


def trees(docs):
    return quality_classifier.train(docs, docs.select("doc_id", F.lit(1).alias("quality")))


BY_ROW = {
    "mixing": mixing.mix,
    "classifier": lambda d: quality_classifier.classify(d, trees(d)),
    "near-dedup": near_dedup.near_dedup,
    "lm": lm_scoring.lm_score,
    "rules": quality_rules.quality_rules,
    "media": lambda d: media.features(media.store(d)),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_for_each_document(name, odd):
    got = BY_ROW[name](odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert BY_ROW[name](odd.filter("false")).count() == 0


def test_packing_reads_all(odd):
    got = packing.pack(odd).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    assert packing.pack(odd.filter("false")).count() == 0


def test_repeated_rows_agree(odd):
    got = mixing.mix(odd).filter("doc_id = 1").collect()
    assert len(got) == 2 and got[0] == got[1]
    scores = {r.score for r in lm_scoring.lm_score(odd).filter("doc_id in (0, 1, 7)").collect()}
    assert len(scores) == 1


def test_near_dedup_of_odd_documents(odd):
    by = {}
    for r in near_dedup.near_dedup(odd).collect():
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[0] == [(8, 0, True)] and by[1] == [(8, 0, False)] * 2 and by[7] == [(8, 0, False)]
    assert by[2] == by[3] == [(0, 2, True)] or (by[2], by[3], by[4]) == ([(0, 2, True)], [(0, 3, True)], [(0, 4, True)])
    assert by[5] == [(1, 5, True)] and sorted(by[None]) == [(0, None, True), (1, None, True)]


def test_pages(spark):
    rows = [(1, "http://example.com/en/a", "<p>x</p>", "q"), (1, "http://example.com/en/a", "<p>x</p>", "q"), (2, None, None, "q"), (None, "no scheme", "<p>x</p>", "q"), (3, "HTTP://WWW.Example.COM/en/?q#f", "", "q"), (4, "http://x.net", "é" * 70_000, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    judged = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()), key=str)
    assert judged == sorted(
        [
            ("1", "example.com", "/en/a", "example.com/en/", "block"),
            ("1", "example.com", "/en/a", "example.com/en/", "block"),
            ("2", "", "", None, "allow"),
            ("None", "", "", None, "allow"),
            ("3", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("4", "x.net", "", None, "allow"),
        ],
        key=str,
    )
    assert url_filters.judge(pages.filter("false")).count() == 0
    assert url_filters.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).filter("verdict = 'allow' and rule is null").count() == 6
    found = warc.archived(pages).collect()
    assert all(r.kind == "record" for r in found) and len(found) == 6
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in found)
    assert kinds.count(("<urn:page:1>", "response", None)) == 2
    assert ("<urn:page:>", "revisit", "<urn:page:1>") in kinds and ("<urn:page:3>", "revisit", "<urn:page:2>") in kinds
    assert warc.archived(pages.filter("false")).count() == 0


def test_dialogues(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "Ann Lee", None), (1, 1, "Ann Lee", None), (1, None, None, "late"), (None, 2, "system", "only"), (2, 0, "a", "x"), (2, 1, "b", "y"), (2, 2, "a", "z")]
    got = chat_formatting.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=2).collect()
    assert {(r.conv_id, r.piece, r.perspective) for r in got} == {(1, 0, "user"), (1, 0, "Ann Lee"), (1, 1, "Ann Lee"), (1, 1, "unknown"), (2, 0, "a"), (2, 0, "b"), (2, 1, "a")}
    first = next(r for r in got if (r.conv_id, r.piece, r.perspective) == (1, 0, "user"))
    assert first.text == "<|im_start|>assistant\nhi <||im_end|><|im_end|>\n<|im_start|>user name=Ann Lee\n<|im_end|>\n"
    assert [first.text[m.start : m.end] for m in first.mask] == ["hi <||im_end|><|im_end|>"]
    assert spark.range(1).select(chat_formatting.unescape(chat_formatting.escape(F.lit("<|<||<|||"))).alias("x")).first().x == "<|<||<|||"


def test_every_participant_has_the_whole_dialogue(spark):
    long = [(1, i, "system" if i == 0 else "late" if i == 6 else "ab"[i % 2], f"t{i} <|") for i in range(7)]
    rows = [*long, *[(None, i, r, "x") for i, r in enumerate("cdc")], (2, 0, "system", "alone"), (3, 0, "e", "one"), (3, 1, "f", "two")]
    got = chat_formatting.whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=2).collect()
    for conv in (1, None, 3):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        names = {r for r, _ in turns} - {"system"}
        assert {r.perspective for r in got if r.conv_id == conv} == names
        for name in names:
            own = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, name)), key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(-(-len(turns) // 2)))
            heads = ["assistant" if r == name else r if r == "system" else f"user name={r}" for r, _ in turns]
            assert "".join(r.text for r in own) == "".join(f"<|im_start|>{h}\n{t.replace('<|', '<||')}<|im_end|>\n" for h, (_, t) in zip(heads, turns, strict=True))
            assert [r.text[m.start : m.end] for r in own for m in r.mask] == [t.replace("<|", "<||") + "<|im_end|>" for r, t in turns if r == name]
    assert not any(r.conv_id == 2 for r in got)


def test_a_long_dialogue_is_whole_for_a_silent_participant(spark):
    """130 turns, three pieces; c speaks once. The SQL and the operator agree, beside columns that the SQL's own names clash with."""
    rows = [(7, i, "c" if i == 3 else "ab"[i % 2], f"turn {i}", "x", "y") for i in range(130)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, place string")
    got = chat_formatting.whole(turns).collect()
    assert sorted((r.perspective, r.piece, r.n_turns) for r in got) == [(p, k, n) for p in "abc" for k, n in enumerate((64, 64, 2))]
    assert [len(r.mask) for r in sorted(got, key=lambda r: r.piece) if r.perspective == "c"] == [1, 0, 0]
    c = duckdb.connect()
    c.register("conversations", turns.toPandas())
    want = c.sql(chat_formatting.ORACLE_SQL).fetchall()
    mine = [(r.conv_id, r.piece, r.perspective, r.n_turns, r.text, ",".join(f"{m.start}-{m.end}" for m in r.mask)) for r in got]
    assert sorted(want) == sorted(mine)
    assert chat_formatting.whole(turns.filter("false")).count() == 0


def test_stages_keep_the_columns(spark, odd, tmp_path):
    spark.createDataFrame([(0, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        out.count()
        assert stage(spark, odd.filter("false"), str(tmp_path)).count() == 0
