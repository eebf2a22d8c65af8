import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import memory
from spanloom.sources import files, tabular
from spanloom.streaming import restore


def test_sniffed_delimiters(spark):
    texts = ["a,b,c\n1,2,3\n", "a;b\n1;2\n3;4", "a\tb\n1\t2\n", "no delimiter\nat all", 'x;"a,b";c\n1;"c,d";2', ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tabular.sniffed(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == [",", ";", "\t", ",", ";", ","]


def test_cells_and_records(spark):
    got = spark.createDataFrame([('a,"b ""c"", d",e',)], "l string").select(tabular.cells(F.col("l"), ",").alias("c")).first().c
    assert got == ["a", 'b "c", d', "e"]
    rows = tabular.records(spark.createDataFrame([("f", "Title\nname,,city\nAnn,x,Paris\nBob,,Rome\n")], "path string, text string")).orderBy("line").collect()
    assert [r.record for r in rows] == ["Title", "name: Ann | col2: x | city: Paris", "name: Bob | city: Rome"]
    rows = tabular.records(spark.createDataFrame([("f", 'name;note\r\nAnn;"two\nlines; ""quoted"""\nBob;x\n'), ("g", None), ("h", "")], "path string, text string")).orderBy("line").collect()
    assert [(r.path, r.record) for r in rows] == [("f", 'name: Ann | note: two\nlines; "quoted"'), ("f", "name: Bob | note: x")]


@pytest.mark.parametrize("vault", [{"jo@melvio.com": "A", "melvio.com": "B"}, {"[P1]": "x", "[P12]": "y", "P1": "z"}, {"aa": "1", "aab": "2", "ab": "3"}, {"n1": "7", "n12": "8"}, {}])
def test_any_split_restores_as_the_whole(vault):
    r = random.Random(7)
    texts = ["write to jo@melvio.com now", "jo@melvio.co", "see [P12] and [P1", "aabaaabab", "n1 n12 n123"]
    for text in texts:
        want = restore.substituted(text, vault)
        for _ in range(40):
            cuts = sorted(r.sample(range(len(text) + 1), r.randint(0, 4)))
            pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            out, held = "", ""
            for i, piece in enumerate(pieces):
                told, held = restore.release(held, piece, vault, i == len(pieces) - 1)
                out += told
            assert out == want, (text, cuts)
    told, held = restore.release("", "write to jo@melvio.com", {"jo@melvio.com": "A", "melvio.com": "B"}, False)
    assert (told, held) == ("write to A", "")


def test_events_are_reframed_wherever_chunks_are_cut(spark, tmp_path):
    text = "event: a\r\ndata: one\r\ndata: more\r\n\r\nid: 7\ndata: two\n\ndata: cut"
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        rows = [{"stream_id": s, "seq": i, "chunk": text[i * n : (i + 1) * n]} for s, n in (("x", 1), ("y", 7)) for i in range(-(-len(text) // n)) if (i * n < 20) == (k == 0)]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string").option("maxFilesPerTrigger", 1).json(str(folder))
    run = restore.reframed(chunks).writeStream.format("memory").queryName("reframed").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    # State with a time-out keeps a stream going: it is stopped once all is told.
    try:
        for _ in range(120):
            if run.awaitTermination(1) or spark.table("reframed").count() >= 4:
                break
    finally:
        run.stop()
    got = sorted(tuple(r) for r in spark.table("reframed").collect())
    assert got == sorted((s, n, e, d, i) for s in "xy" for n, e, d, i in ((0, "a", "one\nmore", None), (1, None, "two", "7")))


def test_cut_row(spark):
    lines = spark.createDataFrame([("k", i, "x" * 9) for i in range(5)], "k string, row int, text string")
    assert tabular.cut_row(lines, 25, "k").first().cut == 2
    assert tabular.cut_row(lines, 50, "k").first().cut is None


def test_tree_chats(spark):
    message = lambda role, *parts: {"author": {"role": role}, "content": {"parts": list(parts)}}
    export = {
        "conversation_id": "c1",
        "current_node": "d",
        "mapping": {
            "a": {"id": "a", "parent": None, "message": None},
            "b": {"id": "b", "parent": "a", "message": message("user", "hello", "there")},
            "c": {"id": "c", "parent": "b", "message": message("assistant", "old branch")},
            "d": {"id": "d", "parent": "b", "message": message("assistant", "new branch")},
        },
    }
    loop = {"id": "c2", "current_node": "x", "mapping": {"x": {"id": "x", "parent": "y", "message": message("user", "1")}, "y": {"id": "y", "parent": "x", "message": message("user", "0")}}}
    df = spark.createDataFrame([(json.dumps(export),), (json.dumps(loop),)], "export string")
    rows = files.tree_chats(df).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in rows] == [("c1", 0, "user", "hello\nthere"), ("c1", 1, "assistant", "new branch"), ("c2", 0, "user", "0"), ("c2", 1, "user", "1")]
    assert [r.p for r in df.select(files.provider(F.col("export")).alias("p")).collect()] == ["tree", "tree"]


def test_guarded(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    (tmp_path / "d.csv").write_bytes(b"a,b")
    found = files.guarded(spark.read.format("binaryFile").load(str(tmp_path))).select("path", "error").collect()
    assert {r.path.rsplit("/", 1)[1]: r.error for r in found} == {"a.txt": None, "b.txt": "type_mismatch", "c.exe": "unsupported", "d.csv": None}
    assert {r.text for r in files.texts(spark, str(tmp_path)).collect()} == {"hello", "a,b"}


VAULT = {"[EMAIL1]": "a@b.co", "[EMAIL12]": "c@d.org", "[NAME1]": "Ann"}
TEXT = "To [EMAIL1], [EMAIL12] and [NAME1]: [EMAIL is no token [NAME1]"


def test_any_split_restores_the_same():
    want = restore.substituted(TEXT, VAULT)
    r = random.Random(1)
    splits = [[i] for i in range(len(TEXT))] + [sorted(r.sample(range(len(TEXT)), 6)) for _ in range(200)] + [list(range(1, len(TEXT)))]
    for cuts in splits:
        buffer, out = "", ""
        bounds = [0, *cuts, len(TEXT)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            told, buffer = restore.release(buffer, TEXT[a:b], VAULT, b == len(TEXT))
            out += told
        assert out == want


def test_frames():
    assert restore.frames("event: a\r\ndata: 1\r\n\r\ndata: 2\ndata: 3\n\n") == [{"event": "a", "data": "1"}, {"data": "2\n3"}]


def test_stream_restores(spark, tmp_path):
    source, n = tmp_path / "in", len(TEXT)
    source.mkdir()
    names, values = list(VAULT), list(VAULT.values())
    for i, at in enumerate(range(0, n, 7)):
        row = {"stream_id": "s", "seq": i, "piece": TEXT[at : at + 7], "last": at + 7 >= n, "placeholders": names, "values": values}
        (source / f"{i:03}.json").write_text(json.dumps(row) + "\n")
        import os

        os.utime(source / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "stream_id string, seq long, piece string, last boolean, placeholders array<string>, values array<string>"
    pieces = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(source))
    run = restore.restored(pieces).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    told = spark.table("told").orderBy("seq").collect()
    assert "".join(r.text for r in told) == restore.substituted(TEXT, VAULT)


def test_an_idle_stream_tells_its_tail(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    vault = {"placeholders": ["[A1]", "[A1][B"], "values": ["Ann", "Bo"]}
    (source / "0.json").write_text("".join(json.dumps({"stream_id": s, "seq": 4, "piece": p, "last": False, **vault}) + "\n" for s, p in (("cut", "to [A"), ("whole", "to [A1]"), ("done", "to"))))
    schema = "stream_id string, seq long, piece string, last boolean, placeholders array<string>, values array<string>"
    run = restore.restored(spark.readStream.schema(schema).json(str(source)), "1 second").writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle").filter("seq = 5").count() < 2:
            time.sleep(0.5)
    finally:
        run.stop()
    got = {}
    for r in spark.table("idle").orderBy("stream_id", "seq").collect():
        got.setdefault(r.stream_id, []).append((r.seq, r.text))
    assert got == {"cut": [(4, "to "), (5, "[A")], "whole": [(4, "to "), (5, "Ann")], "done": [(4, "to")]}


def test_budget_is_the_greedy_one(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.randint(1, 9), r.randint(1, 30)) for i in range(60)]
    got = memory.budgeted(spark.createDataFrame(rows, "scope string, id long, score int, size int"), "scope", 100).collect()
    for scope in "ab":
        used, want = 0, []
        for _, i, _, size in sorted((x for x in rows if x[0] == scope), key=lambda x: (-x[2], x[1])):
            if used + size <= 100:
                used += size
                want.append(i)
        assert [x.id for x in sorted((x for x in got if x.scope == scope), key=lambda x: x.nth)] == want


def test_no_budget_or_rank_gathers_a_group(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1)], "scope string, id long, score int, size int")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "collect_list" not in plan(memory.budgeted(rows, "scope", 100))
    ranked = plan(memory.hybrid(spark.createDataFrame([(1, 0.0, 0.5)], "id long, lexical double, cosine double")))
    assert "min(cosine" in ranked and "windowspecdefinition(0" not in ranked


def test_budget_over_many_ranges(spark):
    r = random.Random(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for budget, scopes in ((100, "aaab"), (3000, "a"), (7, "abc"), (0, "ab")):
        rows = [(r.choice(scopes), i, r.choice([None, *range(50)]), r.choice([None, 0, *range(1, 60)])) for i in range(400)] + [(None, i, 5, i) for i in range(30)]
        got = memory.budgeted(spark.createDataFrame(rows, "scope string, id long, score int, size int").repartition(4), "scope", budget).collect()
        for scope in {x[0] for x in rows}:
            used, want = 0, []
            for _, i, _, size in sorted((x for x in rows if x[0] == scope), key=lambda x: (x[2] is not None, -(x[2] or 0), x[1])):
                if size is not None and used + size <= budget:
                    used += size
                    want.append(i)
            own = sorted((x for x in got if x.scope == scope), key=lambda x: x.nth)
            assert [(x.nth, x.id, x.used) for x in own] == [(n, i, used) for n, i in enumerate(want)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
