"""The operators against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.llm import lm_scoring, media, mixing, near_dedup, quality_classifier, quality_rules, url_filters, warc

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_equals_oracle(name, spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = entry.queries()[name](spark, DIR), c.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    a = sorted(tuple(str(plain(r[x])) for x in columns) for r in got.collect())
    b = sorted(tuple(str(plain(dict(zip(want.columns, r, strict=True))[x])) for x in columns) for r in want.fetchall())
    assert a == b


def test_targets_share_everything(spark):
    r = random.Random(2)
    for _ in range(4):
        sizes = [(f"s{i}" if i else None, r.choice([0, 1, 10, 1000, 50_000])) for i in range(r.randint(1, 7))]
        got = {x.source: x for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
        weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
        size, total = dict(sizes), sum(n for _, n in sizes)
        target, capped = {}, set()
        while True:
            left = total - sum(3 * size[s] for s in capped)
            open_ = sum(weight[s] for s in order if s not in capped)
            target = {s: 3 * size[s] if s in capped else left * weight[s] / open_ for s in order}
            over = {s for s in order if target[s] > 3 * size[s] + 1e-9} - capped
            if not over:
                break
            capped |= over
        for s in order:
            assert got[s].target == pytest.approx(target[s])


def test_larger_mixes_hold_smaller_ones(spark):
    """A source of a larger weight takes all that it takes with a smaller one."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    small, large = ({r.doc_id: r.taken for r in mixing.mix(docs, weights=w).filter("doc_id % 2 = 0").collect()} for w in ((1.0, 4.0), (2.0, 3.0)))
    assert all(large[i] >= n for i, n in small.items()) and sum(large.values()) > 1.5 * sum(small.values()) > 0


def test_many_sources_are_numbered_in_order(spark):
    sizes = spark.range(3000).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("source"), (F.col("id") % 7).alias("source_size"))
    got = mixing.numbered(sizes.repartition(16), F.col("source").asc_nulls_last()).orderBy("source").select("_i").collect()
    assert [r[0] for r in got] == list(range(3000))


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_dedup_equals_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghijklmnopq") + str(r.randint(0, 99)) for _ in range(r.randint(3, 120))) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(40))
    docs, i = [], 0
    for b in base:
        for _ in range(r.choice([1, 1, 2, 5])):
            w = b.split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
            docs.append((i, " ".join(w) + (" " + passage if r.random() < 0.3 else "")))
            i += 1
    hot = [f"h{i}" for i in range(90)]
    for _ in range(320):
        w = list(hot)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"y{r.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
        i += 1
    want = brute_components(docs)
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.classify(docs, quality_classifier.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    order = scored["score"].rank()
    good, bad = scored["quality"] == 1, scored["quality"] == 0
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * bad.sum())
    assert auc > 0.95
    assert (scored["predicted"][good] == 1).mean() > 0.97


def test_trees_equal_naive_boosting():
    """Splits found by trying every cut on every row, and scores by walking down one row at a time."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > -0.3)).astype(float)
    got = quality_classifier.fit(x, y, trees=5, depth=2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality_classifier.BINS + 1)[1:-1])) for j in range(4)]
    total = np.full(len(y), got.start)
    for t in range(5):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def best(rows):
            value = lambda k: g[k].sum() ** 2 / (h[k].sum() + quality_classifier.RIDGE)
            found = (1e-6, None, None)
            for j in range(4):
                for c in cuts[j]:
                    left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if min(len(left), len(right)) >= quality_classifier.LEAST:
                        gain = value(left) + value(right) - value(rows)
                        if gain > found[0] + 1e-12:
                            found = (gain, j, c)
            return found

        add = np.zeros(len(y))
        rows = np.arange(len(y))
        _, j, c = best(rows)
        sides = [rows[x[:, j] <= c], rows[x[:, j] > c]] if j is not None else [rows]
        for side in sides:
            _, j, c = best(side)
            for leaf in [side[x[side, j] <= c], side[x[side, j] > c]] if j is not None else [side]:
                add[leaf] = quality_classifier.RATE * g[leaf].sum() / (h[leaf].sum() + quality_classifier.RIDGE)
        total = total + add
    assert got.score(x) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    for i in range(50):
        odds = got.start
        for feature, cut, leaf in zip(got.feature, got.cut, got.leaf, strict=True):
            at = 0
            for _ in range(2):
                at = 2 * at + (2 if x[i, feature[at]] > cut[at] else 1)
            odds += leaf[at - 3]
        assert got.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a b a b", None, "", "LINE!!\nLINE!!\n| x |", "é ü " * 50, "a b a b a b"]
    together = quality_classifier.statistics(pa.array(texts))
    alone = np.concatenate([quality_classifier.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    assert (together[0] == together[5]).all()


def repeats(words):
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def test_rule_counts_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [(10**6, None), (10**6 + 1, "a a a a a a a\n\n \nb\nb"), (10**6 + 2, "")]
    got = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"))
    for r, t in ((r, dict(docs)[r.doc_id] or "") for r in got.collect()):
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = quality_rules.quality_rules(docs).join(labels, "doc_id")
    row = both.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert row.good > 0.97 and row.bad < 0.4


@pytest.mark.parametrize("share", [0.9, 0.5, 0.3, 0.1])
def test_rules_learn_what_votes_were_made_from(share):
    """Synthetic votes of known chances, on tables of mostly good and of mostly bad documents."""
    r = np.random.default_rng(1)
    kinds = [quality_rules.KINDS[k] for k in quality_rules.rules()]
    names = sorted(set(kinds))
    n = 20_000
    good, kind = r.random(n) < share, r.integers(0, len(names), n)
    right = r.uniform(0.5, 0.85, len(kinds))
    votes = np.zeros((n, len(kinds)), int)
    for j, k in enumerate(kinds):
        own = ~good & (np.array(names)[kind] == k)
        bad, fine = np.where(own, right[j], np.where(good, 0.03, 0.08)), np.where(own, 0.05, np.where(good, 0.6, 0.4))
        u = r.random(n)
        votes[:, j] = np.where(u < bad, -1, np.where(u < bad + fine, 1, 0))
    counted = Counter(map(tuple, votes.tolist()))
    model = quality_rules.fit(sorted(counted.items()), kinds)
    assert np.exp(model[0][0]) == pytest.approx(share, abs=0.03)
    for j, k in enumerate(kinds):
        assert np.exp(model[1 + names.index(k)][1][j][0]) == pytest.approx(right[j], abs=0.1)
    odds = {v: [s + sum(c[x + 1] for c, x in zip(chances, v, strict=True)) for s, chances in model] for v in counted}
    judged = np.array([1 / sum(np.exp(o - odds[v][0]) for o in odds[v]) >= 0.5 for v in map(tuple, votes.tolist())])
    assert (judged == good).mean() > 0.88


def test_base_score_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 3, "unseenword unseenword and the")], "doc_id long, text string"))
    got = {r.doc_id: r for r in lm_scoring.lm_score(docs).collect()}
    words = {r.doc_id: WORD.findall(low(r.text)) for r in docs.collect()}
    training = [i for i in words if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in training for w in words[i])
    ends = len(training)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    better = 0
    for i, w in words.items():
        want = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in counts for x in w) + 1, n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.score < 0
        better += r.score > r.base_score
    assert better > 0.5 * len(words)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60).cache()
    a, b = ({r.doc_id: r.score for r in lm_scoring.lm_score(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert a.keys() == b.keys()
    assert all(a[i] == pytest.approx(b[i], rel=1e-5) for i in a)


def test_weights_are_those_that_made_the_bits():
    """Bits drawn from a known mix of the predictions give back its weights, gate by gate."""
    r = np.random.default_rng(0)
    n = lm_scoring.STEPS
    level = np.indices((n,) * 3).reshape(3, -1)
    true = np.array([0.2, 0.5, 0.4])
    p = 1 / (1 + np.exp(-(lm_scoring._VALUE[level].T @ true)))
    ones = r.binomial(200, p)
    cells = np.stack([200 - ones, ones], 1).ravel()
    found = lm_scoring.fitted(cells)
    # Gates in which both hashed contexts say something.
    told = [g for g in range(16) if g >= 4 and g % 4]
    assert found[told] == pytest.approx(np.tile(true, (9, 1)), abs=0.05)
    assert (lm_scoring.fitted(np.zeros(2 * n**3)) == lm_scoring.EVEN).all()


def test_tables_grow_with_the_words():
    assert [lm_scoring.slot_bits(n) for n in (0, 1, 1 << 26, 1 << 29, 1 << 32, 1 << 44)] == [22, 22, 22, 23, 24, 28]


@pytest.mark.parametrize("tokens", [1 << 20, 1 << 29])
def test_slots_are_all_counted(tokens):
    """Partial sums by block add up to the bits themselves, also where a sum outgrows 16 bits, in tables of either size."""
    r = np.random.default_rng(1)
    docs = [" ".join(r.choice(["a", "b", "new", "zz"], 9)) for _ in range(12_000)] + ["a a a a a a a a"] * 20_000
    h, n = np.unique(lm_scoring.words(*lm_scoring.texts(pa.array(["a", "b"]))).hashes, return_counts=True)
    v = lm_scoring.vocabulary_from(h, n, np.arange(2), np.zeros(0, int), np.ones(256), tokens, 4, 1)
    wide = lm_scoring.slot_bits(v.tokens)
    got = np.zeros((4 << wide) // (2 << lm_scoring.BLOCK_BITS) * (2 << lm_scoring.BLOCK_BITS), np.int64).reshape(-1, 2 << lm_scoring.BLOCK_BITS)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(d))), pa.array(d)], names=["doc_id", "text"]) for d in (docs[:7_000], docs[7_000:])]
    rows = 0
    for b in lm_scoring._slots(v, iter(batches)):
        for block, cells, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            np.add.at(got[block], np.frombuffer(cells, np.uint16), np.frombuffer(counts, np.int32))
            rows += 1
    found = lm_scoring.words(*lm_scoring.texts(pa.array(docs)))
    of, first = lm_scoring.symbols(v, found, v.find(found.hashes))
    _, _, bit, *slots = lm_scoring.bits(v.codes, wide, of, *lm_scoring.contexts(of, first, v.first_word))
    want = np.concatenate([np.bincount(s.astype(np.int64) * 2 + bit, minlength=2 << wide) for s in slots])
    assert want.max() > 65535 and rows > len(np.unique(np.flatnonzero(want) // (2 << lm_scoring.BLOCK_BITS)))
    assert (got.ravel() == want).all()


def test_one_word_more_is_never_likelier():
    """Every text's probability is a product over its symbols' bits: a longer text with the same beginning has less, however short."""
    docs = ["the cat sat", "the cat sat on", "the cat sat on the mat", "zzz"]
    import pyarrow as pa

    h = lm_scoring.words(*lm_scoring.texts(pa.array(docs[:3]))).hashes
    keys, n = np.unique(h, return_counts=True)
    v = lm_scoring.vocabulary_from(keys, n, np.arange(len(keys)), np.zeros(0, int), np.ones(256), int(n.sum()), len(keys), 3)
    tables = tuple(np.zeros(1 << lm_scoring.SLOT_BITS, np.int8) for _ in range(2))
    model = lm_scoring.Model(v, tables, np.full((16, 3), lm_scoring.EVEN))
    score = [float(model.score(*lm_scoring.symbols(v, w, v.find(w.hashes)))[0]) for w in (lm_scoring.words(*lm_scoring.texts(pa.array([d]))) for d in docs)]
    assert 0 > score[0] > score[1] > score[2]
    found = lm_scoring.words(*lm_scoring.texts(pa.array(docs)))
    assert model.score(*lm_scoring.symbols(v, found, v.find(found.hashes))) == pytest.approx(score, rel=1e-5)


def test_probabilities_sum_to_one_at_most():
    """Over all short words that a tiny model can spell or knows, and the end."""
    h = np.sort(np.array([5, 9], np.uint64))
    v = lm_scoring.vocabulary_from(h, np.array([3, 2]), np.array([0]), np.array([1]), np.ones(256), 5, 2, 1)
    codes = v.codes
    lengths = np.diff(codes.begin)
    assert sum(2.0 ** -int(n) for n in lengths) == pytest.approx(1.0)


def records(n):
    out = []
    for i in range(n):
        body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nbody" + str(i).encode()
        import base64

        digest = base64.b32encode(hashlib.sha1(b"body" + str(i).encode()).digest())
        out.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, digest, len(body), body))
    return out


def ids(data):
    found = list(warc.salvage(data))
    return [x[3]["fields"]["warc-record-id"] for x in found if x[0] == "record"], [x[1:3] for x in found if x[0] == "gap"]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_later_records(zipped):
    parts = [gzip.compress(x) if zipped else x for x in records(6)]
    assert ids(b"".join(parts)) == ([f"<urn:{i}>" for i in range(6)], [])
    r = random.Random(4)
    for _ in range(60):
        k = r.randrange(6)
        broken = bytearray(parts[k])
        how = r.randrange(3)
        if how == 0:
            del broken[r.randrange(len(broken) // 2) :]
        elif how == 1:
            broken[:3] = b"???"
        else:
            broken[len(broken) // 2 :] = bytes(r.randrange(256) for _ in range(len(broken) - len(broken) // 2))
        data = b"".join([*parts[:k], bytes(broken), *parts[k + 1 :]])
        found, gaps = ids(data)
        assert [f"<urn:{i}>" for i in range(6) if i != k] == [x for x in found if x != f"<urn:{k}>"]
        at = sum(map(len, parts[:k]))
        assert gaps == [] or (gaps[0][0] >= at and sum(gaps[-1]) <= at + len(broken))
        if not gaps:
            assert f"<urn:{k}>" in found or not broken
    assert ids(b"") == ([], []) and ids(b"junk")[0] == []


def test_damaged_archives_through_spark(spark, tmp_path):
    parts = records(5)
    (tmp_path / "whole.warc").write_bytes(b"".join(parts))
    (tmp_path / "cut.warc").write_bytes(parts[0] + parts[1][:40] + b"".join(parts[2:]))
    (tmp_path / "zip.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[:3]) + b"junk" + gzip.compress(parts[4]))
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for x in found:
        by[x.archive.rsplit("/", 1)[1], x.kind].append(x)
    assert len(by["whole.warc", "record"]) == 5 and not by["whole.warc", "gap"]
    assert [x.record_id for x in by["cut.warc", "record"]] == [f"<urn:{i}>" for i in (0, 2, 3, 4)]
    assert [(x.at, x.length) for x in by["cut.warc", "gap"]] == [(len(parts[0]), 40)]
    assert [x.record_id for x in by["zip.warc.gz", "record"]] == [f"<urn:{i}>" for i in (0, 1, 2, 4)] and sum(x.length for x in by["zip.warc.gz", "gap"]) == 4
    gaps = {(x.archive.rsplit("/", 1)[1], x.gap_bytes) for x in warc.with_gaps(warc.read(spark, str(tmp_path))).collect()}
    assert gaps == {("whole.warc", 0), ("cut.warc", 40), ("zip.warc.gz", 4)}


def test_long_payloads_have_files_of_their_own(spark):
    sizes = [10] * 50 + [70_000] * 3 + [5 << 20] * 2
    pages = spark.createDataFrame([(i, f"http://h/{i}", str(i % 10) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    found = warc.archived(pages).filter("kind = 'record'").collect()
    assert sorted(x.content_length for x in found) == sorted(sizes)
    for x in found:
        if x.content_length == 5 << 20:
            assert sum(y.archive == x.archive for y in found) == 1


def test_a_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    blocks = url_filters.bloom(keys, 3000)
    passed = spark.range(9000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), "id").filter(url_filters._passes(F.col("key"), blocks))
    row = passed.agg(F.count_if(F.col("id") < 3000).alias("true"), F.count_if(F.col("id") >= 3000).alias("false")).first()
    assert row.true == 3000 and row.false < 300


def test_media_rows_equal_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 576), (10**6 + 3, "é" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r, t in ((r, dict(texts)[r.doc_id]) for r in media.features(media.store(docs)).collect()):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, media.RATE, media.RATE, 1, 8) + b"data" + len(payload).to_bytes(4, "little")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(head + payload), hashlib.sha256(head + payload).hexdigest())
        assert r.landmarks == sorted(r.landmarks) and r.feature == f"{len(r.landmarks)}:{hashlib.sha256(np.array(r.landmarks, '<i8').tobytes()).hexdigest()}"
        # Each code's peaks are peaks of the frames that it names.
        for code in r.landmarks[:20]:
            for frame, of in ((code >> 32, code >> 20 & 4095), ((code >> 32) + (code & 255), code >> 8 & 4095)):
                wave = (np.frombuffer(payload, np.uint8)[frame * 288 : frame * 288 + 576].astype(float) - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 576))
                power = [abs(np.sum(wave * np.exp(-2j * np.pi * k * np.arange(576) / 576))) for k in (of - 1, of, of + 1)]
                assert power[1] >= max(power) - 1e-3 * max(power)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.features(nothing).first().payload_bytes is None


def test_media_round_trip(spark):
    for text in (b"", b"x", b"y" * 576, bytes(range(256)) * 40):
        payload = media.payload_of(text)
        assert len(payload) % media.FRAME == 0 and len(payload) >= media.FRAME and payload.startswith(text)
        assert media.from_wav(media.to_wav(payload)) == payload
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(576 * 8) / 576)).astype(np.uint8)
    at, bins = media.peaks(tone)
    assert (bins[at == 3] == 40).any()
    codes = media.landmarks(tone)
    assert (np.diff(codes) >= 0).all()
    half = media.landmarks(tone[: 576 * 4])
    assert set(half.tolist()) <= set(codes.tolist())
