"""Exact dedup, conversation tries and spelling groups against brute force, on nulls, ties, repeated rows, clashing names, long rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spanloom.llm import exact_dedup, prefix_trie, spelling


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# exact dedup


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def dedup_of(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str)


def test_exact_dedup_of_odd_documents(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    assert dedup_of(got) == dedup_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(odd.filter("false")).count() == 0


def test_hot_texts_meet_their_group(spark):
    """A text that a third of all rows have, others of many sizes, and blanks that differ."""
    r = random.Random(5)
    rows = [(i, r.choice(["the  same", "the same", "the\n\tsame"]) if i % 3 == 0 else f"text {r.randint(0, 400)}{r.choice(['', ' '])}") for i in range(6000)]
    r.shuffle(rows)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert dedup_of(got) == dedup_by_hand(rows)


def test_index_outlives_its_session_and_batches_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = docs([(5, "a"), (6, "a  b"), (7, "a")]), docs([(1, "a"), (2, "new"), (2, "new"), (3, "a b"), (None, None)])
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert sorted(x.doc_id for x in exact_dedup.new_texts(first, index, "monday").collect()) == [5, 6]
    spark.sql(f"DROP TABLE {index.table}")  # the catalogue forgets, the files stay
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 4 and index.rows().count() == 2
    for _ in range(2):  # a batch that is added again changes nothing
        assert sorted((x.doc_id is None, x.doc_id, x.text) for x in exact_dedup.new_texts(second, index, "tuesday").collect()) == [(False, 2, "new"), (True, None, None)]
        assert index.rows().count() == 4
    assert exact_dedup.new_texts(second, index, "wednesday").count() == 0
    other = index.rebucketed(f"file://{tmp_path}/wider", 8)
    assert sorted(map(tuple, other.rows().collect())) == sorted(map(tuple, index.rows().collect()))
    with pytest.raises(ValueError):
        index.add(exact_dedup.digests(first), "no name")


@pytest.mark.parametrize("buckets", [4, 8, 20])
def test_index_is_not_shuffled(spark, tmp_path, buckets):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/plain", buckets)
    rows = exact_dedup.digests(spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string"))
    index.add(rows, "a")
    plan = exact_dedup.written(exact_dedup._firsts(rows), "x").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("SortMergeJoin") :]
    right = scan[scan.rindex("+- Sort") :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in right and "Exchange" not in right


def test_new_texts_keep_all_columns(odd, tmp_path, spark):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/odd", 3)
    got = exact_dedup.new_texts(odd, index, "a")
    assert got.columns == odd.columns
    assert sorted(normal(r.text) for r in got.collect()) == sorted({normal(r.text) for r in odd.collect()})


# conversation tries


def trie_by_hand(rows):
    whole = lambda x: x or ""
    digest = lambda role, text: hashlib.sha256(f"{len(whole(role))}:{whole(role)}:{whole(text)}".encode()).hexdigest()
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        original[conv].append((turn is not None, turn or 0, digest(role, text), whole(role), whole(text)))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in original.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6
        first = turns.get(c - c % 100, []) if c is not None else []
        built[c] = tuple(first[:h] + own[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    lowest = lambda m: min((c for c in m if c is not None), default=None)
    out = []
    for node in members:
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ended = sorted((c for c in members[node] if len(built[c]) == len(node)), key=lambda c: (c is None, c or 0))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        text = ",".join("" if c is None else str(c) for c in ended)
        out.append((lowest(members[node]), len(node), lowest(members[node[:-1]]) if node else None, len(members[node]), len(children), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


KIND = "conv_id long, turn long, role string, text string, depth string, key string, n string"


@pytest.mark.parametrize("block", [2, 3, 64])
def test_trie_by_brute_force(spark, block):
    """Few distinct turns, so that conversations share long prefixes; blocks so short that there are several levels of them."""
    r = random.Random(block)
    rows = []
    for c in [*range(40), *range(100, 130), *range(205, 225), 7000, 7001, None]:
        for t in range(r.choice([1, 2, 3, 5, 9, 30])):
            text = r.choice(["hello", "hello", "hello there", "", None, "é🙂"]) if t < 2 else "same" if r.random() < 0.95 else "other"
            rows.append((c, r.choice([t, t, t, t // 2, None]) if c and c % 9 == 0 else t, r.choice(["user", "user", None, ""]) if t == 0 else "user", text, "x", "x", "x"))
    rows += rows[:20]
    r.shuffle(rows)
    got = trie_of(prefix_trie.trie(spark.createDataFrame(rows, KIND).repartition(5), block))
    assert got == trie_by_hand([x[:4] for x in rows])


def test_trie_of_one_deep_and_of_no_conversation(spark):
    deep = [(0, t, "user", f"turn {t % 3}", "x", "x", "x") for t in range(300)] + [(c, t, "user", f"turn {t % 3}", "x", "x", "x") for c in (1, 2, 3) for t in range(c)]
    assert trie_of(prefix_trie.trie(spark.createDataFrame(deep, KIND), 4)) == trie_by_hand([x[:4] for x in deep])
    assert prefix_trie.trie(spark.createDataFrame([], KIND)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert trie_of(prefix_trie.trie(spark.createDataFrame([(turnless, 0, "user", "gone", "x", "x", "x")], KIND))) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_many_ends_of_one_node(spark):
    """Ids of several ranges, negative ones too, in numeric order."""
    ids = [*range(-3000, 3000, 7), 10**15, None]
    found = prefix_trie.ends(spark.createDataFrame([(b"k", i) for i in ids] + [(b"l", 5)], "key binary, conv_id long").repartition(6)).collect()
    text = ",".join([*(str(i) for i in ids[:-1]), ""])
    assert {bytes(r.key): r.ends_sha256 for r in found} == {b"k": hashlib.sha256(text.encode()).hexdigest(), b"l": hashlib.sha256(b"5").hexdigest()}


# spelling


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = len(close)
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], out[w], words.get(form[w])))
    return sorted(rows, key=str)


def spelled(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def variants(r, word, alphabet="abcdeéßà÷"):
    i, c = r.randrange(len(word)), r.choice(alphabet)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word])


def test_spelling_by_brute_force(spark):
    r = random.Random(3)
    roots = ["".join(r.choice("abcde") for _ in range(r.randint(6, 9))) for _ in range(12)] + ["aaaaaaaa", "àéßàéß", "Straßen", "ÉCOLES", "x" * 5000]
    rows = []
    for i in range(400):
        words = [r.choice(roots[:8]) if r.random() < 0.6 else variants(r, variants(r, r.choice(roots))) for _ in range(30)]
        rows.append((r.choice([i, i, None]), r.choice([" ", "\n", "-", "1", "Ā"]).join(r.choice([w, w.upper(), w.title()]) for w in words)))
    for word in ("station", "keyboard", "Größen", "letters", "wonderful"):  # a form of a form
        rows += [(i, word) for i in range(210)] + [(i, word[:-1] + "q") for i in range(30)] + [(i, "q" + word[1:-1] + "q") for i in range(6)]
    rows += [(1, None), (None, ""), (2, "short"), (3, "1234567890")]
    df = spark.createDataFrame([(*x, "x", "x", "x") for x in rows], "doc_id long, text string, word string, n string, key string")
    want = spelling_by_hand(rows)
    assert len({w for w, f, root, *_ in want if f and root != f}) > 3  # forms that have a form
    assert spelled(spelling.spelling_groups(df)) == want
    assert spelling.spelling_groups(df.filter("false")).count() == 0


@pytest.mark.parametrize("most", [2, 8])
def test_large_groups_are_split_without_losing_a_pair(spark, most):
    r = random.Random(most)
    words = {"station" + "".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(150)} | {"".join(r.choice("ab") for _ in range(r.randint(6, 8))) for _ in range(150)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((r.a, r.b) for r in spelling.near_pairs(df, most).collect())
    want = sorted((a, b) for a in words for b in words if near(a, b) and ((len(a), a) < (len(b), b)))
    assert got == want
