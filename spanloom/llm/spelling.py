"""Spelling variants by bands of letter-parity masks, with DataFrame functions only.

A word's mask has a bit for each letter that it holds an odd number of times. One edit flips at most two bits, so of three bands of the mask
at least one stays as it is: words are joined on equal bands, with lengths that differ by at most one, and each pair is verified.

Equal bands alone would put a fixed share of all words into each group. What the edit leaves at the word's beginning or
at its end is therefore part of the key: of two words that differ by one edit, the shorter one having m code points, the first or the last
ceil((m - 1) / 2) code points agree. That loses no pair. Groups of more than ``MOST`` keys of words are
split again by the same rule for what is left of the words, as often as it takes; words too short to be split on are compared.
A pair that several keys find is reported once, by the first of them that it agrees on.

A word has at most as many near words as one edit can make of it, so no group of pairs is larger than that.

Defined cases: a null or empty text has no words. A null id is written as the empty text before the colon. Repeated rows are counted
each. Ties of counts go to the word that comes first in code-point order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, key_text, whole, written

LETTER = "[A-Za-zÀ-ÿ]"
#: Words are of at least so many code points and occurrences; a form has at least so many times the occurrences of its word.
LETTERS, LEAST, TIMES = 6, 5, 5
#: Runs whose hash this number divides lose a code point.
SLIPS = 199
#: Keys of one group that are compared with each other, at most.
MOST = 256
BANDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def slipped(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, or what is left of it without the code point that its hash names."""
    h = F.crc32(F.concat(key_text(doc_id), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of whole texts, counted in each task before they are shuffled. A shorter run gives no word, so only runs of LETTERS and more are taken."""
    long_runs = F.regexp_extract_all(whole(column(docs, "text", "string")), F.lit(f"{LETTER}{{{LETTERS},}}"), F.lit(0))
    runs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.explode(long_runs).alias("run"))
    counted = runs.select("doc_id", lowered(F.col("run")).alias("run")).groupBy(slipped(F.col("doc_id"), F.col("run")).alias("word")).agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= LEAST) & (F.length("word") >= LETTERS))


def mask(word: Column) -> Column:
    """A bit for each letter of an odd count: a-z have the first 26 of 63 bits, others share the rest."""
    code = lambda c: F.ascii(c)  # noqa: E731  the code point of the first character
    bit = lambda c: F.when(code(c) < 128, code(c) - 97).otherwise(26 + code(c) % 37)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(c), F.lit(63)))))


def band(m: Column, b: int) -> Column:
    """Every third bit from the b-th."""
    return m.bitwiseAND(sum(1 << i for i in range(b, 63, BANDS)))


def _halves(left: Column, m: Column) -> Column:
    """The beginning and the end of what is left of a word, one of which stays if one edit makes it another of m code points or m + 1; with the rest."""
    k = F.ceil((m - 1) / 2).cast("int")
    rest = F.length(left) - k
    first = F.struct(F.lit("<").alias("side"), F.substring(left, F.lit(1), k).alias("part"), F.substring(left, k + 1, rest).alias("left"))
    last = F.struct(F.lit(">").alias("side"), F.substring(left, rest + 1, k).alias("part"), F.substring(left, F.lit(1), rest).alias("left"))
    return F.struct((m - k).alias("m"), F.array(first, last).alias("ways"))


def keyed(words: DataFrame) -> DataFrame:
    """words (word, n) once for each band, side and length m of the shorter word of a pair: key, m, left, word, n, mask."""
    base = words.withColumn("mask", mask(F.col("word"))).withColumn("length", F.length("word"))
    lengths = base.withColumn("of", F.explode(F.when(F.col("length") > LETTERS, F.array("length", F.col("length") - 1)).otherwise(F.array("length"))))
    bands = F.array(*[F.struct(F.lit(b).alias("b"), band(F.col("mask"), b).alias("bits")) for b in range(BANDS)])
    cut = lengths.withColumn("_h", _halves(F.col("word"), F.col("of"))).withColumn("_w", F.explode("_h.ways")).withColumn("_b", F.explode(bands))
    return cut.select(F.xxhash64("of", "_b", "_w.side", "_w.part").alias("key"), F.col("_h.m").alias("m"), "_w.left", "of", "word", "n", "mask")


def _deeper(rows: DataFrame) -> DataFrame:
    """The keys of too large groups, split by the halves of what is left."""
    cut = rows.withColumn("_h", _halves(F.col("left"), F.col("m"))).withColumn("_w", F.explode("_h.ways"))
    return cut.select(F.xxhash64("key", "_w.side", "_w.part").alias("key"), F.col("_h.m").alias("m"), "_w.left", "of", "word", "n", "mask")


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of keyed(), those of groups over ``most`` split until no group is larger or nothing can be split off."""
    rows, done = written(keyed(words), "keys"), None
    while True:
        large = written(rows.groupBy("key").agg(F.count("*").alias("c"), F.min("m").alias("least")).filter((F.col("c") > most) & (F.col("least") > 1)).select("key"), "large")
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        rows = written(_deeper(rows.join(large, "key", "left_semi")), "keys")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, b, a_n, b_n: the pairs of words that differ by one inserted, deleted or replaced code point, each once, a being the shorter or the lesser one."""
    rows = groups(words, most)
    a = rows.filter(F.length("word") == F.col("of")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("_am"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("_bm"))
    more = F.length("b") - F.length("a")
    close = F.bit_count(F.col("_am").bitwiseXOR(F.col("_bm"))) <= 2
    met = a.join(b, "key").filter(((more == 1) | (more == 0) & (F.col("a") < F.col("b"))) & close & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "a_n", "b_n").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest count, if it has TIMES the word's."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_n"), "near")).alias("_best"))
    joined = words.join(best, "word", "left")
    often = -F.col("_best._n") >= TIMES * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("_best.near")).alias("form"), F.when(often, -F.col("_best._n")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """found with root: the last of the forms that follow a word's, by doubling the way that is known in each round.

    Counts rise TIMES times with each form, so rounds are few.
    """
    ways = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = written(ways.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_on")), "ways")
        ways = step.drop("_on")
        if step.filter("_on").isEmpty():
            return found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of docs."""
    words = written(vocabulary(docs), "vocabulary")
    found = written(forms(words, near_pairs(words)), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")


#: By deleted letters: two words are near if one is the other without a code point, or if they agree without their code points at one place.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY 1, 2
), x AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM r WHERE length(run) >= 6),
h AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(b) // 2), lambda i: 16 * (instr('0123456789ABCDEF', b[2 * i + 1]) - 1) + instr('0123456789ABCDEF', b[2 * i + 2]) - 1),
         lambda c, v: xor(c // 256, t[1 + xor(c % 256, v)]))) AS h FROM x, bits
), c AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word
), g AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.most >= 5 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.near_n = g.most) END AS form, CASE WHEN g.most >= 5 * w.n THEN g.most END AS form_n
  FROM w LEFT JOIN g ON w.word = g.word
), s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.next = f.word)
SELECT f.word, form, s.root, n, n_near, form_n FROM f JOIN s ON f.word = s.word WHERE s.next IS NULL
"""
