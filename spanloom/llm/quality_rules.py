"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Votes are counted by
pattern (at most 3 ** rules patterns, however many documents), expectation
maximisation on the counted patterns estimates the shares of good documents and of kinds of junk and how often
each rule votes each way on them, and a document's verdict is its posterior probability of being good.

Defined cases: a null text is empty (no words; base_failed). An empty table
gives no rows. Repeated rows are judged alike.
Columns other than those named are ignored unless listed in ``carry``; a
carried column may not have the name of a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, column, whole, words, written

#: Words in a window of which repeats count.
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_shouts", "n_distinct", "n_pipes"]


def statistics(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, the carried columns and the counts STATS and MORE of each whole text, all long.

    n_repeat_words counts the words that lie in a 5-word window found at least
    twice in the text. Windows are compared by 64-bit hashes within one text.
    """
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), *[F.col(f"`{c}`") for c in carry if c != "doc_id"], whole(column(docs, "text", "string")).alias("_t"))
    own = ["doc_id", *[f"`{c}`" for c in carry if c != "doc_id"]]
    split = base.select(*own, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"))
    counted = split.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("_t", F.lit(r"\|")).cast("long").alias("n_pipes"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )

    def joined(a: str, b: str, shift: int) -> Column:
        n = F.greatest(F.size(b) - shift, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))

    two = counted.withColumn("_2", joined("_h", "_h", 1)).withColumn("n_distinct", F.size(F.array_distinct("_h")).cast("long"))
    four = two.withColumn("_4", joined("_2", "_2", 2))
    five = four.withColumn("_5", joined("_4", "_h", WINDOW - 1)).drop("_2", "_4", "_h")
    again = F.size("_5") > F.size(F.array_distinct("_5"))
    placed = five.withColumn("_s", F.when(again, F.sort_array(F.transform("_5", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))

    def same(e: Column, i: Column, step: int) -> Column:
        return F.coalesce(F.get("_s", i + step)["h"] == e["h"], F.lit(False))

    dups = placed.withColumn("_p", F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(F.filter("_s", lambda e, i: same(e, i, -1) | same(e, i, 1)), lambda e: e["p"]))))
    gaps = F.zip_with(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x))
    return dups.select(*own, *STATS[:4], covered.cast("long").alias("n_repeat_words"), *MORE)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bad(bad: Column) -> Column:
    """A sign of junk votes bad; its absence says nothing."""
    return F.when(bad, F.lit(-1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes over the counts of ``statistics``. Ratios are per word, or per line or character where named so."""
    c = F.col
    long_enough = c("n_words") >= 40
    return {
        "length": F.when(c("n_words") < 10, -1).when(c("n_words") >= 20, 1).otherwise(0),
        "variety": F.when(long_enough & (5 * c("n_distinct") < c("n_words")), -1).when(long_enough & (3 * c("n_distinct") > c("n_words")), 1).otherwise(0),
        "repeats": _bad(5 * c("n_repeat_words") > c("n_words")),
        "symbols": _bad(5 * c("n_symbols") > c("n_words")),
        "lines": _bad(2 * c("n_dup_lines") > c("n_lines")),
        "word_length": _bad((c("word_chars") > 14 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        "capitals": _bad(10 * c("n_upper") > 3 * c("word_chars")),
        "shouting": _bad(5 * c("n_shouts") > c("n_words")),
        "tables": _bad(5 * c("n_pipes") > c("n_words")),
    }


#: What kind of junk each rule tells first of all.
KINDS = {"length": "form", "word_length": "form", "symbols": "form", "tables": "form", "variety": "repetition", "repeats": "repetition", "lines": "repetition", "capitals": "shouting", "shouting": "shouting"}
#: Where estimation starts: the chances of a bad vote, an abstention and a good vote from good documents, from junk of a rule's own kind and from other junk.
GOOD, OWN, OTHER = (0.02, 0.48, 0.5), (0.5, 0.3, 0.2), (0.05, 0.48, 0.47)
#: The share of good documents that it starts from, and how many documents a kind the start counts for.
SHARE, PSEUDO = 0.8, 10.0


def fit(patterns: list[tuple[tuple[int, ...], int]], kinds: list[str], rounds: int = 300) -> list[tuple[float, list[tuple[float, float, float]]]]:
    """For good documents, then for each kind of junk: the logarithm of its share, and those of the chances of each rule's bad vote, abstention and good vote.

    Expectation maximisation over (votes, count) patterns; kinds names each rule's own kind. Junk is of several
    kinds, as rules of one kind say nothing of another. All chances and shares are free: what tells good from bad are the start values,
    which PSEUDO documents a kind stand for besides. It ends when the likelihood no longer rises. Without rows the start stands.
    """
    names = sorted(set(kinds))
    start = [[GOOD for _ in kinds], *[[OWN if of == k else OTHER for of in kinds] for k in names]]
    shares = [SHARE, *[(1 - SHARE) / len(names)] * len(names)]
    model = [(math.log(s), [tuple(map(math.log, c)) for c in chances]) for s, chances in zip(shares, start, strict=True)]
    total, was = sum(n for _, n in patterns), -math.inf
    for _ in range(rounds if total else 0):
        held = [PSEUDO] * len(model)
        seen = [[[PSEUDO * x for x in c] for c in chances] for chances in start]
        likelihood = 0.0
        for votes, n in patterns:
            logs = [log + sum(c[v + 1] for c, v in zip(chances, votes, strict=True)) for log, chances in model]
            top = max(logs)
            each = [math.exp(x - top) for x in logs]
            likelihood += n * (math.log(sum(each)) + top)
            for k, x in enumerate(each):
                part = n * x / sum(each)
                held[k] += part
                for of, v in zip(seen[k], votes, strict=True):
                    of[v + 1] += part
        model = [(math.log(h / sum(held)), [tuple(math.log(x / sum(c)) for x in c) for c in chances]) for h, chances in zip(held, seen, strict=True)]
        if likelihood - was < 1e-9 * abs(likelihood):
            break
        was = likelihood
    return model


def quality_rules(docs: DataFrame, carry: list[str] = (), min_posterior: float = 0.5) -> DataFrame:
    """doc_id, the carried columns, the counts, base_failed, one vote_ column a rule, posterior (probability of good) and kept.

    kept is false where base_failed, else posterior >= min_posterior.
    """
    votes = rules()
    names = [f"vote_{k}" for k in votes]
    judged = written(statistics(docs, carry).withColumns({f"vote_{k}": v for k, v in votes.items()}), "votes")
    # At most 3 ** len(rules) rows, whatever the table's size.
    patterns = [(tuple(r[:-1]), r[-1]) for r in judged.groupBy(*names).count().orderBy(*names).collect()]
    (good, of_good), *junk = fit(patterns, [KINDS[k] for k in votes])
    # How much likelier each kind of junk is than a good document.
    worse = F.lit(0.0)
    for share, chances in junk:
        odds = F.lit(share - good)
        for name, bad, fine in zip(names, chances, of_good, strict=True):
            odds = odds + F.element_at(F.array(*[F.lit(b - g) for b, g in zip(bad, fine, strict=True)]), F.col(name) + 2)
        worse = worse + F.exp(odds)
    return (
        judged.withColumn("posterior", 1 / (1 + worse))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
    )
