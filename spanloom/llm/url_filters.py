"""URL filters: rules on hosts and paths, with DataFrame functions only.

The listed canonical URLs (host and path of a rule, scheme and port aside) go
into a blocked Bloom filter: a key sets a few bits of one 64-bit block. Of each
URL the keys that a rule could have (its host and parent hosts, its path's
prefixes of the lengths that rules have) are tried against the filter; those
that pass go to an exact hash join with the rules, which removes false
positives. URLs of which no key passes are done without a shuffle.

The longest fitting rule decides; without one a URL is allowed, which is this method's own verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
which only an explicit rule for the empty host would fit. A host is everything
up to the path, so a port is part of it. Repeated rows come back as often as
they are there. Rules that repeat a key count once (block before allow). Empty
tables and empty rule lists give no rows and no rules. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
#: Bits set for a key, filter bits for a listed key, and the most 64-bit blocks of a filter (1 MB).
BITS, BITS_A_KEY, MAX_BLOCKS = 4, 16, 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ://; the host has A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _mask(hashed: Column) -> Column:
    """BITS bits of a 64-bit block, by six bits of the hash each."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 6 * BITS), F.lit(blocks))


def bloom(keys: DataFrame, listed: int) -> list[int]:
    """The filter of a column ``key`` as its blocks: at most MAX_BLOCKS, however long the list."""
    blocks = max(1, min(MAX_BLOCKS, math.ceil(listed * BITS_A_KEY / 64)))
    h = F.xxhash64("key")
    filled = keys.groupBy(_block(h, blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("bits")).collect()
    out = [0] * blocks
    for r in filled:
        out[r["b"]] = r["bits"]
    return out


def _passes(key: Column, blocks: list[int]) -> Column:
    h = F.xxhash64(key)
    # One constant, however many blocks.
    table = F.from_json(F.lit(str(blocks)), "array<bigint>")
    mask = _mask(h)
    return F.get(table, _block(h, len(blocks)).cast("int")).bitwiseAND(mask) == mask


def _keys(host: Column, path: Column, depths: Iterable[int], lengths: Iterable[int]) -> Column:
    """host + path of every rule that could fit: parent hosts of as many labels, path prefixes of as many characters, as rules have."""
    hosts = [F.when(F.size(F.split(host, r"\.")) >= d, F.substring_index(host, ".", -d)) for d in depths]
    paths = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    # \x00 separates them: neither holds it in a rule.
    return F.filter(F.array(*[F.concat(h, F.lit("\0"), p) for h in hosts for p in paths]), lambda k: k.isNotNull())


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; rules: host, path, verdict (as RULES where None)."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(host, path, verdict)")
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("key", F.concat("host", F.lit("\0"), "path")).withColumn("rule", F.concat("host", "path"))
    # Distinct numbers of labels and of characters, not the rules themselves.
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("depths"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    blank = [F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict")]
    if not shape["n"]:
        return urls.select("page_id", "host", "path", *blank)
    blocks = bloom(rules.select("key"), shape["n"])
    tried = urls.withColumn("_hits", F.filter(_keys(F.col("host"), F.col("path"), sorted(shape["depths"]), sorted(shape["lengths"])), lambda k: _passes(k, blocks)))
    passed = tried.filter(F.size("_hits") > 0)
    # The row itself goes along as a hit without a rule: it counts how often equal rows are there.
    hits = passed.select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), "_hits")).alias("key"))
    found = hits.join(rules.select("key", "rule", F.col("verdict").alias("_v")), "key", "left")
    best = found.groupBy("page_id", "host", "path").agg(
        F.count_if(F.col("key").isNull()).alias("_n"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("l"), "rule", "_v"))).alias("_best"),
    )
    ruled = best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best._v", F.lit(DEFAULT)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")).drop("_copy")
    return ruled.unionByName(tried.filter(F.size("_hits") == 0).select("page_id", "host", "path", *blank))


#: The same by trying every rule on every URL.
ORACLE_SQL = """
WITH rules(host, path, verdict) AS (VALUES {rules}),
u AS (
  SELECT row_number() OVER () AS i, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), m AS (
  SELECT p.i, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.i ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, '{default}') AS verdict
FROM p LEFT JOIN m ON m.i = p.i AND m.k = 1
""".format(rules=", ".join(str(r) for r in RULES), default=DEFAULT)
