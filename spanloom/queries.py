"""Registered queries of the engine and the SQL that each must equal; every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks
from .functions.drawing import seed
from .functions.text import scrubbed, windows
from .operators import addresses, analytics, checksummed, detect, dictionary, evaluate, gates, labels, memory, merge, replay, reports, restoring, rewrite, scope, skeleton
from .operators.rules import PORTABLE, catalogue
from .sources import files, tabular

QUERIES: dict = {}
ORACLES: dict = {}

#: Rules whose spans never overlap.
APART = [r for r in PORTABLE if r.category != "card"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, for work that is bound by the processor."""
    return detect.spread(_t(spark, sf_dir, name))


def _luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    x = f"CAST({d}[length({d}) - i] AS INTEGER)"
    return f"(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {x} - CASE WHEN 2 * {x} > 9 THEN 9 ELSE 0 END ELSE {x} END)) % 10 = 0)"


#: SQL of what a rule's value must pass.
_CHECKED = {
    "card": f"AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND NOT regexp_matches(value, '^[0 -]+$') AND {_luhn('value')}",
    "ipv4": "AND list_bool_and(list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INTEGER) <= 255))",
}


def _spans(table: str, text: str, keys: str, rules=PORTABLE) -> str:
    """SQL of all spans: keys, type, category, rank, value."""
    parts = [
        f"SELECT {keys}, '{r.type}' AS type, '{r.category}' AS category, {i} AS rank, value FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '{r.pattern}')) AS value FROM {table}) WHERE value <> '' {_CHECKED.get(r.check, '')}"
        for i, r in enumerate(rules)
    ]
    return " UNION ALL ".join(parts)


def _doc_spans(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return detect.spans(_texts(spark, sf_dir), PORTABLE, *keys, resolve=False)


@query(f"SELECT category, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM ({_spans('documents', 'text', 'doc_id')}) GROUP BY category")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_spans(spark, sf_dir, "doc_id").groupBy("category").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT lang, category, count(*) AS spans FROM ({_spans('documents', 'text', 'lang')}) GROUP BY lang, category")
def pii_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_spans(spark, sf_dir, "lang").groupBy("lang", "category").agg(F.count("*").alias("spans"))


@query(f"SELECT lower(string_split(value, '@')[2]) AS domain, count(*) AS n FROM ({_spans('documents', 'text', 'doc_id')}) WHERE type = 'email' GROUP BY 1")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _doc_spans(spark, sf_dir, "doc_id").filter("type = 'email'")
    return found.groupBy(F.lower(F.split("value", "@")[1]).alias("domain")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS runs, count(*) FILTER ({_luhn('value')}) AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS value FROM documents) GROUP BY doc_id")
def card_luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), 0)).alias("value")).filter("value is not null")
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.count_if(checks.luhn(F.col("value"))).alias("valid"))


@query(
    f"""SELECT CASE WHEN starts_with(value, '127.') THEN 'loopback' WHEN starts_with(value, '10.') OR starts_with(value, '192.168.') OR regexp_matches(value, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 'private'
    WHEN starts_with(value, '169.254.') THEN 'link_local' WHEN CAST(string_split(value, '.')[1] AS INTEGER) >= 224 OR starts_with(value, '0.') THEN 'reserved' ELSE 'public' END AS class, count(*) AS n
    FROM ({_spans('documents', 'text', 'doc_id')}) WHERE type = 'ipv4' GROUP BY 1"""
)
def ip_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    kind = (
        F.when(v.startswith("127."), "loopback")
        .when(v.startswith("10.") | v.startswith("192.168.") | v.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), "private")
        .when(v.startswith("169.254."), "link_local")
        .when((F.split(v, r"\.")[0].cast("int") >= 224) | v.startswith("0."), "reserved")
        .otherwise("public")
    )
    return _doc_spans(spark, sf_dir, "doc_id").filter("type = 'ipv4'").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS secrets, count(DISTINCT value) AS distinct_secrets FROM ({_spans('documents', 'text', 'doc_id')}) WHERE category = 'secret' GROUP BY doc_id")
def secret_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_spans(spark, sf_dir, "doc_id").filter("category = 'secret'").groupBy("doc_id").agg(F.count("*").alias("secrets"), F.countDistinct("value").alias("distinct_secrets"))


@query(f"SELECT CASE WHEN category IN ('email', 'phone') THEN 'contact' WHEN category = 'card' THEN 'payment' WHEN category = 'ip' THEN 'network' ELSE 'credential' END AS kind, count(*) AS n FROM ({_spans('documents', 'text', 'doc_id')}) GROUP BY 1")
def category_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("category").isin("email", "phone"), "contact").when(F.col("category") == "card", "payment").when(F.col("category") == "ip", "network").otherwise("credential")
    return _doc_spans(spark, sf_dir, "doc_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH s AS ({_spans('documents', 'text', 'doc_id')}), n AS (SELECT category, count(*) AS n FROM s GROUP BY 1) SELECT category, n, CAST(floor(n / (SELECT max(n) FROM n) * 7 + 0.5) AS BIGINT) AS level FROM n ORDER BY n DESC LIMIT 8")
def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.levels(_doc_spans(spark, sf_dir, "doc_id").groupBy("category").agg(F.count("*").alias("n")), "category", "n")


@query(f"SELECT category, count(DISTINCT lower(value)) AS entries, count(DISTINCT doc_id) AS docs FROM ({_spans('documents', 'text', 'doc_id')}) GROUP BY category")
def vault_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_spans(spark, sf_dir, "doc_id").groupBy("category").agg(F.countDistinct(F.lower("value")).alias("entries"), F.countDistinct("doc_id").alias("docs"))


@query()
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue: spans by type. Lookarounds keep it out of SQL; tests hold each rule against examples."""
    return detect.spans(_texts(spark, sf_dir), catalogue(), "doc_id").groupBy("type", "category").agg(F.count("*").alias("spans"))


def _claims() -> str:
    """SQL of the documents' spans that keep their characters, p: doc_id, text, rank, label, value, start, stop; and m: with their placeholders."""
    def found(i: int) -> str:
        r = PORTABLE[i]
        label = rewrite.LABELS.get(r.type, r.type.upper())
        split = f"string_split(regexp_replace(text, '({r.pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
        return f"""SELECT doc_id, text, {i} AS rank, '{label}' AS label, value, start, start + length(value) AS stop FROM (SELECT *, sum(length(value)) OVER (PARTITION BY doc_id ORDER BY k) - length(value) AS start
        FROM (SELECT doc_id, text, unnest(l) AS value, unnest(range(len(l))) AS k FROM (SELECT doc_id, text, {split} AS l FROM documents))) WHERE k % 2 = 1 AND value <> '' {_CHECKED.get(r.check, '')}"""

    free = "NOT EXISTS (SELECT 1 FROM p{0} q WHERE q.doc_id = x.doc_id AND q.start < x.stop AND x.start < q.stop)"
    steps = [f"p0 AS ({found(0)})", *[f"p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM ({found(i)}) x WHERE {free.format(i - 1)})" for i in range(1, len(PORTABLE))]]
    return ", ".join(steps) + f"""
    , p AS (SELECT * FROM p{len(PORTABLE) - 1}), e AS (SELECT doc_id, label, value, row_number() OVER (PARTITION BY doc_id, label ORDER BY min([rank, start])) AS n FROM p GROUP BY 1, 2, 3),
    m AS (SELECT p.*, '[REDACTED_' || p.label || '_' || n || ']' AS placeholder, coalesce(lag(stop) OVER w, 0) AS before, lead(start) OVER w IS NULL AS last FROM p JOIN e USING (doc_id, label, value) WINDOW w AS (PARTITION BY p.doc_id ORDER BY start))"""


_PARTS = """SELECT doc_id, start, 0 AS k, 'text' AS kind, substr(text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) AS value, placeholder FROM m UNION ALL SELECT doc_id, start, 1, 'redaction', value, placeholder FROM m
    UNION ALL SELECT doc_id, stop, 2, 'text', substr(text, CAST(stop + 1 AS BIGINT)), NULL FROM m WHERE last UNION ALL SELECT doc_id, 0, 0, 'text', text, NULL FROM documents d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id)"""


@query(
    f"""WITH {_claims()}, t AS ({_PARTS}) SELECT doc_id, string_agg(CASE kind WHEN 'text' THEN value ELSE placeholder END, '' ORDER BY start, k) AS redacted, count(DISTINCT placeholder) FILTER (kind = 'redaction') AS entries FROM t GROUP BY doc_id"""
)
def redacted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.redact(_texts(spark, sf_dir), PORTABLE)
    return out.select("doc_id", "redacted", F.size("vault").alias("entries"))


@query(f"WITH {_claims()}, t AS ({_PARTS}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, k) - 1 AS nth, kind, value FROM t WHERE kind = 'redaction' OR value <> ''")
def redaction_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.redact(_texts(spark, sf_dir), PORTABLE)
    return out.select("doc_id", F.posexplode_outer(rewrite.segments(F.col("text"), F.col("spans"))).alias("nth", "segment")).filter("segment is not null").select("doc_id", "nth", "segment.*")


@query(
    f"""WITH s AS ({_spans('documents', 'text', 'doc_id, text', APART)}), v AS (SELECT doc_id, category, value, min(rank) AS rank, min(instr(text, value)) AS pos FROM s GROUP BY doc_id, category, value)
    SELECT doc_id, '[' || upper(category) || row_number() OVER (PARTITION BY doc_id, category ORDER BY rank, pos) || ']' AS placeholder, value, category FROM v"""
)
def token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.redact(_texts(spark, sf_dir), APART, style="token")
    return out.select("doc_id", F.explode_outer("vault").alias("_e")).filter("_e is not null").select("doc_id", "_e.*")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.redact(_texts(spark, sf_dir), PORTABLE)
    return out.select("doc_id", F.md5(rewrite.restore(F.col("redacted"), F.col("vault"))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def fake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced by substitutes of their shape, and restored."""
    out = rewrite.redact(_texts(spark, sf_dir), PORTABLE, style="fake", key="benchmark key")
    return out.select("doc_id", F.md5(rewrite.restore(F.col("redacted"), F.col("vault"))).alias("digest"))


#: Disguises by a document's id: characters that are not shown beside @ and dots, full-width digits, Arabic-Indic digits.
_WIDE, _ARABIC, _NONE, _JOINER = "０１２３４５６７８９", "٠١٢٣٤٥٦٧٨٩", "\u200b", "\u2060"


def _dressed(v: str) -> str:
    return f"CASE doc_id % 3 WHEN 0 THEN replace(replace({v}, '@', '{_NONE}@'), '.', '.{_JOINER}') WHEN 1 THEN translate({v}, '0123456789', '{_WIDE}') ELSE translate({v}, '0123456789', '{_ARABIC}') END"


@query(f"SELECT doc_id, type, {_dressed('value')} AS value FROM ({_spans('documents', 'text', 'doc_id')})")
def skeleton_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in disguise: values are found all the same, and are given as the texts write them."""
    docs = _texts(spark, sf_dir).withColumn("text", F.expr(_dressed("text")))
    found = skeleton.with_mapped_spans(docs, PORTABLE)
    return found.select("doc_id", F.explode_outer("spans").alias("_s")).filter("_s is not null").select("doc_id", "_s.type", "_s.value")


@query(f"WITH s AS ({_spans('documents', 'text', 'doc_id')}) SELECT doc_id, type, value FROM s WHERE lower(trim(value)) NOT IN (SELECT lower(trim(value)) FROM s WHERE doc_id % 10 = 0)")
def keep_list_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _doc_spans(spark, sf_dir, "doc_id")
    return detect.without(found, found.filter("doc_id % 10 = 0").select("value")).select("doc_id", "type", "value")


@query()
def url_zone_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of pages that stand outside URLs somewhere, or are of a kind that URLs don't excuse."""
    pages = _texts(spark, sf_dir, "pages")
    found = detect.spans(pages, PORTABLE, "page_id", text="html", resolve=False)
    zones = detect.spans(pages, [r for r in catalogue() if r.type == "url"], "page_id", text="html")
    return detect.outside(found, zones, "page_id", exempt=("secret", "card", "iban", "national_id", "email", "phone")).select("page_id", "type", "value", "start")


@query(f"SELECT category, count(*) AS spans, count(DISTINCT page_id) AS pages FROM ({_spans('pages', 'html', 'page_id')}) GROUP BY category")
def html_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.spans(_texts(spark, sf_dir, "pages"), PORTABLE, "page_id", text="html", resolve=False)
    return found.groupBy("category").agg(F.count("*").alias("spans"), F.countDistinct("page_id").alias("pages"))


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_mktsegment: ' || c_mktsegment AS record FROM customer")
def tabular_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", tabular.annotate(c, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("record"))


@query("SELECT r_name AS path, line, record FROM (SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS line, 'key: ' || n_nationkey || ' | nation: ' || n_name AS record FROM nation JOIN region ON n_regionkey = r_regionkey)")
def delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's nations as a delimited file with a quoted column, and read back."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit(';"'), F.col("n_name"), F.lit('"'))
    lines = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("_l"))
    files_ = lines.select("path", F.concat(F.lit("key;nation\r\n"), F.array_join(F.transform("_l", lambda x: x["row"]), "\r\n")).alias("text"))
    return tabular.records(files_).select("path", F.col("line").cast("long").alias("line"), "record")


@query(
    """WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS series, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT max(day) AS e FROM c),
    k AS (SELECT DISTINCT series FROM c), d AS (SELECT CAST(e - CAST(i AS INTEGER) AS DATE) AS day FROM e, range(14) t(i))
    SELECT CAST(d.day AS VARCHAR) AS day, k.series, coalesce(c.n, 0) AS n FROM d CROSS JOIN k LEFT JOIN c ON c.day = d.day AND c.series = k.series"""
)
def daily_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily(_t(spark, sf_dir, "events"), "ts", "event_type", 14).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS series, count(*) AS total FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, series) AS k FROM t)
    SELECT CASE WHEN k <= 5 THEN series ELSE '__other__' END AS series, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY 1"""
)
def top5_other_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_series(_t(spark, sf_dir, "events"), "user_id", F.lit(1))


_LOG = "SELECT event_type AS origin, CAST(user_id % 7 AS VARCHAR) AS source, CASE WHEN value < 20 THEN 'refused' ELSE 'allowed' END AS verdict, props AS reason, ts AS moment FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("origin"), (F.col("user_id") % 7).cast("string").alias("source"), F.when(F.col("value") < 20, "refused").otherwise("allowed").alias("verdict"), F.col("props").alias("reason"), F.col("ts").alias("at"))


@query(
    f"""WITH l AS ({_LOG}) SELECT origin, count(*) AS contacts, count(*) FILTER (verdict = 'refused') AS refused, max(moment) AS last_at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    arg_max(reason, moment) FILTER (verdict = 'refused') AS last_reason FROM l GROUP BY origin"""
)
def egress_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.egress_groups(_log(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH l AS ({_LOG}) SELECT count(DISTINCT origin) AS origins, count(*) AS contacts, count(*) FILTER (verdict = 'refused') AS refused FROM l")
def egress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.egress_summary(analytics.egress_groups(_log(spark, sf_dir)))


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def lww_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(_t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_id, user_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.user_id = e.user_id AND (t.ts > e.ts OR t.ts = e.ts AND t.event_id >= e.event_id))")
def tombstone_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return merge.without_tombstones(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query(
    """WITH v AS (SELECT user_id AS scope, event_type AS placeholder, props AS value, ts AS first_seen, event_id % 2 AS rank FROM events)
    SELECT scope, placeholder, (SELECT min(w.value) FROM v w WHERE w.scope = v.scope AND w.placeholder = v.placeholder AND w.rank = min(v.rank)) AS value, min(first_seen) AS first_seen FROM v GROUP BY scope, placeholder"""
)
def vault_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    v = e.select(F.col("user_id").alias("scope"), F.col("event_type").alias("placeholder"), F.col("props").alias("value"), F.col("ts").alias("first_seen"), "event_id")
    return merge.merged_vaults(v.filter("event_id % 2 = 0").drop("event_id"), v.filter("event_id % 2 = 1").drop("event_id"))


@query(
    """WITH a AS (SELECT user_id AS account, 1 + user_id % 3 AS seats FROM events GROUP BY 1), u AS (SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS used FROM events
    WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT account, seats * 300 AS allotted, coalesce(used, 0) AS used, seats * 300 - coalesce(used, 0) AS balance, coalesce(used, 0) >= seats * 300 AS blocked FROM a LEFT JOIN u ON account = user_id"""
)
def credit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    day = lambda d: F.lit(d).cast("timestamp")
    accounts = e.select(F.col("user_id").alias("account")).distinct().select("account", (1 + F.col("account") % 3).alias("seats"), F.lit(300).alias("allotment"), day("2024-01-10").alias("period_start"), day("2024-01-20").alias("period_end"))
    usage = e.select(F.col("user_id").alias("account"), F.floor("value").alias("credits"), (F.col("event_type") == "purchase").alias("billable"), F.col("ts").alias("at"))
    return analytics.credit_balance(accounts, usage)


@query("SELECT event_id, CAST(ceil(round(((event_id * 37 % 100000) * 3.0::DOUBLE + (event_id * 11 % 5000) * 15.0::DOUBLE) / 1000000 * 0.92::DOUBLE * 100, 6)) AS BIGINT) AS cents FROM events")
def cost_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", analytics.cost_cents(i * 37 % 100_000, i * 11 % 5_000, F.lit(3.0), F.lit(15.0)).alias("cents"))


@query("SELECT item_id AS id, CAST(contains(lower(text), 'than') AS INTEGER) + CAST(contains(lower(text), 'inble') AS INTEGER) + CAST(contains(lower(text), 'oushly') AS INTEGER) AS score, item_id AS \"at\" FROM benchmark WHERE score > 0 ORDER BY score DESC, item_id DESC LIMIT 4")
def memory_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("at"))
    return memory.lexical(cards, ["than", "inble", "oushly"])


_FILES = "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN (vec_id % 7) / 7.0::DOUBLE ELSE 0 END AS lexical, CAST(embedding[1] AS DOUBLE) AS cosine FROM embeddings"


@query(
    f"""WITH f AS ({_FILES}), s AS (SELECT id, round(CASE WHEN lexical > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * lexical ELSE 0.5::DOUBLE * (cosine - (SELECT min(cosine) FROM f)) / ((SELECT max(cosine) FROM f) - (SELECT min(cosine) FROM f)) END, 6) AS rank_score FROM f)
    SELECT id, rank_score, row_number() OVER (ORDER BY rank_score DESC, id) AS nth FROM s ORDER BY nth LIMIT 10"""
)
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return memory.hybrid(e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 0, (F.col("vec_id") % 7) / F.lit(7.0)).otherwise(0.0).alias("lexical"), F.element_at("embedding", 1).cast("double").alias("cosine")))


_COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


@query(
    f"""SELECT * FROM (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_COSINE.format(a='q.embedding', b='r.embedding')} AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format(a='q.embedding', b='r.embedding')} DESC, r.vec_id) AS nth FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE nth <= 10"""
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return memory.nearest(e, e.filter("vec_id % 100 = 0"))


#: The test vectors are nearly at random, so that their most similar pairs lie about here; for real embeddings 0.95 is a usual bound.
LIKE = 0.35


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, x.label, {_COSINE.format(a='x.embedding', b='y.embedding')} AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE similarity >= {LIKE}")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.similar_pairs(_t(spark, sf_dir, "embeddings"), LIKE, "label")


@query(
    f"""WITH RECURSIVE l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE {_COSINE.format(a='x.embedding', b='y.embedding')} >= {LIKE}),
    r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a) SELECT id, min(other) AS cluster FROM r GROUP BY id"""
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return memory.clusters(e.select(F.col("vec_id").alias("id")), memory.similar_links(e, LIKE, "label"))


@query(
    """WITH RECURSIVE c AS (SELECT label, vec_id AS id, vec_id * 7919 % 1009 AS score, vec_id * 31 % 500 + 20 AS size FROM embeddings),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS k FROM c),
    w AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS taken, NULL::BIGINT AS id FROM (SELECT DISTINCT label FROM o)
          UNION ALL SELECT o.label, o.k, CASE WHEN w.used + o.size <= 4000 THEN w.used + o.size ELSE w.used END, CASE WHEN w.used + o.size <= 4000 THEN 1 ELSE 0 END, o.id FROM w JOIN o ON o.label = w.label AND o.k = w.k + 1)
    SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY k) - 1 AS nth, max(used) OVER (PARTITION BY label) AS used FROM w WHERE taken = 1"""
)
def memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice within a budget, by label."""
    e = _t(spark, sf_dir, "embeddings")
    return memory.budgeted(e.select("label", F.col("vec_id").alias("id"), (F.col("vec_id") * 7919 % 1009).alias("score"), (F.col("vec_id") * 31 % 500 + 20).alias("size")), "label", 4000)


def _intervals(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").filter(i % 2 == parity).select("user_id", (i * 13 % 3000).alias("start"), (i * 13 % 3000 + i % 17 + 1).alias("end"), F.col("event_type").alias("entity"))


_CHARS = "SELECT DISTINCT user_id, unnest(range(event_id * 13 % 3000, event_id * 13 % 3000 + event_id % 17 + 1)) AS c FROM events WHERE event_id % 2 = {}"


@query(
    f"""WITH p AS ({_CHARS.format(0)}), g AS ({_CHARS.format(1)}), t AS (SELECT count(*) AS tp FROM p JOIN g USING (user_id, c)), n AS (SELECT tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng FROM t)
    SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM n"""
)
def char_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.character_f1(_intervals(spark, sf_dir, 0), _intervals(spark, sf_dir, 1), "user_id")


@query(
    f"""WITH p AS ({_CHARS.format(0)}), g AS (SELECT DISTINCT user_id, event_type AS entity, event_id * 13 % 3000 AS s, event_id * 13 % 3000 + event_id % 17 + 1 AS e FROM events WHERE event_id % 2 = 1),
    k AS (SELECT g.user_id, g.entity, g.s, g.e, count(p.c) AS k FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.c >= g.s AND p.c < g.e GROUP BY 1, 2, 3, 4),
    m AS (SELECT user_id, entity, k = e - s AS hit FROM k),
    n AS (SELECT user_id, entity, count(*) AS n, bool_and(hit) AS whole FROM m GROUP BY 1, 2)
    SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS entities, CAST(count(*) FILTER (whole) AS BIGINT) AS complete FROM n GROUP BY 1"""
)
def mention_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mention_consistency(_intervals(spark, sf_dir, 1), _intervals(spark, sf_dir, 0), "user_id")


@query(
    """WITH c AS (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS cost FROM conversations), r AS (SELECT *, sum(cost) OVER w AS total, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
    f AS (SELECT *, min(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM r WHERE total <= 300 OR k = 1)
    SELECT conv_id, turn, role, cost, CAST(total AS BIGINT) AS total FROM f WHERE turn >= first OR k = 1"""
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.history_window(_t(spark, sf_dir, "conversations"), 300, F.ceil(F.length("text") / 4) + 4)


@query("SELECT CASE WHEN n_chars <= 80000 THEN 'ok' WHEN n_chars <= 1000000 THEN 'long' ELSE 'refuse' END AS plan, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def mask_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy(analytics.mask_plan(F.col("n_chars")).alias("plan")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """WITH m AS (SELECT event_id, 'user' || user_id || '@example.com failed at /srv/app/' || event_type || ' with code ' || (user_id % 5) AS message FROM events WHERE event_type = 'error' OR event_type = 'signup'),
    s AS (SELECT event_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '(?:/[A-Za-z0-9._-]+){2,}', '<path>', 'g'), '[0-9a-fA-F]{16,}', '<token>', 'g'), '[0-9]+', '<n>', 'g'), 1, 200) AS signature FROM m)
    SELECT * FROM (SELECT event_id, signature, row_number() OVER (PARTITION BY signature ORDER BY event_id) AS nth FROM s) WHERE nth <= 5"""
)
def error_signature_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    message = F.concat(F.lit("user"), "user_id", F.lit("@example.com failed at /srv/app/"), "event_type", F.lit(" with code "), (F.col("user_id") % 5).cast("string"))
    return analytics.capped(e.select("event_id", message.alias("message")), scrubbed(F.col("message")), "event_id").select("event_id", "signature", "nth")


@query(
    """WITH n AS (SELECT lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM orders), w AS (SELECT d, list_transform(range(9), lambda i: CAST(d[i + 1] AS INTEGER)) AS x FROM n)
    SELECT count(*) FILTER (list_sum(list_transform(range(9), lambda i: x[i + 1] * [9, 8, 7, 6, 5, 4, 3, 2, -1][i + 1])) % 11 = 0 AND d <> '000000000') AS bsn,
           count(*) FILTER (list_sum(list_transform(range(9), lambda i: x[i + 1] * [3, 7, 1, 3, 7, 1, 3, 7, 1][i + 1])) % 10 = 0 AND d <> '000000000') AS aba,
           count(*) FILTER (list_sum(list_transform(range(9), lambda i: CASE WHEN i % 2 = 1 THEN 2 * x[i + 1] - CASE WHEN x[i + 1] > 4 THEN 9 ELSE 0 END ELSE x[i + 1] END)) % 10 = 0 AND d <> '000000000') AS siren,
           count(*) FILTER (substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 3) < '900' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000') AS ssn FROM w"""
)
def checksum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "orders").select(F.lpad((F.col("o_orderkey") * 7919 % 1_000_000_000).cast("string"), 9, "0").alias("d"))
    return n.agg(*[F.count_if(checks.CHECKS[k](F.col("d"))).alias(k) for k in ("bsn", "aba", "siren", "ssn")])


@query("SELECT doc_id, CAST(s AS INTEGER) AS start, length(substr(text, CAST(s + 1 AS BIGINT), 250)) AS length FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text), 1), 200)) AS s) WHERE s = 0 OR s + 50 < length(text)")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(windows(F.col("text"))).alias("_w")).select("doc_id", "_w.start", F.length("_w.part").cast("long").alias("length"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text FROM conversations")
def chat_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues written as another program's export, and read back."""
    c = _t(spark, sf_dir, "conversations")
    message = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.col("text").alias("text"))
    exports = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    written = exports.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("uuid"), "chat_messages")).alias("export"))
    return files.flat_chats(written)


_VAULT = "SELECT conv_id, string_split(text, ' ')[1] AS value, role AS category FROM conversations"


def _conversation_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each turn as a vault entry: the test conversations hold no sensitive values."""
    return _t(spark, sf_dir, "conversations").select("conv_id", F.split("text", " ")[0].alias("value"), F.col("role").alias("category"))


@query(
    f"""WITH v AS (SELECT DISTINCT * FROM ({_VAULT}) WHERE length(value) > 0), m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
    SELECT category, count(DISTINCT (m.conv_id, m.turn)) AS messages, count(*) AS mentions FROM m JOIN v ON v.conv_id = m.conv_id AND contains(m.text, v.value) GROUP BY category"""
)
def message_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_breakdown(_t(spark, sf_dir, "conversations").filter("role = 'user'"), _conversation_vault(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT conv_id, category, count(DISTINCT value) AS n FROM ({_VAULT}) GROUP BY 1, 2)
    SELECT conv_id, CAST(sum(n) AS BIGINT) AS total, string_agg(category || '=' || n, ',' ORDER BY category) AS kinds FROM c GROUP BY conv_id"""
)
def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversation_events(_conversation_vault(spark, sf_dir))


@query(
    """WITH k AS (SELECT p_brand AS category, min(p_name) AS value, regexp_replace(lower(p_name), '[\\s._-]+', '', 'g') AS k FROM part GROUP BY 1, 3),
    w AS (SELECT category, k, regexp_replace(lower(unnest(string_split_regex(value, '\\s+'))), '[\\s._-]+', '', 'g') AS w FROM k)
    SELECT category, count(*) AS entries FROM k WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM w WHERE w.category = k.category AND w.w = k.k AND w.k <> k.k) GROUP BY category"""
)
def protected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.protected_entries(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("value")))


@query(
    """WITH l AS (SELECT user_id AS conv_id, ts AS "at", event_id AS id, max(ts) OVER (PARTITION BY user_id) AS latest FROM events)
    SELECT conv_id, "at", id, nth FROM (SELECT *, row_number() OVER (ORDER BY latest DESC, conv_id, "at" DESC, id) - 1 AS nth FROM l) WHERE nth >= 40 AND nth < 60"""
)
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty rows: a limit that is the feature."""
    e = _t(spark, sf_dir, "events")
    return reports.audit_page(e.select(F.col("user_id").alias("conv_id"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 20, 2)


@query(
    """WITH u AS (SELECT user_id AS card, count(DISTINCT event_id % 50) AS conversations, max(ts) AS last_used FROM events WHERE event_type = 'purchase' GROUP BY 1),
    s AS (SELECT user_id AS card, max(ts) AS s FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(u.card, s.card) AS card, coalesce(conversations, 0) AS conversations, last_used, CASE WHEN last_used IS NULL OR s > last_used THEN s END AS skipped_since FROM u FULL JOIN s ON u.card = s.card"""
)
def usage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("card"), (F.col("event_id") % 50).alias("conv_id"), F.col("ts").alias("at"), "event_type")
    return reports.usage_index(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"))


@query(
    """SELECT "user", "group" FROM (SELECT o_custkey AS "user", o_orderkey AS "group", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k = 1"""
)
def first_active_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    members = o.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("group"))
    return reports.first_active(members, o.select(F.col("o_orderkey").alias("group"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") != "F").alias("active")))


@query("SELECT doc_id AS id, 'm' || doc_id % 3 AS model, sha256(coalesce(text, '')) AS text_hash FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 1")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter has no embedding, and of one model all were made of other texts."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), "text")
    stored = d.filter("id % 4 <> 0").select("id", "model", F.sha2(F.when(F.col("id") % 3 == 1, F.lit("before")).otherwise(F.coalesce("text", F.lit(""))), 256).alias("text_hash"))
    return reports.stale(d, stored)


@query(
    """WITH m AS (SELECT event_type, user_id % 3 AS "group", CAST(event_id % 5 < 3 AS INTEGER) AS tp, CAST(event_id % 5 = 3 AS INTEGER) AS fp, CAST(event_id % 5 = 4 AS INTEGER) AS fn FROM events),
    g AS (SELECT 'all' AS "by", '' AS value, tp, fp, fn FROM m UNION ALL SELECT 'event_type', event_type, tp, fp, fn FROM m UNION ALL SELECT 'group', CAST("group" AS VARCHAR), tp, fp, fn FROM m),
    s AS (SELECT "by", value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM g GROUP BY 1, 2)
    SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s"""
)
def grouped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 5
    marked = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("group"), (i < 3).cast("int").alias("tp"), (i == 3).cast("int").alias("fp"), (i == 4).cast("int").alias("fn"))
    return reports.grouped_rates(marked, "event_type", "group")


@query("SELECT DISTINCT id, neighbour FROM (SELECT user_id AS id, event_id % 97 AS neighbour FROM events UNION ALL SELECT event_id % 97, user_id FROM events) WHERE id <> neighbour")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.neighbours(_t(spark, sf_dir, "events").select(F.col("user_id").alias("a"), (F.col("event_id") % 97).alias("b")))


@query(
    """WITH l AS (SELECT item_id AS id, 0 AS tier, CAST(CAST(contains(text, 'than') AS INTEGER) + CAST(contains(text, 'inble') AS INTEGER) AS DOUBLE) AS score FROM benchmark WHERE contains(text, 'than') OR contains(text, 'inble')),
    s AS (SELECT item_id AS id, 1 AS tier, (item_id * 37 % 100) / 100.0::DOUBLE AS score FROM benchmark WHERE (item_id * 37 % 100) / 100.0::DOUBLE >= 0.88 AND item_id NOT IN (SELECT id FROM l))
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tier, score DESC, id) AS nth FROM (SELECT * FROM l UNION ALL SELECT * FROM s)) WHERE nth <= 12"""
)
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark")
    words = b.select(F.col("item_id").alias("id"), (F.contains("text", F.lit("than")).cast("int") + F.contains("text", F.lit("inble")).cast("int")).alias("score"))
    return reports.tiered_search(words, b.select(F.col("item_id").alias("id"), (F.col("item_id") * 37 % 100 / F.lit(100.0)).alias("cosine")), 12)


@query(
    """WITH e AS (SELECT event_id, ts, TIMESTAMP '2024-01-10' AS b, TIMESTAMP '2024-01-15' AS f FROM events)
    SELECT event_id, CASE WHEN ts >= b AND ts < f THEN b ELSE date_trunc('month', ts) END AS period_start, CASE WHEN ts >= b AND ts < f THEN f ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END AS period_end FROM e"""
)
def credit_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp")
    return _t(spark, sf_dir, "events").select("event_id", reports.credit_period(F.col("ts").cast("timestamp"), day("2024-01-10"), day("2024-01-15")).alias("_p")).select("event_id", "_p.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (1700000000 + o_orderkey)::DOUBLE ELSE (1700000000000 + o_orderkey)::DOUBLE / 1000 END AS seconds, trim(regexp_replace(reverse(CAST(o_orderkey * 12345 AS VARCHAR)), '([0-9]{3})', '\\1 ', 'g')) AS backwards FROM orders")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", reports.epoch_seconds(F.when(k % 2 == 0, k + 1_700_000_000).otherwise(k + 1_700_000_000_000)).alias("seconds"), F.reverse(reports.spaced_thousands(k * 12345)).alias("backwards"))


@query()
def gated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the catalogue after edge trims, line splits, de-nesting and the number gate, by category; tests hold each gate against a loop."""
    found = detect.with_spans(_texts(spark, sf_dir), catalogue()).select("doc_id", gates.numbers_with_meaning(gates.denested(gates.by_line(gates.trimmed(F.col("spans"))))).alias("spans"))
    rows = found.select("doc_id", F.explode_outer("spans").alias("_s")).filter("_s is not null")
    return rows.groupBy("_s.category").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))


def _replayed(text: str, pattern: str, mark: str) -> str:
    """SQL of a replacement between edges, made twice, since neighbours share an edge."""
    edge = "[^\\p{L}\\p{N}_]"
    once = lambda x: f"regexp_replace({x}, '(^|{edge})(?i:{pattern})($|{edge})', '\\1{mark}\\2', 'g')"
    return once(once(text))


@query(f"SELECT doc_id, {_replayed(_replayed(_replayed('text', 'of[[:space:]._-]*the', '[TERM1]'), 'inble', '[TERM2]'), 'than', '[TERM3]')} AS replayed FROM documents")
def replay_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values become placeholders again, whatever their case and separators."""
    entry = lambda p, v: F.struct(F.lit(p).alias("placeholder"), F.lit(v).alias("value"))
    vault = F.array(entry("[TERM3]", "than"), entry("[TERM1]", "of the"), entry("[TERM2]", "inble"))
    return _texts(spark, sf_dir).select("doc_id", replay.replayed(F.col("text"), vault).alias("replayed"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0)
    SELECT c_custkey, 'Name' AS label, 'name' AS category, c_name AS value FROM c UNION ALL SELECT c_custkey, 'Company', 'company', c_mktsegment FROM c UNION ALL SELECT c_custkey, 'Ciudad', 'location', 'place ' || c_nationkey FROM c"""
)
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels with their values below; every third customer has one value too few."""
    c = _t(spark, sf_dir, "customer")
    place = F.concat(F.lit("place "), F.col("c_nationkey").cast("string"))
    text = F.concat_ws("\n", F.lit("Dear team,"), F.lit("Name"), F.lit("Company:"), F.lit("Ciudad"), "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, place).otherwise(""), F.lit("bye"))
    return c.select("c_custkey", F.explode(labels.blocks(text)).alias("_f")).select("c_custkey", "_f.*")


@query(
    """SELECT s_suppkey, 'Name' AS label, 'name' AS category, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'E-Mail', 'email', 's' || s_suppkey || '@melvio.example' FROM supplier
    UNION ALL SELECT s_suppkey, 'Téléphone', 'phone', '0' || (s_suppkey + 100000000) FROM supplier"""
)
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    mail, phone = F.concat(F.lit("E-Mail = s"), key.cast("string"), F.lit("@melvio.example")), F.concat(F.lit("0"), (key + 100_000_000).cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("Name: "), "s_name"), mail, F.lit("Téléphone:"), phone, F.lit("note: none"), F.lit("City:"), F.lit("Name:"))
    return s.select("s_suppkey", F.explode(labels.fields(text)).alias("_f")).select("s_suppkey", "_f.*")


_CARD = "'4000 0000 0000 0' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"


@query(
    f"""WITH v AS (SELECT o_orderkey, {_CARD} AS a, {_CARD} || ' ' || o_orderkey % 10 AS b FROM orders)
    SELECT o_orderkey, CASE WHEN {_luhn("b")} THEN b WHEN {_luhn("a")} THEN a END AS card FROM v"""
)
def valid_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a number that runs into further digits is a card number."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit("4000 0000 0000 0"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" "), (k % 10).cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", gates.longest_valid(value, checks.card).alias("card"))


_TOKENS = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+"


def _runs(key: str, table: str) -> str:
    """SQL of each token of a table's texts: its place, and the runs of two and three words that begin with it."""
    two = "tok || lead(tok) OVER w || lead(tok, 2) OVER w"
    return f"""SELECT id, tok, sum(length(tok)) OVER (PARTITION BY id ORDER BY i) - length(tok) AS start, {two} AS two, {two} || lead(tok, 3) OVER w || lead(tok, 4) OVER w AS three
    FROM (SELECT id, unnest(l) AS tok, unnest(range(len(l))) AS i FROM (SELECT {key} AS id, regexp_extract_all(text, '{_TOKENS}') AS l FROM {table})) WINDOW w AS (PARTITION BY id ORDER BY i)"""


@query(
    f"""WITH b AS ({_runs('item_id', 'benchmark')}), d AS ({_runs('doc_id', 'documents')}), v AS (SELECT unnest([tok, two, three]) AS value FROM b WHERE regexp_matches(tok, '^[\\p{{L}}\\p{{N}}_]')),
    l AS (SELECT DISTINCT value FROM v WHERE value IS NOT NULL), p AS (SELECT id, start, unnest([tok, two, three]) AS value FROM d)
    SELECT id AS doc_id, value, count(*) AS n, CAST(min(start) AS BIGINT) AS first FROM p JOIN l USING (value) GROUP BY id, value"""
)
def vault_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of one to three words of the benchmark as a vault's values, looked for in all documents."""
    words = _t(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0)).alias("l"))
    at = words.select("l", F.posexplode("l").alias("i", "tok")).filter(F.col("tok").rlike(r"^[\p{L}\p{N}_]"))
    runs = F.array(*[F.when(F.size("l") >= F.col("i") + n, F.array_join(F.slice("l", F.col("i") + 1, F.lit(n)), "")) for n in (1, 3, 5)])
    found = dictionary.scan(_texts(spark, sf_dir), at.select(F.explode(runs).alias("value")), "doc_id")
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def restored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in tokens, which are then written otherwise: in lower case, without brackets, with escaped ones, or as they are; restored all the same."""
    out = rewrite.redact(_texts(spark, sf_dir), APART, style="token").select("doc_id", "vault", "redacted")
    marker, way = r"\[([A-Z]+[0-9]+)\]", F.col("doc_id") % 4
    lower = F.array_join(F.transform(F.split("redacted", r"(?=\[[A-Z]+[0-9]+\])", -1), lambda x: F.when(x.rlike(rf"^{marker}"), F.concat(F.lower(F.regexp_extract(x, f"^{marker}", 0)), F.regexp_replace(x, f"^{marker}", ""))).otherwise(x)), "")
    written = F.when(way == 0, F.regexp_replace("redacted", marker, "$1")).when(way == 1, F.regexp_replace("redacted", marker, r"\\[$1\\]")).when(way == 2, lower).otherwise(F.col("redacted"))
    return out.select("doc_id", F.md5(restoring.restored(written, F.col("vault"), reply=True)).alias("digest"))


@query(
    f"""WITH s AS ({_spans('documents', 'text', 'doc_id, source, text', APART)}), v AS (SELECT source, category, value, min(doc_id % 2) AS batch FROM s GROUP BY 1, 2, 3),
    f AS (SELECT v.source, v.category, v.value, batch, min([doc_id, instr(text, s.value)]) AS first FROM v JOIN s ON s.source IS NOT DISTINCT FROM v.source AND s.category = v.category AND s.value = v.value WHERE doc_id % 2 = batch GROUP BY 1, 2, 3, 4)
    SELECT source, '[' || upper(category) || row_number() OVER (PARTITION BY source, category ORDER BY batch, first) || ']' AS token, value, category FROM f"""
)
def scope_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one scope: the even ids first, then all, which keeps the tokens that were given."""
    found = detect.spans(_texts(spark, sf_dir), APART, "doc_id", "source").select("doc_id", F.col("source").alias("scope"), "value", "category", F.struct("doc_id", "start").alias("first"))
    half = scope.allocate(found.filter("doc_id % 2 = 0"))
    return scope.allocate(found, half).withColumnRenamed("scope", "source")


_KEPT = ", ".join(f"'{x}'" for x in addresses.kept_prefixes(4))


@query(
    f"""WITH v AS (SELECT DISTINCT value FROM ({_spans('documents', 'text', 'doc_id')}) WHERE type = 'ipv4'),
    b AS (SELECT value, array_to_string(list_transform(string_split(value, '.'), lambda x: lpad(bin(CAST(x AS INTEGER)), 8, '0')), '') AS b FROM v),
    n AS (SELECT value, list_transform(range(32), lambda i: CASE WHEN left(b, CAST(i AS INTEGER)) NOT IN ({_KEPT}) AND md5('benchmark key/' || left(b, CAST(i AS INTEGER)))[1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 - CAST(b[i + 1] AS INTEGER) ELSE CAST(b[i + 1] AS INTEGER) END) AS l FROM b)
    SELECT value, array_to_string(list_transform(range(4), lambda j: list_sum(list_transform(range(8), lambda i: l[8 * j + i + 1] * CAST(2 ** (7 - i) AS INTEGER)))), '.') AS substitute FROM n"""
)
def ip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutes of the documents' addresses that keep networks together."""
    found = _doc_spans(spark, sf_dir, "doc_id").filter("type = 'ipv4'").select("value").distinct()
    return found.select("value", addresses.mapped(F.col("value"), "benchmark key").alias("substitute"))


def _passes(name: Column, value: Column) -> Column:
    """Whether a value passes the check of a name, by the checks that detection uses."""
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for n in checksummed.NAMES:
        out = out.when(name == n, checks.CHECKS[n](value))
    return out


@query(
    f"""SELECT c_custkey, [{", ".join(f"'{s['name']}'" for s in checksummed.SCHEMES)}][c_custkey % {len(checksummed.SCHEMES)} + 1] AS scheme, true AS original_valid, true AS valid, true AS changed, true AS same_marks FROM customer"""
)
def checked_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer gets a number of one of the schemes, in groups of four, and a substitute of it; both pass the scheme's check. A number with a mark of its own isn't grouped."""
    key = F.col("c_custkey")
    one = detect.spread(_t(spark, sf_dir, "customer")).select("c_custkey", F.pmod(key, F.lit(len(checksummed.SCHEMES))).cast("int").alias("n"))
    names = F.split(F.lit(",".join(s["name"] for s in checksummed.SCHEMES)), ",")
    made = one.select("c_custkey", F.get(names, "n").alias("scheme"), checksummed.specimen(seed("benchmark key", "customer", key.cast("string")), F.col("n")).alias("v"))
    spaced = made.select("c_custkey", "scheme", F.when(F.col("scheme") == "fi_hetu", F.col("v")).otherwise(F.regexp_replace("v", "(.{4})(?=.)", "$1 ")).alias("v"))
    both = spaced.withColumn("new", checksummed.substitute(F.col("v"), seed("benchmark key", F.col("scheme"), F.col("v")), name=F.col("scheme")))
    marks = lambda c: F.regexp_replace(c, "[0-9A-Za-z]", "x")
    # Both go through the checks as rows: the checks stand in the plan once.
    told = both.select("c_custkey", "scheme", (F.col("new") != F.col("v")).alias("changed"), (marks("new") == marks("v")).alias("same_marks"), F.posexplode(F.array("v", "new")).alias("i", "value"))
    told = told.withColumn("ok", _passes(F.col("scheme"), F.col("value")))
    one = lambda i: F.bool_and(F.when(F.col("i") == i, F.col("ok")))
    return told.groupBy("c_custkey", "scheme").agg(one(0).alias("original_valid"), one(1).alias("valid"), F.bool_and("changed").alias("changed"), F.bool_and("same_marks").alias("same_marks"))
