"""The registered queries over the driver's tables, with their DuckDB oracles.

Each query binds one operator of the library to the nearest columns of the
tables at hand; thresholds, tie-breaks and caps are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact, text
from ..operators import graph, relational, sequences, similarity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import fixtures, inline, repository

    del fixtures, inline, repository  # imported for what they register
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def cents(col: Column) -> Column:
    """Values as whole hundredths, so that sums are exact in any order."""
    return F.round(col * 100).cast("long")


MARKER = "2024-01-15"

WEEKLY = """SELECT CAST(isoyear(ts) AS BIGINT) AS iso_year, CAST(week(ts) AS BIGINT) AS iso_week, count(*) AS calls,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"""


@query(f"SELECT iso_year, iso_week, calls, cents, CAST(cents AS DOUBLE) / calls AS cents_per_call FROM ({WEEKLY})")
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = relational.weekly(table(spark, sf_dir, "events"), "ts", cents=cents(F.col("value")))
    return weeks.withColumn("cents_per_call", F.col("cents").cast("double") / F.col("calls"))


@query(f"""
WITH w AS ({WEEKLY}), s AS (
  SELECT CAST(coalesce(sum(calls) FILTER (WHERE (iso_year, iso_week) < (isoyear(DATE '{MARKER}'), week(DATE '{MARKER}'))), 0) AS BIGINT) AS before_calls,
         CAST(coalesce(sum(calls) FILTER (WHERE (iso_year, iso_week) > (isoyear(DATE '{MARKER}'), week(DATE '{MARKER}'))), 0) AS BIGINT) AS after_calls,
         coalesce(sum(cents) FILTER (WHERE (iso_year, iso_week) < (isoyear(DATE '{MARKER}'), week(DATE '{MARKER}'))), 0)::DOUBLE AS b,
         coalesce(sum(cents) FILTER (WHERE (iso_year, iso_week) > (isoyear(DATE '{MARKER}'), week(DATE '{MARKER}'))), 0)::DOUBLE AS a
  FROM w), p AS (SELECT before_calls, after_calls, b / greatest(before_calls, 1) AS bp, a / greatest(after_calls, 1) AS ap FROM s)
SELECT before_calls, after_calls, bp AS before_cents_per_call, ap AS after_cents_per_call, (ap - bp) / greatest(bp, 1) AS cents_change FROM p""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = relational.weekly(table(spark, sf_dir, "events"), "ts", cents=cents(F.col("value")))
    return relational.before_after(weeks, MARKER, ["cents"])


@query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def dedup_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return relational.keep_max(events, ["user_id", "event_type"], "value", "event_id")


@query("""SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1, 2""")
def first_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    first = relational.first_wins(events, ["user_id", "event_type"], "event_id").withColumnRenamed("event_id", "first_id")
    last = relational.last_wins(events, ["user_id", "event_type"], "event_id").withColumnRenamed("event_id", "last_id")
    return first.join(last, ["user_id", "event_type"])


# RE2 reads these classes as Java does.
CJK, DENSE = text.CJK, text.DENSE
ESTIMATE = "(c * 1.00::DOUBLE + d * 0.84::DOUBLE + (n - c - d) / 2.4::DOUBLE)"
COUNTED = f"""SELECT *, length(text) AS n, len(regexp_extract_all(text, '{CJK}')) AS c, len(regexp_extract_all(text, '{DENSE}')) AS d FROM documents"""


@query(f"SELECT doc_id, {ESTIMATE} AS tokens, {ESTIMATE} <= 400 AS fits FROM ({COUNTED})")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.fits(F.col("text"), 400).alias("fits"))


@query(f"SELECT lang, count(*) AS files, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(CAST(round({ESTIMATE} * 100) AS BIGINT)) AS BIGINT) AS token_cents FROM ({COUNTED}) GROUP BY lang")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.sum(cents(text.token_estimate(F.col("text")))).alias("token_cents"))


@query("""SELECT doc_id, CAST(CASE WHEN length(text) <= 959 THEN length(text) ELSE 959 END AS BIGINT) AS keep, left(text, 959) AS head
FROM documents""")
def token_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The oracle holds for texts without dense scripts, of which the tables have none: 959 sums of 1/2.4 reach 400, one more goes over.
    docs = table(spark, sf_dir, "documents")
    keep = text.token_cut(F.col("text"), 400)
    return docs.select("doc_id", keep.cast("long").alias("keep"), F.left("text", keep.cast("int")).alias("head"))


def duck_scrub(column: str = "text") -> str:
    """The redaction chain for DuckDB: \\w and \\b spelled out, one pattern for each quote instead of a back-reference."""
    word = r"[\p{L}\p{N}_]"
    out = column
    for pattern, replacement in redact.PATTERNS:
        flags = "g" + ("i" if "i" in pattern.split(")")[0] else "") + ("s" if "s" in pattern.split(")")[0] else "")
        body = pattern.split(")", 1)[1] if pattern.startswith("(?") and pattern[2] in "isU" else pattern
        if not pattern.startswith("(?"):
            flags = "g"
        body = body.replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"\w", word).replace(r"\x1c-\x1f", "\\x1c-\\x1f")
        forms = [(body, replacement)]
        if r"\2" in body:
            forms = [(body.replace(r"(['\"])([^'\"]{6,})\2", f"({q})([^'\"]{{6,}}){q}"), f"$1{q}{redact.PLACEHOLDER}{q}") for q in ("'", '"')]
        for b, r in forms:
            r = r.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
            out = f"regexp_replace({out}, '{b.replace(chr(39), chr(39) * 2)}', '{r}', '{flags}')"
    return out


@query(f"SELECT doc_id, {duck_scrub()} AS text FROM documents")
def redact_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.scrub(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '(?:[=*#_~-]\s*){4,}', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 110 THEN left(s, 109) || '…' ELSE s END AS summary FROM l""")
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_summary(F.element_at(F.split("text", "\n"), 1)).alias("summary"))


NEEDLE = "license"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rank FROM l WHERE contains(lower(line), '{NEEDLE}'))
SELECT doc_id, n AS line_no, left(rtrim(line), 160) AS line FROM r WHERE rank <= 12""")
def find_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines are searched inside each row, so nothing is shuffled.
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), F.left(F.rtrim(x), F.lit(160)).alias("line"), text.contains_any_case(x, NEEDLE).alias("hit")))
    found = F.slice(F.filter(lines, lambda x: x["hit"]), 1, 12)
    return table(spark, sf_dir, "documents").where(text.contains_any_case(F.col("text"), NEEDLE)).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.line_no", "x.line")


@query("""SELECT '{k: int}' AS shape, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')""")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.peek import json_shape_of

    return table(spark, sf_dir, "events").groupBy(json_shape_of(F.col("props")).alias("shape")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS b FROM documents GROUP BY 1, 2),
t AS (SELECT source, CAST(sum(n) AS BIGINT) AS count, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY 1 HAVING sum(n) >= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM p)
SELECT t.source, count, bytes, kinds FROM t JOIN (SELECT source, list(lang || '=' || n ORDER BY rank) AS kinds FROM r WHERE rank <= 6 GROUP BY 1) k ON k.source = t.source""")
def asset_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.inventory(table(spark, sf_dir, "documents"), ["source"], "lang", "n_chars")


@query("""WITH p AS (SELECT source, lang, CAST(toxic AS VARCHAR) AS toxic, count(*) AS n, sum(n_chars) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3),
t AS (SELECT source, lang, CAST(sum(n) AS BIGINT) AS count, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY 1, 2 HAVING sum(n) >= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, toxic) AS rank FROM p)
SELECT t.source, t.lang, count, bytes, kinds FROM t JOIN (SELECT source, lang, list(toxic || '=' || n ORDER BY rank) AS kinds FROM r WHERE rank <= 6 GROUP BY 1, 2) k ON k.source = t.source AND k.lang = t.lang""")
def asset_groups_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return relational.inventory(docs.join(labels, "doc_id"), ["source", "lang"], "toxic", "n_chars")


HOST, TAIL = r"^[a-z]+://([^/?#]+)", r"([^/]*)$"


@query(rf"""WITH p AS (SELECT regexp_extract(url, '{HOST}', 1) AS host, regexp_extract(url, '{TAIL}', 1) AS tail FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY tail) AS rank FROM p),
t AS (SELECT host, count(*) AS n FROM p GROUP BY 1)
SELECT t.host, n, names, greatest(n - 8, 0) AS more FROM t JOIN (SELECT host, list(tail ORDER BY tail) AS names FROM r WHERE rank <= 8 GROUP BY 1) s ON s.host = t.host""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", TAIL, 1).alias("tail"))
    return relational.rollup(pages, "host", "tail")


@query("SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def asset_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return relational.not_indexed(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT lang, count(*) FILTER (WHERE n_chars > 0) AS total, count(*) FILTER (WHERE n_chars > 0 AND l.doc_id IS NOT NULL) AS described,
  round(count(*) FILTER (WHERE n_chars > 0 AND l.doc_id IS NOT NULL) * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE n_chars > 0), 1), 1) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY lang""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(known, "doc_id", "left")
    got = relational.coverage(docs, ["lang"], F.col("n_chars") > 0, F.col("known").isNotNull())
    return got.withColumn("percent", F.col("percent").cast("double"))


@query("""SELECT r_name, c_custkey, c_acctbal, CAST(rank AS BIGINT) AS rank FROM (
  SELECT r_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal DESC, c_custkey) AS rank
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rank <= 60""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "c_custkey", "c_acctbal")
    return relational.top_per_group(people, ["r_name"], [F.desc("c_acctbal"), F.col("c_custkey")], 60).withColumn("rank", F.col("rank").cast("long"))


EDGES = """e AS (SELECT DISTINCT l_partkey AS target, o_custkey AS importer, o_orderstatus = 'P' AS test FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey),
u AS (SELECT target, coalesce(list(importer ORDER BY importer) FILTER (WHERE NOT test), []) AS used_by, coalesce(list(importer ORDER BY importer) FILTER (WHERE test), []) AS tests FROM e GROUP BY 1)"""


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as importers of the parts they order; an order that is pending counts as a test."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("target", F.col("o_custkey").alias("importer"), "o_orderstatus")


@query(f"""WITH {EDGES} SELECT target, CAST(len(used_by) AS INTEGER) AS n_used_by, CAST(len(tests) AS INTEGER) AS n_tests, used_by[1:6] AS used_by, tests[1:3] AS tests
FROM u ORDER BY len(used_by) DESC, len(tests) DESC, target LIMIT 120""")
def impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(graph.reverse_edges(impact_edges(spark, sf_dir), F.col("o_orderstatus") == "P"))


@query(f"WITH {EDGES} SELECT * FROM u")
def impact_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_edges(impact_edges(spark, sf_dir), F.col("o_orderstatus") == "P")


PATH, PAGE = r"^[a-z]+://([^?#]+)", r"\.html$"


@query(rf"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '{PATH}', 1), '{PAGE}', '') || '.py' AS path FROM pages),
f AS (SELECT path, left(path, length(path) - 3) AS bare FROM p),
k AS (SELECT path, regexp_replace(bare, '\.[^./]*$', '') AS cut, bare FROM f),
i AS (SELECT DISTINCT path AS importer, regexp_extract(bare, '([^/]+/[^/]+)$', 1) AS name FROM k
      UNION SELECT path, regexp_extract(bare, '([^/]+)$', 1) FROM k),
s AS (SELECT path, bare AS key FROM k UNION ALL SELECT path, regexp_replace(bare, '^[^/]*/', '') FROM k WHERE contains(bare, '/')
      UNION ALL SELECT path, regexp_replace(bare, '^[^/]*/[^/]*/', '') FROM k WHERE len(string_split(bare, '/')) > 2
      UNION ALL SELECT path, regexp_replace(bare, '^[^/]*/[^/]*/[^/]*/', '') FROM k WHERE len(string_split(bare, '/')) > 3),
u AS (SELECT key, min(path) AS path FROM s GROUP BY key HAVING count(*) = 1)
SELECT importer, name, u.path AS target FROM i LEFT JOIN u ON u.key = i.name""")
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: each one is named by the last one and two parts of its path, which resolve where they are unique."""
    bare = F.regexp_replace(F.regexp_extract("url", PATH, 1), PAGE, "")
    paths = table(spark, sf_dir, "pages").select(F.concat(bare, F.lit(".py")).alias("path"), bare.alias("bare")).distinct()
    names = F.array(F.regexp_extract("bare", r"([^/]+/[^/]+)$", 1), F.regexp_extract("bare", r"([^/]+)$", 1))
    return graph.resolve(paths.select("path"), paths.select(F.col("path").alias("importer"), F.explode(names).alias("name")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sequences.collapse(events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


SUPPORT = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS back FROM events),
t AS (SELECT user_id, day, list(event_type ORDER BY back DESC) AS s FROM d WHERE back <= 12 GROUP BY 1, 2),
a AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM t), b AS (SELECT *, unnest(range(i + 2, len(s) + 1)) AS j FROM a),
q AS (SELECT DISTINCT user_id, day, s[i:j] AS sequence FROM b WHERE len(list_distinct(s[i:j])) >= 3),
n AS (SELECT user_id, sequence, count(*) AS days, CAST(len(sequence) AS INTEGER) AS length FROM q GROUP BY 1, 2)"""


@query(f"{SUPPORT} SELECT user_id, sequence, days, length FROM n WHERE days >= 2")
def sequence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    got = sequences.sequence_support(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type")
    return got.where("days >= 2").select("user_id", "sequence", "days", "length")


@query(f"{SUPPORT} SELECT user_id, sequence, days, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, days DESC, sequence) AS r FROM n WHERE days >= 3) WHERE r = 1")
def repeated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sequences.repeated_sequence(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type").select("user_id", "sequence", "days", "length")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 400""")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return relational.bounded_log(events, ["event_type"], ["ts", "event_id"], 400).drop("ts")


LATEST = """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1"""


@query(LATEST)
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")


@query(f"""SELECT conv_id, turn, CASE WHEN length(text) > 1200 THEN regexp_replace(left(text, 1200), '\\n[^\\n]*$', '') ELSE text END AS carried FROM ({LATEST}) WHERE role = 'user'""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of each conversation that waits for an answer, cut at a line's end."""
    last = relational.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")
    body = F.when(F.char_length("text") > 1200, F.regexp_replace(F.left("text", F.lit(1200)), r"\n[^\n]*\z", "")).otherwise(F.col("text"))
    return last.where((F.col("role") == "user") & ~text.is_nothing(F.col("text"))).select("conv_id", "turn", body.alias("carried"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank, greatest(count(*) OVER (PARTITION BY o_custkey) - 2, 0) AS earlier FROM orders)
SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank, earlier FROM r WHERE rank <= 2""")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.recent(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey", "rank", "earlier")


@query("""SELECT category, p_name, p_partkey FROM (SELECT 0 AS part, 'economy' AS category, p_name, p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size > 49
UNION ALL SELECT 1, 'promo', p_name, p_partkey FROM part WHERE p_type = 'PROMO') ORDER BY part, p_partkey LIMIT 8""")
def titles_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    of = lambda kind, cond: part.where(cond).select(F.lit(kind).alias("category"), "p_name", "p_partkey")
    return relational.capped_union([of("economy", "p_type = 'ECONOMY' AND p_size > 49"), of("promo", "p_type = 'PROMO'")], ["p_partkey"], 8)


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    now = events.agg(F.max("ts")).first()[0]  # one value: the filter then reaches the scan
    return relational.retained(events, "ts", F.lit(now), 7)


@query("""WITH r AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
SELECT event_type, count(*) AS n, min(event_id) AS founder FROM r GROUP BY 1 HAVING count(*) > 2 ORDER BY 2 DESC, 3 LIMIT 4""")
def digest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    now = events.agg(F.max("ts")).first()[0]
    day = relational.retained(events, "ts", F.lit(now), 1)
    return day.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("founder")).where("n > 2").orderBy(F.desc("n"), "founder").limit(4)


TOKENS = r"list_distinct([lower(x) for x in regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}')])"


@query(f"SELECT doc_id, list_sort({TOKENS}) AS tokens FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.identifiers(F.col("text"))).alias("tokens"))


@query(f"""WITH s AS (SELECT doc_id, list_sort({TOKENS}) AS t FROM documents), f AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS g FROM s WHERE len(t) >= 8),
r AS (SELECT * FROM f WHERE doc_id = g), e AS (SELECT doc_id, unnest(t) AS w FROM r),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, n::DOUBLE / (len(fa.t) + len(fb.t) - n) AS similarity FROM p JOIN r fa ON fa.doc_id = a JOIN r fb ON fb.doc_id = b
WHERE n::DOUBLE / (len(fa.t) + len(fb.t) - n) >= 0.55
UNION ALL SELECT g, doc_id, 1.0::DOUBLE FROM f WHERE doc_id <> g""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "documents").select("doc_id", text.identifiers(F.col("text")).alias("tokens"))
    return similarity.similar_pairs(sets, "doc_id", "tokens")


@query(f"""WITH RECURSIVE s AS (SELECT source, doc_id, {TOKENS} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE len({TOKENS}) >= 8),
w AS (SELECT source, doc_id, len(t) AS n, unnest(t) AS w FROM s),
p AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM w x JOIN w y ON x.source = y.source AND x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT source, b, list(a ORDER BY a) AS earlier FROM p WHERE shared::DOUBLE / (na + nb - shared) >= 0.55 GROUP BY 1, 2),
k AS (SELECT s.source, s.doc_id, s.i, coalesce(near.earlier, []) AS earlier FROM s LEFT JOIN near ON near.source = s.source AND near.b = s.doc_id),
f AS (SELECT source, i, [doc_id] AS founders, doc_id AS joined FROM k WHERE i = 1
  UNION ALL SELECT k.source, k.i, CASE WHEN len(list_filter(f.founders, lambda x: list_contains(k.earlier, x))) > 0 THEN f.founders ELSE list_append(f.founders, k.doc_id) END,
    coalesce(list_filter(f.founders, lambda x: list_contains(k.earlier, x))[1], k.doc_id) FROM f JOIN k ON k.source = f.source AND k.i = f.i + 1),
g AS (SELECT source AS "group", joined AS founder, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) > 1)
SELECT "group", founder, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, founder) AS rank FROM g) WHERE rank <= 4""")
def script_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as a log of scripts, in the order of their ids."""
    docs = table(spark, sf_dir, "documents")
    log = docs.select("source", "doc_id", text.identifiers(F.col("text")).alias("tokens"), text.headline(F.col("text"), 70).alias("head")).where(F.size("tokens") >= similarity.MIN_TOKENS)
    return similarity.repeated_families(similarity.families(log, "source", "doc_id", "tokens", "head"), above=1).drop("head")


@query("SELECT lang, count(*) AS files FROM documents GROUP BY 1")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repository import language_counts

    return language_counts(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the cells of a run that can be resumed, of which the labelled ones are done."""
    from ..sources.workspace import pending

    return pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT p_partkey, coalesce(nullif(rtrim(left(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), 50), '-'), ''), 'entry') AS slug FROM part""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.0fB', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1fKB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1fMB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.col("n_chars")).alias("size"))


@query("""SELECT page_id, CASE WHEN length(html) >= 10000 THEN 'very large' WHEN length(html) >= 2000 THEN 'large' END AS notice, CAST(round(length(html) / 3.6::DOUBLE) AS BIGINT) AS estimate FROM pages WHERE length(html) >= 2000""")
def bulk_read_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size classes of the notice with thresholds scaled to the pages at hand (2,000 and 10,000 characters)."""
    from ..operators.notices import bulk_read

    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("page.html").alias("path"), F.char_length("html").cast("long").alias("bytes"))
    got = bulk_read(pages, "path", "bytes", big=2_000, huge=10_000)
    return got.select("page_id", "notice", F.round("estimate").cast("long").alias("estimate"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS html FROM pages""")
def unescape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.unescape_xml(F.col("html")).alias("html"))
