"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IPv4, payment card, phone) are matched by fixed regular
expressions and checked. They are the seeds of a bootstrap over a bipartite
graph of lexical patterns and instances. A pattern is what stands right before
an entity: the last word with its punctuation where that has a mark such as `=`,
`:` or a quote, else the last two words; an instance is an entity's value or that of any other
identifier-like token (six or more letters, digits, `_` or `-`, with a digit).
Tokens of the shape of a secret (`SECRET`) are seeds too, as their shape tells
what they are, but only a confident pattern reports them. A
pattern's confidence grows with the share and the number of its distinct
instances that are known; an unknown instance is believed by the noisy-or of its
patterns' confidences, and becomes known for the next round once it is believed
enough. After `rounds` rounds, identifier-like tokens that follow a confident
pattern and touch no base entity are reported as kind `id`.

Scale. One pass over the texts: each kind's matches are marked by one regular
expression replacement and cut at the marks, and only matches travel, with their
gap lengths; code point places come from a running sum per document. The graph
is aggregated to distinct (pattern, instance) pairs by partial aggregation before
its rounds, so a pattern that a third of all rows share is one key of a
pre-aggregated sum. Expressions are written with possessive repeats and anchored
starts, so that no text, however long, is scanned more than a bounded number of
times per expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: Fixed kinds, in reporting order; `id` are the discovered ones.
KINDS = ("email", "ip", "card", "phone", "id")
#: Each expression starts only where a run of its first class starts or the last match ended (\G), which the greedy form would find as well.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+",
}
#: Fixed value: hexadecimal keys and digests of 128 bits or more.
SECRET = r"^(?=[0-9A-Fa-f]{32,}$)(?=.*[0-9])(?=.*[A-Fa-f])"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CONTEXT = r"((?:\p{L}+[^\p{L}\p{N}]{1,4})?\p{L}*[^\p{L}\p{N}]{0,4})$"
MARKED = r"(\p{L}+[^\p{L}\p{N}]{0,3}[^\p{L}\p{N}\s.,;!?][^\p{L}\p{N}]{0,3})$"
#: A pattern is read from so many characters: of a longer word its end tells it from others.
CONTEXT_CHARS = 48
ROUNDS, MIN_KNOWN, MIN_CONFIDENCE, MIN_BELIEF = 3, 3, 0.5, 0.6
MARK, STAND_IN = "\x01", "\x02"


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base kind holds; failing ones are dropped without another try."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        (kind == "email")
        | ((kind == "ip") & value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        | ((kind == "card") & n.between(13, 19) & F.call_function("luhn_check", digits))
        | ((kind == "phone") & n.between(9, 15))
        | (kind == "id")
    )


def matches(docs: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value, before) of every match in docs(rid, text), failing ones dropped."""
    safe = F.translate("text", MARK, STAND_IN)
    cut = docs.select("rid", *[F.split(F.regexp_replace(safe, F.lit(EXPRESSIONS[k]), F.lit(f"{MARK}$0{MARK}")), MARK, -1).alias(k) for k in KINDS])
    one = lambda k: (
        f"IF(size({k}) > 1, transform(sequence(0, (size({k}) - 3) div 2), i -> struct('{k}' AS kind, i AS i, "
        f"char_length({k}[2 * i]) AS gap, {k}[2 * i + 1] AS value, right({k}[2 * i], {CONTEXT_CHARS}) AS before)), array())"
    )
    found = cut.select("rid", F.explode(F.expr(f"concat({', '.join(map(one, KINDS))})")).alias("m")).select("rid", "m.*")
    width = F.char_length("value")
    so_far = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.distinct().withColumn("end", F.sum(F.col("gap") + width).over(so_far).cast("long"))
    return placed.withColumn("start", F.col("end") - width).where(_valid(F.col("kind"), F.col("value"))).select("rid", "kind", "start", "end", "value", "before")


def graph(found: DataFrame) -> DataFrame:
    """(rid, kind, start, end, seed, pattern, instance): base matches, and identifier-like ones that touch none of them."""
    base = F.col("kind") != "id"
    # Both frames grow from their order's beginning, which costs a step a row; one that shrinks towards the end would be computed anew for each row.
    before_it = lambda *order: Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max(F.when(base, F.col("end"))).over(before_it("start", "end", "kind"))
    later = F.min(F.when(base, F.col("start"))).over(before_it(F.desc("start"), F.desc("end"), F.desc("kind")))
    free = base | ((F.coalesce(earlier, F.lit(-1)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end")))
    before = F.regexp_replace(F.lower(F.regexp_extract("before", CONTEXT, 1)), r"\s+", " ")
    marked = F.regexp_extract("before", MARKED, 1)
    lexical = F.when(marked != "", marked).when(F.trim("before") != "", F.col("before"))
    seed = base | F.col("value").rlike(SECRET)
    told = found.withColumn("free", free).where("free").withColumn("before", before)
    return told.select("rid", "kind", "start", "end", seed.alias("seed"), F.when(lexical.isNotNull(), F.xxhash64(lexical)).alias("pattern"), F.xxhash64("value").alias("instance"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_known: int = MIN_KNOWN, min_confidence: float = MIN_CONFIDENCE, min_belief: float = MIN_BELIEF) -> DataFrame:
    """(pattern, confidence) of the confident patterns of edges(pattern, instance, seed)."""
    pairs = stored(edges.where("pattern IS NOT NULL").groupBy("pattern", "instance").agg(F.max("seed").alias("known")), "pii-pairs")

    def confident(pairs):
        counted = pairs.groupBy("pattern").agg(F.sum(F.col("known").cast("int")).alias("k"), F.count("*").alias("n")).where(F.col("k") >= min_known)
        # Share of known instances, held down while they are few.
        return counted.select("pattern", (F.col("k") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= min_confidence)

    for _ in range(rounds - 1):
        belief = pairs.join(confident(pairs), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("belief"))
        believed = belief.where(F.col("belief") >= min_belief).select("instance", F.lit(True).alias("believed"))
        pairs = stored(pairs.join(believed, "instance", "left").select("pattern", "instance", F.coalesce("believed", "known").alias("known")), "pii-pairs")
    return confident(pairs)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, spans) for every row of docs: spans is an array of (kind, start, end) in code points, end exclusive.

    Spans are sorted by kind in the order of KINDS, then start. Base kinds are
    always reported, `id` where the bootstrap finds a confident pattern. Null
    and empty texts have no spans. Rows that repeat are kept, each with its
    spans. An empty table gives no rows.
    """
    slim = pick(docs, doc_id=id_col, text=text_col).select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(graph(stored(matches(slim), "pii-matches")), "pii-graph")
    patterns = bootstrap(found, rounds)
    new = found.where("kind = 'id'").join(stored(patterns, "pii-patterns"), "pattern", "left_semi")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = found.where("kind <> 'id'").select("rid", rank.alias("rank"), "kind", "start", "end").unionByName(new.select("rid", rank.alias("rank"), "kind", "start", "end"))
    per = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "kind"))).alias("found"))
    listed = F.transform(F.coalesce("found", F.array()), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # Always a merge join of ids, whose cost follows the input.
    return slim.select("rid", "doc_id").join(per.hint("merge"), "rid", "left").select("doc_id", listed.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from the rows of personal_data."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: x["kind"] != "id")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
