"""Cross-site boilerplate lines, found by how many sites a line is spread over.

A line's key is two 64-bit hashes of the line without surrounding blanks. Its
spread is the number of distinct sites that have it. HyperLogLog sketches per
key, built on the map side and merged by aggregation, estimate the spread; a key
whose estimate is within a factor of two of its threshold gets an exact distinct
count. Every line that is not blank counts: it is boilerplate from `min_sites`
sites on, or from `short_sites` on if it has fewer than `short_chars`
characters, since short lines meet by chance. Boilerplate goes everywhere but at
its first occurrence, the smallest (doc_id, line number), so that no text is lost.

Scale. Everything is DataFrame operations. A first aggregation of two numbers
per key (smallest and largest site hash, combined on the map side, so a line in
a third of all rows costs one row per task) drops the lines of a single site.
Only the few percent of lines that are left are kept, without their text, for
the sketches, counts and positions. Texts are shuffled once, to meet the list of
line numbers that each document loses; a text is split once there, and its lines
are fetched by number, so the cost is linear in the lines however many go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pick, stored

MIN_SITES = 6
#: Lines under SHORT_CHARS have to stand in SHORT_SITES sites.
SHORT_CHARS, SHORT_SITES = 16, 12
LG_K = 12
KEY = ("k1", "k2")
#: Rows of a table of keys that may be broadcast, of at most 56 bytes each; beyond that it is joined by merging, where AQE splits hot keys.
BROADCAST_KEYS = 500_000
BLANKS = " \t\r"


def _lines(docs: DataFrame, min_sites: int, short_sites: int, short_chars: int) -> DataFrame:
    """(rid, doc_id, at, k1, k2, least, site) for every line that is not blank; least is how many sites make it boilerplate."""
    line = F.btrim(F.col("col"), F.lit(BLANKS))
    split = docs.select("rid", "doc_id", F.xxhash64(F.coalesce("site", F.lit("\0"))).alias("site"), F.posexplode(F.split("text", "\n", -1)))
    n = F.char_length(line)
    least = F.when(n < short_chars, short_sites).otherwise(min_sites)
    return split.where(n > 0).select("rid", "doc_id", F.col("pos").alias("at"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2"), least.alias("least"), "site")


def _sent(keys: DataFrame) -> DataFrame:
    """A table of one row per key, broadcast if it has few enough rows: then occurrences need no shuffle by line, hot or not."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def boilerplate(lines: DataFrame) -> DataFrame:
    """Keys of lines(k1, k2, least, site) whose spread is `least` or more: by sketch, or exactly where it is close."""
    spread = stored(lines.groupBy(*KEY, "least").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("spread")), "line-spread")
    sure = spread.where(F.col("spread") >= 2 * F.col("least")).select(*KEY)
    close = spread.where((F.col("spread") > F.col("least") / 2) & (F.col("spread") < 2 * F.col("least"))).select(*KEY)
    exact = lines.join(_sent(close), list(KEY), "left_semi").groupBy(*KEY, "least").agg(F.countDistinct("site").alias("n")).where("n >= least")
    return sure.unionByName(exact.select(*KEY))


def lost_lines(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, short_chars: int = SHORT_CHARS) -> DataFrame:
    """(rid, lost): the line numbers that each document of docs(rid, doc_id, text, site) loses, if any."""
    lines = _lines(docs, min_sites, short_sites, short_chars)
    wide = lines.groupBy(*KEY).agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo <> hi").select(*KEY)
    wide = stored(wide, "wide-lines")
    shared = stored(lines.join(_sent(wide), list(KEY), "left_semi"), "shared-lines")
    common = stored(boilerplate(shared), "boilerplate")
    found = shared.join(_sent(common), list(KEY), "left_semi")
    first = stored(found.groupBy(*KEY).agg(F.min(F.struct("doc_id", "rid", "at")).alias("first")), "first-lines")
    return (
        shared.join(_sent(first), list(KEY))
        .where("struct(doc_id, rid, at) <> first")
        .groupBy("rid")
        .agg(F.collect_set("at").alias("lost"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, short_chars: int = SHORT_CHARS) -> DataFrame:
    """Every row of docs with its text less the boilerplate lines, and columns n_lines and n_removed.

    Other columns are kept as they are (columns called n_lines or n_removed are
    replaced). A null site counts as one site of its own. A null text stays null
    with 0 lines, an empty text has one empty line. Blank lines never go. Rows
    with the same id and text are treated alike; of a line that only they have
    first, each keeps its copy. An empty table gives no rows.
    """
    own, rid, gone = fresh(docs, "__own", "__rid", "__lost")
    slim = pick(docs, doc_id=id_col, text=text_col, site=site_col).select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text", F.col("site").cast("string").alias("site"))
    lost = stored(lost_lines(slim, min_sites, short_sites, short_chars).withColumnsRenamed({"rid": rid, "lost": gone}), "lost-lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Always a merge join, whose cost follows the input; a broadcast could only hold at small sizes.
    keyed = docs.withColumn(own, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    found = keyed.join(lost.hint("merge"), F.col(own) == F.col(rid), "left")
    whole = F.col(f"`{text_col}`")
    split = F.split(whole, "\n", -1)

    def rest(lines: Column) -> Column:
        # The outer function's variable holds the lines, which a plain expression would split again for each line kept.
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(gone).isNull(), whole).otherwise(F.get(F.transform(F.array(split), rest), F.lit(0)))
    return found.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(whole.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )
