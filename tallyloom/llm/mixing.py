"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share the corpus' words by weight. A source's target is met by whole
passes over all its documents and a remainder drawn without replacement: its
documents are cut into blocks of `block_words` words, every block belongs to one
output shard by a hash, and the remainder's exact word quota is split among the
shards by a binary tree whose nodes draw hypergeometrically (each half gets what
a random subset of the source's words would have in it). Each shard then takes
its own blocks in a random permutation until its quota is met, the last one in
part, so shares are disjoint and add up to the quota exactly. Blocks of whole
passes are dealt to shards likewise, each pass by hashes of its own, and stand
among the drawn ones in a shard's order.

Scale. Sizes are counted in one pass and kept as a narrow table; the plan moves
(id, size) rows, never texts. Only the mixed output itself (`output`,
`taken_rows`) moves each text once, to meet the list of its slices. A shard holds about `shard_words` words of all
sources, so the largest source is spread over all shards and no task sorts more
than a shard's blocks. Only one row per source reaches the driver (more than
MAX_SOURCES are an error). Draws are
seeded by source and tree node, so a rerun, or a retried task, agrees.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_batches, pick, rows, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
BLOCK_WORDS = 256
SHARD_WORDS = 1 << 16
MAX_SHARDS = 1 << 16
MAX_SOURCES = 1_000_000
#: Hashes of repeated rows that may be broadcast; more are joined by merging.
BROADCAST_ROWS = 500_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's target words. Sources take the weights in turn by code point, null last.

    All words are shared by weight; a target above `most` times its source stops
    there and the excess is shared again by weight among the others.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def hypergeometric(rng: np.random.Generator, left: int, right: int, drawn: int) -> int:
    """How many of `drawn` items from left + right fall into left; beyond numpy's range by the normal law, kept feasible."""
    total = left + right
    if not drawn or not left:
        return 0
    if not right:
        return drawn
    if max(left, right) < 1_000_000_000:
        return int(rng.hypergeometric(left, right, drawn))
    mean = drawn * left / total
    spread = math.sqrt(max(0.0, mean * (right / total) * ((total - drawn) / max(1, total - 1))))
    return min(min(left, drawn), max(drawn - right, 0, round(rng.normal(mean, spread))))


def split_quota(words: list[int], quota: int, seed: tuple[int, ...]) -> list[int]:
    """quota split among shards of so many words by the tree; exact, and never above a shard's words."""
    sums = np.concatenate(([0], np.cumsum(np.array(words, object)))) if words else [0]
    out, todo = [0] * len(words), [(0, len(words), quota)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo <= 1 or not k:
            if hi > lo:
                out[lo] = k
            continue
        mid = (lo + hi) // 2
        a = hypergeometric(np.random.default_rng([*seed, lo, hi]), int(sums[mid] - sums[lo]), int(sums[hi] - sums[mid]), k)
        todo += [(lo, mid, a), (mid, hi, k - a)]
    return out


def _identity(df: DataFrame) -> DataFrame:
    return df.withColumn("rid", F.xxhash64("doc_id", "source", "text"))


def _source_seed(source: str | None) -> int:
    return zlib.crc32(source.encode("utf-8", "surrogatepass")) if source is not None else 1 << 32


def slices(text: str, wanted: list[dict]) -> list[str]:
    """The text of each wanted slice (first word, number of words), with the blanks after it; the first one has those before it."""
    at = [m.start() for m in re.finditer(WORDS, text)]
    at[:1], end = [0], len(text)
    return [text[at[w["first"]] : at[w["first"] + w["words"]] if w["first"] + w["words"] < len(at) else end] for w in wanted]


def together(text: str, wanted: list[dict]) -> str:
    """The wanted slices as one text; a line is broken where a slice doesn't go on from the one before."""
    out, last = [], None
    for w, piece in zip(wanted, slices(text, wanted), strict=True):
        if last is not None and (w["pass"], w["first"]) != last:
            out.append("\n")
        out.append(piece)
        last = (w["pass"], w["first"] + w["words"])
    return "".join(out)


class Mixture:
    """The plan for one corpus: its documents, sources and drawn blocks."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS):
        spark = docs.sparkSession
        self.docs, self.columns = docs, (id_col, text_col, source_col)
        narrow = _identity(pick(docs, doc_id=id_col, text=text_col, source=source_col).withColumn("source", F.col("source").cast("string")))
        sized = narrow.select("rid", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
        # Rows that repeat in every respect are told apart by a number, so that each is a document of its own.
        once = sized.groupBy("rid", "doc_id", "source", "size").agg(F.count("*").cast("int").alias("copies"))
        #: (rid, copy, doc_id, source, size)
        self.base = stored(once.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"), "mix-base")
        totals = {r["source"]: int(r["size"]) for r in self.base.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()}
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        goal = targets(totals, weights, most)
        plan = []
        for s, total in totals.items():
            want = min(round(goal[s]), int(most * total))
            passes = min(want // total, int(most)) if total else 0
            plan.append((s, total, float(goal[s]), passes, want - passes * total))
        #: One row per source: its size, target, whole passes and the words still to draw.
        self.sources = spark.createDataFrame(plan, "source string, source_size long, target double, passes long, quota long")
        shards = max(1, min(MAX_SHARDS, math.ceil(sum(totals.values()) / shard_words)))
        left = {s: quota for s, _, _, _, quota in plan}
        block = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_words).cast("long"))
        blocks = (
            self.base.where("size > 0")
            .withColumn("first", F.explode(block))
            .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("first")))
            .withColumn("turn", F.xxhash64("rid", "copy", "first", F.lit(seed)))
            .withColumn("shard", F.pmod(F.xxhash64("turn", F.lit(1)), F.lit(shards)).cast("int"))
            .select("source", "shard", "turn", "rid", "copy", "first", "words")
        )

        def split(key, pdf):
            pdf = pdf.sort_values("shard")
            source = key[0] if isinstance(key[0], str) else None
            pdf["quota"] = split_quota([int(x) for x in pdf["words"]], left[source], (seed, _source_seed(source)))
            return pdf[["source", "shard", "quota"]]

        quotas = blocks.groupBy("source", "shard").agg(F.sum("words").alias("words")).groupBy("source").applyInPandas(split, "source string, shard int, quota long")
        quotas = stored(quotas.where("quota > 0"), "mix-quotas")
        turn = Window.partitionBy("source", "shard").orderBy("turn", "rid", "copy", "first")
        before = F.coalesce(F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = blocks.withColumn("before", before)
        same = F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.shard") == F.col("b.shard"))
        #: (shard, turn, rid, copy, first, words): the blocks drawn for the remainders; a shard's order is by turn.
        self.drawn = (
            ranked.alias("b")
            .join(quotas.alias("q"), same)
            .where("b.before < q.quota")
            .select("b.shard", "b.turn", "b.rid", "b.copy", "b.first", F.least(F.col("b.words"), F.col("q.quota") - F.col("b.before")).alias("words"))
        )

        whole = self.sources.where("passes > 0").select("source", "passes")
        repeated = (
            blocks.alias("b")
            .join(F.broadcast(whole).alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
            .select("b.rid", "b.copy", "b.first", "b.words", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)).alias("pass"))
            .withColumn("turn", F.xxhash64("rid", "copy", "first", "pass", F.lit(seed)))
            .withColumn("shard", F.pmod(F.xxhash64("turn", F.lit(1)), F.lit(shards)).cast("int"))
        )
        #: (shard, turn, pass, rid, copy, first, words): every block of the mix; pass -1 is the remainder.
        self.placed = repeated.select("shard", "turn", "pass", "rid", "copy", "first", "words").unionByName(self.drawn.withColumn("pass", F.lit(-1)))

    def documents(self) -> DataFrame:
        """(rid, copy, doc_id, source, size, source_size, target, taken) for every document, counted from the placed blocks."""
        return self._documents(self.placed)

    def _documents(self, placed: DataFrame, *more) -> DataFrame:
        words = placed.groupBy("rid", "copy").agg(F.sum("words").alias("drawn"), *[column.alias(name) for name, column in more])
        base, src = self.base.alias("d"), self.sources.alias("s")
        return (
            base.join(F.broadcast(src), F.col("d.source").eqNullSafe(F.col("s.source")))
            .drop(F.col("s.source"))
            .join(words, ["rid", "copy"], "left")
            .select("rid", "copy", "doc_id", "source", "size", "source_size", "target", F.coalesce("drawn", F.lit(0)).cast("long").alias("taken"), *[name for name, _ in more])
        )

    def _joined(self, placed: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, Column]:
        """The rows of docs that blocks are taken of, and the struct that says which: documents' columns and `slices` of the fields."""
        rid, found = fresh(self.docs, "__rid", "__mix")
        listed = F.sort_array(F.collect_list(F.struct(*fields)))
        per = self._documents(placed, ("slices", listed)).where("taken > 0")
        per = per.select(F.col("rid").alias(f"{found}rid"), F.struct("size", "source_size", "target", "taken", "slices").alias(found))
        i, t, s = (F.col(f"`{c}`") for c in self.columns)
        docs = self.docs.withColumn(rid, F.xxhash64(i, s.cast("string"), t))
        repeated = stored(self.base.where("copy = 1").select(F.col("rid").alias(rid)), "mix-repeated")
        if (n := repeated.count()) > 0:
            # Of rows that repeat one is kept, on the map side first, and meets the blocks of each: no task holds all copies of a text.
            these = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated.hint("merge")
            whole = F.first(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns])).alias(found)
            one = docs.join(these, rid, "left_semi").groupBy(rid).agg(whole).select(f"{found}.*", rid)
            docs = docs.join(these, rid, "left_anti").select(*one.columns).unionByName(one)
        # Always a merge join, whose cost follows the input.
        return docs.join(per.hint("merge"), F.col(rid) == F.col(f"{found}rid")), F.col(found)

    def output(self) -> DataFrame:
        """(shard, place, doc_id, source, pass, first, words, text): the mix itself, a slice of `words` words from word `first` on in each row.

        place counts from 1 in each shard. pass is -1 for what is drawn for a remainder.
        """
        order = Window.partitionBy("shard").orderBy("turn", "rid", "copy", "first", "pass")
        placed = self.placed.withColumn("place", F.row_number().over(order))
        joined, found = self._joined(placed, ("pass", "first", "words", "shard", "place"))
        i, t, s = (F.col(f"`{c}`") for c in self.columns)
        each = joined.select(i.cast("long").alias("doc_id"), t.alias("text"), s.cast("string").alias("source"), found["slices"].alias("slices"))

        def run(batches):
            import pyarrow as pa

            kinds = {"shard": pa.int32(), "place": pa.int32(), "doc_id": pa.int64(), "source": pa.string(), "pass": pa.int32(), "first": pa.int64(), "words": pa.int64(), "text": pa.string()}

            def items():
                for d, text, source, wanted in rows(batches, "doc_id", "text", "source", "slices"):
                    for w, piece in zip(wanted, slices(text, wanted), strict=True):
                        yield w["shard"], w["place"], d, source, w["pass"], w["first"], w["words"], piece

            yield from in_batches(pa.schema(list(kinds.items())), items())

        out = each.mapInArrow(run, "shard int, place int, doc_id long, source string, pass int, first long, words long, text string")
        return out.repartition("shard").sortWithinPartitions("shard", "place")

    def taken_rows(self) -> DataFrame:
        """The rows of docs that the mix takes words of, with size, source_size, target and taken added.

        A row's text is what the mix takes of it: the drawn slices, then each whole pass. Columns of docs called like one of those four are replaced.
        Rows that repeat in id, source and text have their other columns from one of them.
        """
        added = ("size", "source_size", "target", "taken")
        joined, found = self._joined(self.placed, ("pass", "first", "words"))
        kept = [F.col(f"`{c}`") for c in self.docs.columns if c not in added]
        (wanted,) = fresh(self.docs, "__slices")
        out = joined.select(*kept, *[found[c].alias(c) for c in added], found["slices"].alias(wanted))
        schema, at = out.drop(wanted).schema, out.columns.index(self.columns[1])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    columns = batch.slice(start, 500).columns
                    texts = [together(t, w) for t, w in zip(columns[at].to_pylist(), columns[-1].to_pylist(), strict=True)]
                    columns[at] = pa.array(texts, columns[at].type)
                    yield pa.RecordBatch.from_arrays(columns[:-1], batch.schema.names[:-1])

        return out.mapInArrow(run, schema)


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size is the text's words (runs of characters other than blanks; null: 0),
    source_size and target are the source's, taken is how many words the mix takes of the row, at most `most` times size. A null source is
    a source, the last one. Rows that repeat are documents of their own. An
    empty table gives no rows.
    """
    return Mixture(docs, **options).documents().select("doc_id", "size", "source_size", "target", "taken")
