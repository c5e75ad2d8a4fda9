"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least hash among its inner s-mers is
at its first or last place. Whether a k-mer is an anchor depends on nothing but
itself, so anchors survive any edit elsewhere; k and s are the same for texts of
every length. A fingerprint keeps the anchors whose hash lies in the lowest
1/`SHARE` of the hash range and, where those are fewer than `size`, the `size`
smallest: a uniform sample that grows with the text, so that a passage shared by
two long texts shows. Each anchor has its place, and its n-th occurrence counts
as an anchor of its own. Two fingerprints are compared up to the smaller of the
hashes to which they are complete. Likeness is the share of those hashes that
both have, at a common displacement (positional matching): an estimate of the
resemblance of the texts.

Scale. Fingerprints are a map over documents. Neighbours by doc_id come from one
shuffle of the texts into ranges of ids; each range is closed by a copy of the
next one's first row, and each task streams its sorted rows holding two texts at
a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pick, rows

K, S, SIZE, SHARE = 8, 3, 64, 16
#: Hashes of chosen anchors have 32 bits; those below CUT are kept whatever their number.
CUT = (1 << 32) // SHARE
#: Odd multipliers of the polynomials and of an anchor's occurrence number.
BASE, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomial(c: np.ndarray, width: int) -> np.ndarray:
    n = len(c) - width + 1
    out = c[:n].copy()
    for j in range(1, width):
        out *= BASE
        out += c[j : j + n]
    return _mix(out)


def closed_syncmers(c: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every closed syncmer of code points c, in text order."""
    kmers, w = len(c) - k + 1, k - s + 1
    if kmers < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    smer = _polynomial(c, s)
    least, span = smer, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:kmers], least[w - span : w - span + kmers])
    at = np.flatnonzero((least == smer[:kmers]) | (least == smer[w - 1 : w - 1 + kmers]))
    return _polynomial(c, k)[at] + np.uint64(k), at


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the text's anchors; a text with none is one anchor itself, an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, at = closed_syncmers(c)
    if not len(h) and text:
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.frombuffer(whole, "<u8").astype(np.uint64), np.zeros(1, np.int64)
    return h, at


def fingerprint(text: str | None, size: int = SIZE) -> str:
    """`hash@place` of the chosen anchors by ascending hash, in hexadecimal, joined by commas; empty for no text."""
    h, at = anchors(text or "")
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    # An anchor's n-th occurrence is an element of its own, so that repeated passages count as often as they are there.
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    own = (_mix(h + nth.astype(np.uint64) * AGAIN) >> np.uint64(32)).astype(np.uint32)
    chosen, where = np.unique(own, return_index=True)
    n = max(size, int(np.searchsorted(chosen, CUT)))
    return ",".join(f"{x:08x}@{p:x}" for x, p in zip(chosen[:n].tolist(), at[where[:n]].tolist(), strict=True))


def _parsed(fp: str) -> dict[int, int]:
    return {int(x[:8], 16): int(x[9:], 16) for x in fp.split(",")} if fp else {}


def _complete(found: dict[int, int], size: int) -> int:
    """The hash below which a fingerprint has all anchors of its text; one of fewer than `size` anchors has them all."""
    return 1 << 32 if len(found) < size else max(CUT, max(found) + 1)


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """0 to 1. Two empty fingerprints are alike (1), an empty and another one are not (0)."""
    if a == b:
        return 1.0
    x, y = _parsed(a), _parsed(b)
    if not x or not y:
        return 0.0
    least = min(_complete(x, size), _complete(y, size))
    union = [h for h in x.keys() | y.keys() if h < least]
    moved = [y[h] - x[h] for h in union if h in x and h in y]
    if not moved:
        return 0.0
    shift = min((-n, abs(d), d) for d, n in Counter(moved).items())[2]
    return sum(abs(d - shift) <= K for d in moved) / len(union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) for every row of docs; null texts count as empty and have an empty fingerprint."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        yield from in_batches(schema, ((d, fingerprint(t, size)) for d, t in rows(batches, "doc_id", "text")), 20_000)

    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as many of the first characters of `after`, or all."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealt(slim: DataFrame) -> tuple[DataFrame, int]:
    """slim(doc_id, text) with its range's number and, closing each range, a copy of the next range's first row (last = 1).

    Ranges are cut at approximate quantiles of the ids, one per shuffle partition.
    What reaches the driver is an id or two for each range.
    """
    spark = slim.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = slim.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cut = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    ranged = slim.withColumn("range", F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))))
    first = sorted((r["range"], r["f"]["doc_id"]) for r in ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("f")).collect())
    if not first:
        return ranged.withColumn("last", F.lit(0)), parts
    ids = [d for _, d in first]
    follow = [(r, ids[(i + 1) % len(ids)]) for i, (r, _) in enumerate(first)]
    known = [d for d in ids if d is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    wanted = (wanted | F.col("doc_id").isNull()) if None in ids else wanted
    heads = slim.where(wanted).groupBy("doc_id").agg(F.min("text").alias("text"))
    after = spark.createDataFrame(follow, "range int, head long")
    closing = after.join(heads, F.col("head").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "range", F.lit(1).alias("last"))
    return ranged.withColumn("last", F.lit(0)).unionByName(closing), parts


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document by ascending id.

    The last document is followed by the first, a single one by itself. Null
    ids come first; rows with equal ids are ordered by their texts, so equal rows
    are neighbours. A null text counts as empty. No rows give none.
    """

    def told(doc_id, text, own, after, theirs):
        changed = edited(text, after)
        fp = fingerprint(changed, size)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, fp, likeness(own, fp, size), likeness(own, theirs, size)

    def stream(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        schema = pa.schema(list(zip([x.split()[0] for x in FIELDS.split(", ")], kinds, strict=True)))

        def items():
            held = current = None
            for number, last, doc_id, text in rows(batches, "range", "last", "doc_id", "text"):
                own = fingerprint(text, size)
                if held and number == current:
                    yield told(*held, text, own)
                held, current = None if last else (doc_id, text, own), number

        yield from in_batches(schema, items())

    slim = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, parts = _dealt(slim)
    order = ["range", "last", "doc_id", "text"]
    return dealt.repartitionById(parts, F.col("range")).sortWithinPartitions(*order).mapInArrow(stream, FIELDS)
