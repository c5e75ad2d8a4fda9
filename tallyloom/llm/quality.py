"""Text quality without labels: a weak-label model over heuristics, and a hashed linear scorer.

Nine heuristic labellers vote good, bad or nothing on each text. Their votes
overlap and none is trusted: expectation-maximisation over the counts of all
vote patterns estimates, for each labeller, how it votes on good and on bad
texts, and the share of good texts. The posterior of a text's pattern is its
soft label, and the labels of all documents train a linear scorer over hashed words
and shape features, which generalises beyond the heuristics. The score from which a text is
kept is the best one over all documents, each scored by a model that has not seen its text.

Scale. Texts are parsed once, to a vote pattern and packed features (two bytes a distinct word), which are
stored. What the label model needs is the count of
each pattern, at most 3**9 = 19,683 rows whatever the corpus, summed with partial
aggregation. The scorer is logistic regression: a pass over the features of all documents gives the exact loss and
gradient of the three models (one of all texts, one of each half of them), added up in whole numbers, so neither
order nor partitions matter; ROUNDS passes are made. A pass reads the features in leaves of LEAF_BYTES, each of which sends at most
3 * (buckets + 1) sums, cut into SLICES that are added up on executors; the driver gets one vector for each model.
The threshold comes from counts of all documents by score: scores are multiples of 2**-SCORE_BITS in log-odds, so they have 71,681 values at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_batches, pick, rows, stored
from .linear import Descent, Hasher, Linear, best_threshold, sigmoid, snapped

BUCKETS = 1 << 18
LABELLERS = ("symbols", "capitals", "exclaim", "repeats", "cells", "endings", "word_length", "length", "function_words")
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset("the of and to in a is that for it on was with as are de la le les et des en un une du que el los las y por con der die das und den von zu mit ist".split())
RUNS = re.compile(r"[^\w\s]{3,}")
#: Passes over all documents; strength of the squared penalty; bits after the point of final weights, and of the terms of sums.
ROUNDS, L2, SCORE_BITS, SUM_BITS = 20, 1.0, 10, 20
#: Bytes of features that one task of a pass reads, once there are more than six tasks; parts that sums are cut into; bucket numbers unpacked at once.
LEAF_BYTES, SLICES, CHUNK = 128_000_000, 16, 1_000_000
BINS = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)


def repeated_fives(words: list[str]) -> float:
    """The share of runs of five words that are there already; runs are told apart by 64-bit hashes, eight bytes each."""
    n = len(words) - 4
    if n < 15:
        return 0.0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.uint64, len(words))
    runs = ids[:n].copy()
    for i in range(1, 5):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    return 1 - len(np.unique(runs)) / n


def measures(text: str) -> dict[str, float]:
    """Shares that the labellers look at, each 0 or more. Beside its words, a text takes a few bytes a word, however long it is."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "symbols": sum(1 for _ in RUNS.finditer(text)) / n,
        "capitals": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "exclaim": text.count("!") / n,
        "repeats": repeated_fives(words),
        "cells": text.count("|") / n,
        "endings": sum(x.rstrip()[-1] in ".?!\"'”’»)" for x in lines) / max(1, len(lines)),
        "word_length": sum(map(len, words)) / n,
        "length": float(len(words)),
        "function_words": sum(w.lower() in FUNCTION_WORDS for w in words) / n,
    }


def votes(m: dict[str, float]) -> list[int]:
    """0 bad, 1 good, 2 no vote, for each of LABELLERS. Those that look for a fault have nothing to say of a text without it."""
    fault = lambda k, least: 0 if m[k] >= least else 2
    short = m["length"] < 8
    return [
        fault("symbols", 0.1),
        2 if short else fault("capitals", 0.3),
        fault("exclaim", 0.15),
        2 if m["length"] < 20 else fault("repeats", 0.2),
        fault("cells", 0.1),
        2 if m["length"] < 20 else 1 if m["endings"] >= 0.8 else 0 if m["endings"] < 0.4 else 2,
        1 if 2.5 <= m["word_length"] <= 9 else 0 if m["word_length"] > 12 or m["word_length"] < 1.8 else 2,
        0 if m["length"] < 3 else 1 if m["length"] >= 30 else 2,
        2 if m["length"] < 20 else 1 if m["function_words"] >= 0.08 else 0 if m["function_words"] < 0.02 else 2,
    ]


def code(found: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(found))


def decode(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS))]


class LabelModel:
    """Posterior of good for each vote pattern, by expectation-maximisation over pattern counts."""

    def __init__(self, counts: dict[int, int], rounds: int = 100, smooth: float = 1.0):
        self.prior, self.tables = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
        patterns = sorted(counts)
        if patterns:
            v, c = np.array([decode(p) for p in patterns]), np.array([counts[p] for p in patterns], float)
            bad, good = (v == 0).sum(axis=1), (v == 1).sum(axis=1)
            # To begin with, a vote for bad outweighs all those for good: one fault is enough.
            q = 1 / (1 + np.exp(np.clip(3.0 * bad - 0.5 * good, -20, 20)))
            for _ in range(rounds):
                self.prior = float(np.clip((c * q).sum() / c.sum(), 0.01, 0.99))
                for y, weight in ((0, c * (1 - q)), (1, c * q)):
                    for value in range(3):
                        self.tables[y, :, value] = ((v == value) * weight[:, None]).sum(axis=0) + smooth
                self.tables /= self.tables.sum(axis=2, keepdims=True)
                new = self._posterior(v)
                if np.abs(new - q).max() < 1e-9:
                    break
                q = new

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        each = np.arange(len(LABELLERS))
        # A labeller that has not voted says nothing either way.
        told = np.where(v == 2, 0.0, np.log(self.tables[1, each, v] / self.tables[0, each, v]))
        odds = np.log(self.prior / (1 - self.prior)) + told.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))

    def posterior(self, pattern: int) -> float:
        return float(self._posterior(np.array([decode(pattern)]))[0])

    def posteriors(self) -> np.ndarray:
        """Of all patterns, by their code."""
        return self._posterior(np.array([decode(p) for p in range(3 ** len(LABELLERS))]))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller, when it votes, is right by the model."""
        right = self.prior * self.tables[1, :, 1] + (1 - self.prior) * self.tables[0, :, 0]
        wrong = self.prior * self.tables[1, :, 0] + (1 - self.prior) * self.tables[0, :, 1]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist(), strict=True))


def features(hasher: Hasher, text: str, m: dict[str, float]) -> np.ndarray:
    """Buckets of the distinct words and of each measure's bin."""
    shape = [hasher.of(f"\0{k}:{int(np.searchsorted(BINS, m[k], 'right'))}") for k in LABELLERS if k not in ("length", "word_length")]
    shape += [hasher.of(f"\0length:{int(m['length']).bit_length()}"), hasher.of(f"\0word_length:{min(20, int(m['word_length']))}")]
    return np.union1d(hasher.words(text), shape)


def packed(index: np.ndarray, buckets: int) -> bytes:
    """Ascending bucket numbers in two bytes each, after the count of those in each 65,536 buckets."""
    counts = np.bincount(index >> 16, minlength=(buckets + 65_535) >> 16).astype("<u4")
    return counts.tobytes() + (index & 65_535).astype("<u2").tobytes()


def unpacked(column, buckets: int):
    """(first row, row after the last, bucket numbers, how many each row has) of an Arrow column of packed features, about CHUNK numbers at a time."""
    import pyarrow.compute as pc

    parts, at = (buckets + 65_535) >> 16, 0
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)]) // 2
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        own = np.frombuffer(b"".join(column.slice(at, to - at).to_pylist()), "<u2")
        heads = (ends[at:to] - ends[at])[:, None] + np.arange(2 * parts)
        counts = np.ascontiguousarray(own[heads]).view("<u4").astype(np.int64)
        body = np.ones(len(own), bool)
        body[heads.ravel()] = False
        yield at, to, own[body] + (np.repeat(np.tile(np.arange(parts), to - at), counts.ravel()) << 16), counts.sum(axis=1)
        at = to


def described(docs: DataFrame, id_col: str | None = None, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, half, pattern, features) for every row of docs: equal texts are in the same half, features are packed; without id_col, ids are null."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(buckets)
        schema = pa.schema([("doc_id", pa.int64()), ("half", pa.int8()), ("pattern", pa.int32()), ("features", pa.binary())])

        def items():
            for d, h, t in rows(batches, "doc_id", "half", "text"):
                m = measures(t or "")
                yield d, h, code(votes(m)), packed(features(hasher, t or "", m), buckets)

        yield from in_batches(schema, items())

    texts = pick(docs, doc_id=id_col, text=text_col) if id_col else pick(docs, text=text_col).withColumn("doc_id", F.lit(None))
    texts = texts.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("byte").alias("half"), "text")
    return texts.mapInArrow(run, "doc_id long, half byte, pattern int, features binary")


def by_half(batches, buckets: int):
    """(half, patterns, bucket numbers, how many each row has) of batches of described(), one half and about CHUNK numbers at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for h in (0, 1):
            own = batch.filter(pc.equal(batch.column("half"), pa.scalar(h, pa.int8())))
            pattern = own.column("pattern").to_numpy()
            for at, to, x, n in unpacked(own.column("features"), buckets):
                yield h, pattern[at:to], x, n


def margins(w: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[x], np.cumsum(n) - n) + w[-1]


def sums(seen: DataFrame, posterior: np.ndarray, w: np.ndarray | None, leaves: int, buckets: int) -> np.ndarray:
    """Gradient and loss of three models over all rows of described(); their last two columns are the bias and the loss.

    w[0] is the model of all rows, w[1 + h] that of the rows that aren't in half h. Without w, each feature has the sum of the lengths of
    its rows, bias included, a quarter of which bounds the second derivatives. Terms are rounded to whole numbers of 2**-SUM_BITS.
    """
    spark, unit, width = seen.sparkSession, 2.0**SUM_BITS, -(-(buckets + 2) // SLICES)
    sent = spark.sparkContext.broadcast((w, posterior))
    kind = "slice int, sums binary"

    def rows_of(total: np.ndarray, known) -> Iterator:
        import pyarrow as pa

        # The bytes of equal weight stand together: most of the high ones are zero, which shuffles compress.
        parts = [(s, np.ascontiguousarray(total[:, s * width : (s + 1) * width]).view(np.uint8).reshape(-1, 8).T.tobytes()) for s in known]
        yield from in_batches(pa.schema([("slice", pa.int32()), ("sums", pa.binary())]), iter(parts))

    def leaf(batches):
        (w, posterior), total = sent.value, np.zeros((3, width * SLICES))
        for h, pattern, x, n in by_half(batches, buckets):
            row, y = np.repeat(np.arange(len(n)), n), posterior[pattern]
            for k in (0, 2 - h):
                if w is None:
                    off, loss = n + 1.0, np.zeros(1)
                else:
                    m = margins(w[k], x, n)
                    off, loss = np.round((sigmoid(m) - y) * unit), np.round((np.logaddexp(0, m) - y * m) * unit)
                total[k, :buckets] += np.bincount(x, off[row], buckets)
                total[k, buckets : buckets + 2] += off.sum(), loss.sum()
        yield from rows_of(total.astype(np.int64), range(SLICES))

    def read(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).reshape(3, width)

    def add(batches):
        total, known = np.zeros((3, width * SLICES), np.int64), set()
        for s, data in rows(batches, "slice", "sums"):
            total[:, s * width : (s + 1) * width] += read(data)
            known.add(s)
        yield from rows_of(total, sorted(known))

    out = np.zeros((3, width * SLICES))
    parts = seen.select("half", "pattern", "features").coalesce(leaves).mapInArrow(leaf, kind)
    for r in (parts if leaves == 1 else parts.repartition(SLICES, "slice").mapInArrow(add, kind)).collect():
        out[:, r["slice"] * width : (r["slice"] + 1) * width] = read(bytes(r["sums"]))
    sent.destroy()
    return out[:, : buckets + 2] / (1 if w is None else unit)


def unseen(seen: DataFrame, posterior: np.ndarray, w: np.ndarray, buckets: int) -> list:
    """(cell, n, bad) over all rows of described(): scores by a model that has not seen the text, as whole multiples of 2**-SCORE_BITS in log-odds."""
    sent = seen.sparkSession.sparkContext.broadcast((w, posterior))

    def run(batches):
        import pyarrow as pa

        w, posterior = sent.value
        schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("bad", pa.int64())])
        for h, pattern, x, n in by_half(batches, buckets):
            cell = (np.clip(margins(w[1 + h], x, n), -35, 35) * 2**SCORE_BITS).astype(np.int32)
            known, at = np.unique(cell, return_inverse=True)
            bad = np.bincount(at, posterior[pattern] < 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.bincount(at)), pa.array(bad)], schema=schema)

    cells = seen.select("half", "pattern", "features").mapInArrow(run, "cell int, n long, bad long")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()
    sent.destroy()
    return sorted((r["cell"], r["n"], r["bad"]) for r in found)


class Scorer:
    """A fitted label model, its linear scorer, and the score from which a text is kept."""

    def __init__(self, labels: LabelModel, linear: Linear, buckets: int, threshold: float = 0.5):
        self.labels, self.linear, self.buckets, self.threshold = labels, linear, buckets, threshold


def fitted(seen: DataFrame, buckets: int = BUCKETS, train_docs: int | None = None) -> Scorer:
    """The scorer of the rows of described(), which should be stored."""
    found = seen.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.octet_length("features")).alias("held")).collect()
    labels = LabelModel({r["pattern"]: r["n"] for r in found})
    if train_docs is not None:
        return sampled(seen, labels, buckets, train_docs)
    held, posterior = sum(r["held"] for r in found), labels.posteriors()
    leaves = max(1, min(6, held // 8_000_000), -(-held // LEAF_BYTES))
    models = [Descent(bend / 4, L2) for bend in sums(seen, posterior, None, leaves, buckets)[:, :-1]]
    for _ in range(ROUNDS if found else 0):
        for model, total in zip(models, sums(seen, posterior, np.stack([m.x for m in models]), leaves, buckets), strict=True):
            model.tell(float(total[-1]), total[:-1])
    w = snapped(np.stack([m.at for m in models]), SCORE_BITS)
    cells = np.array(unseen(seen, posterior, w, buckets), float).reshape(-1, 3)
    linear = Linear(buckets)
    linear.w = w[0]
    # The threshold is the best one for finding bad texts among those that a model has not seen.
    return Scorer(labels, linear, buckets, 1 - best_threshold(sigmoid(-cells[:, 0] / 2**SCORE_BITS), cells[:, 2], cells[:, 1]))


def sampled(seen: DataFrame, labels: LabelModel, buckets: int, train_docs: int) -> Scorer:
    """As fitted(), but scorer and threshold come from train_docs distinct feature sets at most, those of smallest hash."""
    import pyarrow as pa

    turn = seen.select(F.xxhash64("features").alias("turn"), "half", "pattern", "features")
    first = turn.join(F.broadcast(turn.select("turn").distinct().orderBy("turn").limit(train_docs)), "turn")
    pdf = first.groupBy("turn").agg(F.min("half").alias("half"), F.min("pattern").alias("pattern"), F.min("features").alias("features")).toPandas().sort_values("turn")
    index = [i for _, _, x, n in unpacked(pa.array(map(bytes, pdf["features"]), pa.binary()), buckets) for i in np.split(x, np.cumsum(n)[:-1])]
    y, half, none = labels.posteriors()[pdf["pattern"].to_numpy(int)], pdf["half"].to_numpy(), np.zeros((len(pdf), 0))
    score = np.zeros(len(y))
    for h in (0, 1):
        learn = np.flatnonzero(half != h)
        other = Linear(buckets).fit([index[i] for i in learn], none[learn], y[learn])
        for i in np.flatnonzero(half == h):
            score[i] = other.score(index[i])
    return Scorer(labels, Linear(buckets).fit(index, none, y), buckets, 1 - best_threshold(1 - score, 1 - y))


def fit(docs: DataFrame, text_col: str = "text", train_docs: int | None = None, buckets: int = BUCKETS) -> Scorer:
    """Counts the vote patterns of all docs, trains the scorer on all of them, and takes the threshold that is best for all.

    Each row is an example, repeated ones too. Whoever gives train_docs wants a scorer and threshold of so many distinct texts
    at most; op3_quality doesn't.
    """
    seen = stored(described(docs, None, text_col, buckets), "quality")
    try:
        return fitted(seen, buckets, train_docs)
    finally:
        forget(seen)


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """scored() by the scorer that fit() makes of the same docs, whose texts are parsed once for both."""
    seen = stored(described(docs, id_col, text_col, buckets), "quality")
    return marked(seen, fitted(seen, buckets))


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality, posterior, keep) for every row of docs.

    quality is the linear scorer's probability of good, posterior the label
    model's, keep says whether quality reaches the scorer's threshold. A null text counts as
    empty, which the labellers find too short. Repeated rows are kept and score
    alike. An empty table gives no rows.
    """
    return marked(described(docs, id_col, text_col, scorer.buckets), scorer)


def marked(seen: DataFrame, scorer: Scorer) -> DataFrame:
    """scored() for the rows of described()."""
    sent = seen.sparkSession.sparkContext.broadcast((scorer.linear.w, scorer.labels.posteriors(), scorer.threshold, scorer.buckets))

    def run(batches):
        import pyarrow as pa

        w, posterior, threshold, buckets = sent.value
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("posterior", pa.float64()), ("keep", pa.bool_())])
        for batch in batches:
            pattern = batch.column("pattern").to_numpy()
            for at, to, x, n in unpacked(batch.column("features"), buckets):
                q = sigmoid(margins(w, x, n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(q), pa.array(posterior[pattern[at:to]]), pa.array(q >= threshold)], schema=schema)

    return seen.select("doc_id", "pattern", "features").mapInArrow(run, "doc_id long, quality double, posterior double, keep boolean")
