"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile ranks the character n-grams (1 to 4 characters, of lower-cased words
padded with a blank on either side) of a text by how often they occur. An
n-gram's rank is the number of n-grams strictly more frequent, so ties need no
order; a profile keeps ranks under `profile` (400). The distance of a document
to a language is the sum, over the document's profile, of how far each n-gram is
out of place in the language's profile, an absent one counting `profile`. The
nearest language wins, ties going to the first by code point.

An n-gram is one 64-bit key, 16 bits for each of its characters (characters
beyond the basic plane share keys with others), so that a text's n-grams are
counted by sorting one array.

Scale. Language profiles are fitted on at most `train_docs` distinct labelled
texts per language (drawn by a hash at a rate set by a sketched count per
language; copies count once, so a hot text is one example);
they are a few hundred rows per language and the only thing
sent to executors. Prediction is a map over documents without any shuffle. Long
texts are counted in chunks, so memory follows the distinct n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, pick, rows

ORDERS = 4
PROFILE = 400
TRAIN_DOCS = 4_000
MAX_LANGUAGES = 5_000
UNKNOWN = "und"
#: Letters are the characters of Unicode category L; the second pass takes out numbers such as ½ or Ⅷ, which only texts beyond ASCII have.
NO_LETTERS, NUMBERS = re.compile(r"[\W\d_]+"), regex.compile(r"\P{L}+")
#: A sample aims at this share of its bound, since the count of distinct texts is a sketch's and the draw is by chance.
MARGIN = 0.9
CHUNK = 1 << 18

Counts = tuple[np.ndarray, np.ndarray]
NONE: Counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merged(parts: list[Counts]) -> Counts:
    """One table of keys and counts from several, sorted by key."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def letters_of(text: str | None) -> str:
    """The text's lower-cased runs of letters with one blank between."""
    words = NO_LETTERS.sub(" ", (text or "").lower())
    return (words if words.isascii() else NUMBERS.sub(" ", words)).strip()


def grams(text: str | None) -> Counts:
    """The text's n-grams as keys, sorted, and how often each occurs."""
    words = letters_of(text)
    if not words:
        return NONE
    blank, parts = np.uint64(32), []
    for at in range(0, len(words) + 2, CHUNK):
        # A chunk's n-grams are those that start in it; blanks stand at both ends of the text.
        piece = f" {words} "[at : at + CHUNK + ORDERS - 1] if len(words) + 2 > CHUNK else f" {words} "
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
        starts, found, inside, key = min(len(c), CHUNK), [], np.ones(len(c), bool), c
        letter = c != blank
        for n in range(1, ORDERS + 1):
            if n > 1:
                if len(key) < 2:
                    break
                # The last character of the shorter n-gram becomes an inner one, which no blank may be.
                inside = inside[:-1] & letter[n - 2 : len(c) - 1] if n > 2 else inside[:-1]
                key = (key[:-1] << np.uint64(16)) | c[n - 1 :]
            keep = inside & letter if n == 1 else inside
            found.append(key[:starts][keep[:starts]])
        keys = np.sort(np.concatenate(found))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        parts.append((keys[first], np.diff(np.append(first, len(keys)))))
    return parts[0] if len(parts) == 1 else merged(parts)


def ranked(counts: Counts, profile: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of rank under `profile`, and their ranks."""
    keys, n = counts
    if not len(keys):
        return keys, n
    rising = np.sort(n)
    keep = n >= rising[-min(profile, len(n))]
    return keys[keep], len(n) - np.searchsorted(rising, n[keep], "right")


class Profiles:
    """Language profiles as one matrix: a row per n-gram, sorted by key, and a column per language."""

    def __init__(self, ranks: Iterable[tuple[str, int, int]], profile: int = PROFILE):
        ranks = list(ranks)
        self.profile, self.langs = profile, sorted({r[0] for r in ranks})
        column = {x: i for i, x in enumerate(self.langs)}
        self.keys = np.unique(np.array([r[1] for r in ranks], np.int64).view(np.uint64))
        #: The last row stands for n-grams that no language has.
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in ranks:
            self.ranks[np.searchsorted(self.keys, np.array([gram], np.int64).view(np.uint64))[0], column[lang]] = rank

    def predict(self, counts: Counts) -> tuple[str, float]:
        keys, rank = ranked(counts, self.profile)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        theirs = self.ranks[np.where(self.keys[at] == keys, at, len(self.keys))]
        apart = np.where(theirs < 0, self.profile, np.abs(theirs - rank[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], max(0.0, 1.0 - float(apart[best]) / (len(keys) * self.profile))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> Profiles:
    """Profiles of every non-null language in train, from at most train_docs distinct texts of each.

    More than MAX_LANGUAGES distinct languages is an error: the profiles are sent to executors.
    """
    named = pick(train, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("turn", F.xxhash64("text", F.lit(11)))
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("turn", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles([], profile)
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, MARGIN * train_docs / max(1, r["n"]))))])
    chance = F.pmod("turn", F.lit(1_000_003)) / F.lit(1_000_003.0)
    # Copies meet on the map side; the few texts that are left are spread over tasks again.
    chosen = named.where(chance < rate[F.col("lang")]).groupBy("lang", "turn").agg(F.min("text").alias("text")).repartition(32, "turn")

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        held: dict[str, list[Counts]] = {}

        def flush():
            for lang, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], schema=schema)
            held.clear()

        size = 0
        for lang, text in rows(batches, "lang", "text"):
            own = grams(text)
            held.setdefault(lang, []).append(own)
            size += len(own[0])
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"))) - 1
    top = counts.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < profile)
    return Profiles(((r["lang"], r["gram"], r["rank"]) for r in top.collect()), profile)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs; nothing but the text decides.

    A text that is null, empty or without letters, or profiles without any
    language, give `und` and 0. score is 1 for the very profile of a language
    and 0 where no n-gram is in it. Repeated rows are kept; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        import pyarrow as pa

        known = sent.value
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        yield from in_batches(schema, ((d, *known.predict(grams(t))) for d, t in rows(batches, "doc_id", "text")), 20_000)

    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language cannot be told (`und`); columns are unchanged.

    If no language was learned nothing can be told apart, and only texts without letters go.
    """
    sent, schema, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = sent.value
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                counts = grams(t)
                keep.append(bool(len(counts[0])) and (not known.langs or known.predict(counts)[0] != UNKNOWN))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
