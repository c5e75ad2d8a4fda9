"""Benchmark contamination by pigeonhole pieces and Myers' bit-parallel edit distance.

Texts are normalised to lower-case runs of letters and digits with one blank
between. An item of m characters may differ from its copy in a document by
k = floor(error_rate * m) edits. It is cut into k + 1 pieces, so a copy within
the budget holds at least one piece unchanged; an Aho-Corasick automaton finds
every exact piece hit in a document, each hit says where the item would lie, and
Myers' algorithm computes the least edit distance of the whole item to any
substring there. Only matches within the budget are reported. Items under
`min_chars` are looked for as whole words without any edit, since a short one
with an edit is another one.

Scale. Documents are mapped over once, without a shuffle, one text in memory at
a time. Distinct items are taken in blocks of about `block_chars` characters,
dealt by a hash, which bounds what the driver and executors hold; equal items
count once, and their ids are joined to the matches afterwards. A benchmark
beyond one block costs one more pass for each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_batches, pick, rows, stored

ERROR_RATE = 0.08
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    """Words of the text as given, lower-cased one by one in effect, so that places can be told from the words' lengths."""
    return " ".join(WORD.findall(text or "")).lower()


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return math.floor(error_rate * length)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of the item, as even as can be, each with its place."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def alphabet(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in the pattern."""
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return bits


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a substring of text, and the first end of one."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph <<= 1
        pv = full & ((mh << 1) | ~(xv | ph))
        mv = ph & xv
    return best, end


class Items:
    """A block of test items (id, normalised text), ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = [(i, t, budget(len(t), error_rate) if len(t) >= min_chars else 0) for i, t in items]
        self.short = [len(t) < min_chars for _, t, _ in self.items]
        self.peq = [(alphabet(t), alphabet(t[::-1])) for _, t, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where[piece].append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, places in where.items():
            self.auto.add_word(piece, (len(piece), places))
        if where:
            self.auto.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Stretches of the text where each hit item may lie within its budget, merged where they overlap."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self.auto.iter(text):
            for n, at in places:
                # A short item is its own piece and has to be whole words.
                if not self.short[n] or (text[last + 1 : last + 2] in ("", " ") and (last + 1 == length or text[last - length] == " ")):
                    starts[n].add(last + 1 - length - at)
        out = {}
        for n, found in starts.items():
            _, t, k = self.items[n]
            if self.short[n]:
                out[n] = [[min(found), min(found) + len(t)]]
                continue
            merged: list[list[int]] = []
            for s in sorted(found):
                a, b = max(0, s - k), min(len(text), s + len(t) + k)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            out[n] = merged
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of each item's best match; places are in the text as given."""
        flat = normalised(text)
        if not flat or not self.items:
            return []
        out, words = [], None
        for n, stretches in self.windows(flat).items():
            item, t, k = self.items[n]
            best = min(((*myers(self.peq[n][0], len(t), flat[a:b]), a) for a, b in stretches), key=lambda x: (x[0], x[1] + x[2]))
            if best[0] <= k:
                end = best[1] + best[2]
                begin = max(0, end - len(t) - k)
                _, back = myers(self.peq[n][1], len(t), flat[begin:end][::-1])
                words = words or Words(text)
                out.append((item, best[0], k, *words.span(end - back, end)))
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


class Words:
    """Where the words of a text lie in it, and in its normalised form, where a character may have become two."""

    def __init__(self, text: str):
        at = 0
        self.places: list[int] = []
        self.spans: list[tuple[int, int]] = []
        for m in WORD.finditer(text):
            self.places.append(at)
            self.spans.append(m.span())
            at += len(m.group().lower()) + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        """A span of the normalised text in the text as given, from the first word it touches to the last."""
        first = max(0, bisect_right(self.places, start) - 1)
        last = max(first, bisect_right(self.places, max(start, end - 1)) - 1)
        return self.spans[first][0], self.spans[last][1]


def _distinct(items: DataFrame) -> DataFrame:
    """(key, flat) of the distinct items(text), without those that have no word; equal ones meet before the shuffle."""

    def flatten(batches):
        import pyarrow as pa

        flat = ((f,) for f in (normalised(t) for (t,) in rows(batches, "text")) if f)
        yield from in_batches(pa.schema([("flat", pa.string())]), flat)

    once = items.where("text IS NOT NULL").groupBy(F.xxhash64("text").alias("same")).agg(F.min("text").alias("text"))
    flat = once.select("text").mapInArrow(flatten, "flat string")
    return flat.groupBy(F.xxhash64("flat").alias("key")).agg(F.min("flat").alias("flat"))


def _blocks(known: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items of known(key, flat) in blocks of about block_chars characters."""
    total = known.agg(F.sum(F.length("flat"))).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    for block in range(count):
        own = known.where(F.pmod(F.xxhash64("key"), F.lit(count)) == block)
        yield sorted((r["key"], r["flat"]) for r in own.collect())


def _found(texts: DataFrame, fields: str, block: list[tuple[int, str]], error_rate: float, min_chars: int) -> DataFrame:
    """(the columns of texts before text, key, distance, budget, start, end) for every match of the block in texts(..., text)."""
    sent = texts.sparkSession.sparkContext.broadcast((block, error_rate, min_chars))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        import pyarrow as pa

        items = Items(*sent.value)
        schema = pa.schema([(c, pa.int64()) for c in (*names, "key", "distance", "budget", "start", "end")])
        yield from in_batches(schema, ((*r[:-1], *m) for r in rows(batches, *names, "text") for m in items.matches(r[-1])), 20_000)

    return texts.mapInArrow(run, f"{fields}, key long, distance long, budget long, start long, end long")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end): one row per document and item found in it.

    start and end are code points of the document's text. Documents without a
    match have no row. Items that are null or have no word are never found, nor
    is anything in a null or empty text; items shorter than min_chars once
    normalised are found as whole words only, at distance 0. Repeated documents and repeated items each
    give their own rows. Ids are integers.
    """
    named = pick(items, item_id=item_col, text=item_text_col)
    slim = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = stored(_distinct(named), "bench-items")
    found = None
    for block in _blocks(known, block_chars):
        part = _found(slim, "doc_id long", block, error_rate, min_chars)
        found = part if found is None else found.unionByName(part)

    def keyed(batches):
        import pyarrow as pa

        schema = pa.schema([("item_id", pa.int64()), ("flat", pa.string())])
        yield from in_batches(schema, ((i, normalised(t)) for i, t in rows(batches, "item_id", "text")))

    ids = named.withColumn("item_id", F.col("item_id").cast("long")).mapInArrow(keyed, "item_id long, flat string").select("item_id", F.xxhash64("flat").alias("key"))
    return found.join(stored(ids, "bench-ids"), "key").select("doc_id", "item_id", "distance", "budget", "start", "end")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item within its budget; columns are unchanged.

    A benchmark of one block is a filter without a shuffle. One of more blocks is looked for block by
    block, so that a task holds one block at a time, and the texts found go by an anti-join.
    """
    known = stored(_distinct(pick(items, text=item_text_col)), "bench-items")
    blocks = _blocks(known, block_chars)
    first, more = next(blocks), next(blocks, None)
    schema, at = docs.schema, docs.columns.index(text_col)
    if more is None:
        sent = docs.sparkSession.sparkContext.broadcast((first, error_rate, min_chars))

        def run(batches):
            import pyarrow as pa

            block = Items(*sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, schema)
    keys = ("a", "b")
    hashes = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(7), c))
    texts = pick(docs, text=text_col).where("text IS NOT NULL").select(*[h.alias(k) for h, k in zip(hashes(F.col("text")), keys, strict=True)], "text")
    gone = None
    for block in chain((first, more), blocks):
        part = stored(_found(texts, "a long, b long", block, error_rate, min_chars).select(*keys).distinct(), "bench-gone")
        gone = part if gone is None else gone.unionByName(part)
    a, b = hashes(F.col(f"`{text_col}`"))
    names = fresh(docs, "__a", "__b")
    gone = gone.distinct().select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    return docs.join(gone.hint("merge"), (a == F.col(names[0])) & (b == F.col(names[1])), "left_anti")
