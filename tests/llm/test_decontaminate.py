from __future__ import annotations

import random

import pytest

from tallyloom.llm import decontaminate as dc
from tallyloom.llm import queries

from .conftest import EDGE, documents


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any substring, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(above[j - 1] + (p != t), above[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = rng.choice("abcdef ")
            case 1:
                del out[at]
            case _:
                out.insert(at, rng.choice("abcdef "))
    return "".join(out)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        p, t = words(rng, rng.randint(1, 12)), words(rng, rng.randint(0, 20))
        if rng.random() < 0.5:
            t = t + edited(rng, p, rng.randint(0, 4)) + t
        d, end = dc.myers(dc.alphabet(p), len(p), t)
        assert d == plain_distance(p, t)
        assert d == len(p) or plain_distance(p, t[:end]) == d


@pytest.mark.parametrize("length,k", [(40, 2), (100, 6), (33, 0)])
def test_pieces_cover_the_item(length, k):
    item = "".join(chr(97 + i % 26) for i in range(length))
    parts = dc.pieces(item, k)
    assert len(parts) == k + 1 and "".join(p for _, p in parts) == item
    assert all(item[a : a + len(p)] == p for a, p in parts)


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randint(8, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    rows = []
    for d in range(80):
        text = words(rng, 40)
        if d % 2:
            own = rng.choice(items[:12])[1]
            text = f"{text} {edited(rng, own, rng.randint(0, 9))} {words(rng, 20)}"
        rows.append((d, text.replace(" ", rng.choice([" ", "  ", "\n", ", "])).title(), "en", "a"))
    rows += [(502, "It was Too, short! for that", "en", "a"), (503, "tattoo shorts", "en", "a"), (504, "too short", "en", "a")]
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (1, rows[1][1], "en", "a")]
    want = []
    for d, t, _, _ in rows:
        flat = dc.normalised(t)
        for i, item in items:
            p = dc.normalised(item)
            if len(p) >= 20 and flat and plain_distance(p, flat) <= dc.budget(len(p)):
                want.append((d, i, plain_distance(p, flat)))
            elif 0 < len(p) < 20 and f" {p} " in f" {flat} ":
                want.append((d, i, 0))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = dc.contaminated(docs, table).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    assert want and any(x[2] for x in want)
    text = {d: t for d, t, _, _ in rows}
    for r in got:
        piece = dc.normalised(text[r.doc_id][r.start : r.end])
        assert plain_distance(dc.normalised(dict(items)[r.item_id]), piece) == r.distance
    in_blocks = dc.contaminated(docs, table, block_chars=400)
    assert sorted(in_blocks.collect()) == sorted(got)
    clean = dc.keep_clean(docs, table, block_chars=400)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _, _, _ in rows if d not in {x[0] for x in want})


def test_spans_are_of_the_text_as_given(spark):
    """Characters that grow when they are lower-cased don't move the spans behind them."""
    item = "the quick brown fox jumps over the lazy dog again"
    before = "İ" * 30 + " "
    rows = [(1, f"{before}and {item.title()}. İİ", "en", "a"), (2, f"{item} İ", "en", "a"), (3, f"İx {item[:20]}{item[21:]}", "en", "a")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.distance) for r in dc.contaminated(documents(spark, rows), items).collect()}
    assert got == {1: (35, 35 + len(item), 0), 2: (0, len(item), 0), 3: (3, 2 + len(item), 1)}
    assert len(dc.normalised(before).strip()) > 30


def test_equal_items_share_one_place_and_blocks_stay_small(spark):
    rng = random.Random(3)
    same, others = words(rng, 12), [words(rng, 12) for _ in range(40)]
    items = spark.createDataFrame([(i, same) for i in range(2_000)] + [(5_000 + i, t) for i, t in enumerate(others)], "item_id long, text string")
    known = dc._distinct(items)
    assert known.count() == 41
    blocks = list(dc._blocks(known, 500))
    assert sum(map(len, blocks)) == 41 and len(blocks) > 3 and max(sum(len(t) for _, t in b) for b in blocks) < 1_500
    docs = documents(spark, [(1, f"so {same} so", "en", "a"), (2, f"so {others[0]} so", "en", "a"), (3, "clean", "en", "a"), (4, None, "en", "a")])
    got = dc.contaminated(docs, items, block_chars=500).collect()
    assert sorted(r.item_id for r in got if r.doc_id == 1) == list(range(2_000)) and [r.item_id for r in got if r.doc_id == 2] == [5_000]
    assert sorted(r.doc_id for r in dc.keep_clean(docs, items, block_chars=500).collect()) == [3, 4]


def test_edge_cases(spark, edge, empty):
    items = spark.createDataFrame([(1, "the same text twice over and again"), (1, "the same text twice over and again")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(edge, items).collect()) == [(5, 1)] * 4 + [(6, 1)] * 2
    assert dc.keep_clean(edge, items).count() == len(EDGE) - 3
    none = items.limit(0)
    assert dc.contaminated(edge, none).count() == 0 and dc.keep_clean(edge, none).count() == len(EDGE)
    assert dc.contaminated(empty, items).count() == 0 and dc.keep_clean(empty, items).count() == 0


def test_planted_items_are_found(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    text = [(r.item_id, r.text) for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in text if t in d.text}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert want and want <= got


def test_query_against_the_table(spark, sf_dir):
    """Every pair of the query has its textbook distance, and no other pair that shares a word of the item comes within its budget."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    flat = {d.doc_id: dc.normalised(d.text) for d in docs}
    got = {(r.doc_id, r.item_id): r for r in queries.op2_decontamination(spark, sf_dir).collect()}
    assert got
    for i in items:
        item = dc.normalised(i.text)
        for d, text in flat.items():
            if len(text) > 3_000 and (d, i.item_id) not in got:
                continue
            near = plain_distance(item, text) if len(text) <= 3_000 and (d + i.item_id) % 31 == 0 or (d, i.item_id) in got else None
            if near is not None:
                assert (near <= dc.budget(len(item))) == ((d, i.item_id) in got)
                assert near > dc.budget(len(item)) or near == got[d, i.item_id].distance
