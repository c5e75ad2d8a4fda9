from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import queries, syncmers

from .conftest import EDGE

TEXT = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness. " * 3 + "Été, ÿ 中文 \U0001f600 tail of the text that is only here."


def plain_hash(codes):
    x = np.array([codes[0]], np.uint64)
    for c in codes[1:]:
        x = x * syncmers.BASE + np.uint64(c)
    return int(syncmers._mix(x)[0])


@pytest.mark.parametrize("k,s", [(12, 5), (4, 2), (16, 6), (7, 7)])
def test_closed_syncmers_by_their_definition(k, s):
    codes = [ord(c) for c in TEXT]
    small = [plain_hash(codes[i : i + s]) for i in range(len(codes) - s + 1)]
    want = [i for i in range(len(codes) - k + 1) if min(small[i : i + k - s + 1]) in (small[i], small[i + k - s])]
    _, at = syncmers.closed_syncmers(np.array(codes, np.uint64), k, s)
    assert at.tolist() == want


def test_anchors_are_free_of_context():
    h, at = syncmers.anchors(TEXT)
    g, there = syncmers.anchors("Some other words before. " + TEXT[50:300] + " and after")
    inside = {(int(x), int(p) - 50 + 25) for x, p in zip(h, at, strict=True) if 50 <= p <= 300 - syncmers.K}
    assert inside <= {(int(x), int(p)) for x, p in zip(g, there, strict=True)}


def test_likeness():
    f = syncmers.fingerprint
    assert syncmers.likeness(f(TEXT), f(TEXT)) == 1 and syncmers.likeness(f(""), f("")) == 1 and syncmers.likeness(f(""), f(TEXT)) == 0
    assert syncmers.likeness(f(TEXT), f("x" + TEXT)) > 0.9
    other = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    assert syncmers.likeness(f(TEXT), f(other)) < 0.1 < 0.4 < syncmers.likeness(f(TEXT), f(syncmers.edited(TEXT, other)))
    repeated = "One line that comes again.\n" * 200
    assert syncmers.likeness(f(repeated), f(syncmers.edited(repeated, other * 20))) > 0.4
    assert f("") == "" and f(None) == "" and f("ab") and f("ab") != f("ba")


def test_anchors_do_not_depend_on_the_length_of_the_text():
    """Each prefix of a text is like the next longer one: a character more adds an anchor or none."""
    rng = random.Random(4)
    for _ in range(5):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(260))
        fps = [syncmers.fingerprint(text[:n]) for n in range(261)]
        assert all(syncmers.likeness(fps[n], fps[n + 1]) >= 0.6 for n in range(20, 60))
        assert all(syncmers.likeness(fps[n], fps[n + 1]) >= 0.85 for n in range(60, 260))
        assert all(syncmers.likeness(fps[n], fps[n + 2]) >= 0.9 for n in (94, 95, 96, 97, 120, 200))


def plain_likeness(a, b):
    """Of all anchors, by sets and places: the share of the common ones at the commonest displacement."""

    def all_of(text):
        h, at = syncmers.anchors(text)
        seen, out = Counter(), {}
        for x, p in zip(h.tolist(), at.tolist(), strict=True):
            out[x, seen[x]] = p
            seen[x] += 1
        return out

    x, y = all_of(a), all_of(b)
    moved = [y[k] - x[k] for k in x.keys() & y.keys()]
    if not moved:
        return 0.0
    shift = Counter(moved).most_common(1)[0][0]
    return sum(abs(d - shift) <= syncmers.K for d in moved) / len(x.keys() | y.keys())


def test_likeness_of_long_texts_is_near_that_of_all_anchors():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = prose(400)
    long, other = prose(3_000) + passage + prose(3_000), prose(500) + passage + prose(2_000)
    for a, b in ((long, long[: len(long) * 3 // 4] + prose(1_500)), (long, other), (long, passage), (other, passage), (prose(3_000), prose(3_000))):
        assert abs(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - plain_likeness(a, b)) < 0.05
    assert syncmers.likeness(syncmers.fingerprint(long), syncmers.fingerprint(other)) > 0.02


def plain(rows):
    rows = [(d, t or "") for d, t in rows]
    out = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        fp, ef, nf = map(syncmers.fingerprint, (t, e, after))
        out.setdefault(d, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), fp, ef, syncmers.likeness(fp, ef), syncmers.likeness(fp, nf)))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("n", [1, 2, 300])
def test_neighbours_against_a_sorted_list(spark, n):
    rows = [(7 * i % 311, None if i % 50 == 9 else f"Document number {i} says this and that. " * (i % 9)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {}
    for r in syncmers.compared(table).collect():
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert {d: sorted(v) for d, v in got.items()} == plain(sorted(rows))


def test_edge_cases(edge, empty):
    got = syncmers.compared(edge).collect()
    assert len(got) == len(EDGE) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.compared(empty).count() == 0 and syncmers.fingerprints(empty).count() == 0
    same = {r.fingerprint for r in syncmers.fingerprints(edge).collect() if r.doc_id in (5, 6)}
    assert len(same) == 1


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = plain([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)] for r in queries.op7_syncmers(spark, sf_dir).collect()}
    assert got == want
