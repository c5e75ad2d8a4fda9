from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import mixing, queries

from .conftest import EDGE, documents


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """By the words of the contract: share, stop at three times, share the excess again, until none is above."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    t = {s: total * w[s] / sum(w.values()) for s in order}
    while any(t[s] > most * sizes[s] + 1e-9 for s in order):
        full = {s for s in order if t[s] >= most * sizes[s] - 1e-9}
        excess = sum(t[s] - most * sizes[s] for s in full)
        for s in full:
            t[s] = most * sizes[s]
        rest = [s for s in order if s not in full]
        for s in rest:
            t[s] += excess * w[s] / sum(w[r] for r in rest)
    return t


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"é": 5, "z": 900, "Z": 50, "": 0}, {None: 7}, {"a": 0}])
def test_targets(sizes):
    got, want = mixing.targets(sizes), plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_quotas_are_exact_and_hypergeometric():
    words = [100, 0, 300, 50, 550]
    draws = np.array([mixing.split_quota(words, 400, (n, 1)) for n in range(600)])
    assert (draws.sum(axis=1) == 400).all() and (draws <= words).all() and (draws >= 0).all()
    assert mixing.split_quota(words, 400, (5, 1)) == mixing.split_quota(words, 400, (5, 1))
    n, k = np.array(words), 400
    mean, var = k * n / 1000, k * n / 1000 * (1 - n / 1000) * (1000 - k) / 999
    assert (abs(draws.mean(axis=0) - mean) <= 4 * np.sqrt(var / 600) + 1e-9).all()
    assert (abs(draws.var(axis=0) - var) <= 0.25 * var + 1e-9).all()
    huge = mixing.split_quota([10**12, 3 * 10**12], 10**12, (1,))
    assert sum(huge) == 10**12 and abs(huge[0] / 10**12 - 0.25) < 1e-3
    assert mixing.split_quota([], 0, (1,)) == [] and mixing.split_quota([4], 4, (1,)) == [4]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, size(t)) for d, t, _, _ in rows)
    of = {d: s for d, _, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6
            taken[of[r.doc_id]] += r.taken
    return sizes, want, taken


def test_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 900)), "en", ["a", "b", "c", None, "d"][min(4, i % 9)]) for i in range(400)]
    rows += [(900, "w " * 60_000, "en", "b"), (901, None, "en", "e")]
    docs = documents(spark, rows)
    got = mixing.mix(docs, shard_words=20_000).collect()
    _, want, taken = check(rows, got)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(9), shard_words=20_000).collect()
    assert sorted(got) == sorted(again)


def test_drawn_blocks_are_disjoint_and_meet_the_quota(spark):
    rows = [(i, " ".join(["w"] * (i * 53 % 700)), "en", "ab"[i % 3 > 0]) for i in range(200)]
    mixture = mixing.Mixture(documents(spark, rows), shard_words=5_000)
    blocks = mixture.drawn.collect()
    seen = [(b.rid, b.copy, b.first) for b in blocks]
    assert len(seen) == len(set(seen)) and all(0 < b.words <= mixing.BLOCK_WORDS for b in blocks)
    assert sum(b.words for b in blocks) == sum(r.quota for r in mixture.sources.collect())
    assert len({b.shard for b in blocks}) > 3


def test_edge_cases(spark, edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE)
    check(EDGE, got)
    assert mixing.mix(empty).count() == 0
    kept = mixing.Mixture(edge).taken_rows()
    assert [c for c in edge.columns if c not in ("size", "taken", "target")] == [c for c in kept.columns if c not in ("size", "taken", "target", "source_size")]
    assert sorted((r.doc_id or -1, r.taken) for r in kept.collect()) == sorted((r.doc_id or -1, r.taken) for r in got if r.taken)
    assert mixing.Mixture(empty).taken_rows().count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    _, want, taken = check(rows, queries.op10_mixing(spark, sf_dir).collect())
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_output_holds_the_words_of_all_passes_and_slices(spark):
    """Whole passes are blocks too: every shard has them, and op10's counts are those of the output's texts."""
    rows = [(i, "  " + " ".join(f"d{i}w{j}" for j in range(i * 53 % 1500)), "en", "abc"[min(2, i % 7)]) for i in range(150)]
    rows += [(900, "a b", "en", "b"), (900, "a b", "en", "b")]
    mixture = mixing.Mixture(documents(spark, rows), shard_words=5_000)
    out, counts, text = mixture.output().collect(), mixture.documents().collect(), {d: t for d, t, _, _ in rows}
    assert any(r.passes for r in mixture.sources.collect()) and len({r.shard for r in out if r["pass"] >= 0}) > 3
    taken, passes = defaultdict(int), defaultdict(list)
    for r in out:
        assert r.text.split() == text[r.doc_id].split()[r.first : r.first + r.words] and 0 < r.words <= mixing.BLOCK_WORDS
        taken[r.doc_id] += len(r.text.split())
        passes[r.doc_id, r["pass"]].append((r.first, r.text))
    want = defaultdict(int)
    for r in counts:
        want[r.doc_id] += r.taken
    assert {d: n for d, n in want.items() if n} == dict(taken)
    assert all("".join(t for _, t in sorted(v)) == text[d] for (d, p), v in passes.items() if p >= 0 and d != 900)
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.place)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())
    for r in mixture.taken_rows().collect():
        assert len(r.text.split()) == int(r.taken)


def test_repeated_rows_are_no_hot_group(spark):
    """A third of all rows one and the same: each is a document of its own, and no window deals their texts to one task."""
    rows = [(7, "one text " * 400, "en", "a") if i % 3 == 0 else (100 + i, f"text {i} " * 300, "en", "ab"[i % 2]) for i in range(300)]
    mixture = mixing.Mixture(documents(spark, rows))
    kept = mixture.taken_rows()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    got, want = kept.collect(), [r for r in mixture.documents().collect() if r.taken]
    assert sorted((r.doc_id, int(r.taken)) for r in got) == sorted((r.doc_id, r.taken) for r in want)
    assert all(len(r.text.split()) == int(r.taken) for r in got) and sum(r.doc_id == 7 for r in got) > 50
