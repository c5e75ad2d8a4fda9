from __future__ import annotations

import functools
import random

import numpy as np
import pytest
import xxhash

from tallyloom.llm import simhash

from .conftest import EDGE, documents


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids_fps, radius=4):
    fps = sorted({f for _, f in ids_fps})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in ids_fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted((d, f, least.get(find(f))) for d, f in ids_fps if d is not None)


@pytest.mark.parametrize("text", ["", None, "One", "a B c", "A b\tc\nd e", "Ünï CODÉ w x y z", "a b c d " * 30])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(rng, base, n, most):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("tile", [64, 32_768])
def test_links_have_the_components_of_all_pairs(spark, tile):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    for base in fps[:6]:
        fps += near(rng, base, 150, 5)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x, x) for x in signed], "label long, w0 long"), len(fps), tile=tile).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in links)
    up = {x: x for x in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        up[find(r.a)] = find(r.b)
    groups = {}
    for x in signed:
        groups.setdefault(find(x), set()).add(x & ((1 << 64) - 1))
    want = {}
    for d, _, c in brute(list(enumerate(fps))):
        want.setdefault(c, set()).add(fps[d])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius,blocks", [(4, 5), (4, 6), (4, 8), (2, 3)])
def test_some_mask_covers_every_pair_within_the_radius(radius, blocks):
    rng = random.Random(1)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in simhash.masks(blocks, radius))
        x, m = rng.getrandbits(64), next(m for m in simhash.masks(blocks, radius) if diff & m == 0)
        a, b = simhash.route(np.array([x, x ^ diff], np.uint64), m, 12)
        assert a == b


def test_boundary_search_inside_a_shard_is_exact():
    rng = random.Random(5)
    fps = np.array(sorted(set(near(rng, 12345678901234567, 900, 9))), np.uint64)
    got = {tuple(sorted(p)) for p in simhash.local_links(fps, 4, leaf=32)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        assert int(fps[a] ^ fps[b]).bit_count() <= 4
        up[find(a)] = find(b)
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                assert find(i) == find(j)


def test_edge_cases_against_brute_force(edge):
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(edge).collect() if r.doc_id is not None)
    assert got == brute([(d, plain_fingerprint(t)) for d, t, _, _ in EDGE])
    assert simhash.near_duplicates(edge).count() == len(EDGE)


@functools.cache
def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def resemblance(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def near_copies(rng, n, edits):
    words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
    for _ in range(n):
        own = list(words)
        for _ in range(edits * len(words) // 200):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


def test_similar_texts_are_grouped_and_others_left_alone(spark):
    """Recall of pairs of a similarity of 0.8 or more against brute force, and no unlike texts together."""
    rng = random.Random(11)
    texts = [t for edits in (1, 2, 3, 4) for _ in range(25) for t in near_copies(rng, 4, edits)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), shingle=5, radius=simhash.WIDE_RADIUS, width=4).collect()}
    pairs = [(a, b, resemblance(texts[a], texts[b])) for a in got for b in range(a - a % 4, a)]
    alike = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(alike) > 60 and sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike)
    assert all(d // 4 == c // 4 for d, c in got.items())
    unlike = [(a, b) for a, b, j in pairs if j < 0.5]
    assert sum(got[a] == got[b] for a, b in unlike) <= 0.02 * len(unlike)


def test_trees_are_enough_for_the_recall():
    for n in (10, 10**6, 10**9):
        for reach in (simhash.WIDE_RADIUS, simhash.CANDIDATE_REACH):
            together = (1 - reach / 256) ** simhash.wide_depth(n)
            assert 1 - (1 - together) ** simhash.wide_trees(n, reach) >= simhash.RECALL


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(12)
    rows = [(i, t, "en", "a") for i, t in enumerate(near_copies(rng, 1500, 2))] + [(9000 + i, t, "en", "a") for i, t in enumerate(near_copies(rng, 1, 0))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), shingle=5, radius=simhash.WIDE_RADIUS, width=4).collect()}
    assert sum(got[i] == 0 for i in range(1500)) >= 1490 and got[9000] == 9000


def test_keep_one_keeps_columns_and_the_smallest_id(edge, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 1 in ids and 2 not in ids and ids.count(5) == 2 and 6 not in ids
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_long_chains_settle(spark):
    # Each text's fingerprint is set by hand here: a path of 200 nodes is one component.
    from tallyloom.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[501] == roots[500] == 500


def test_copies_in_great_number(spark):
    rows = [(i, "one text that is copied very often indeed", "en", "a") for i in range(3000)]
    got = simhash.near_duplicates(documents(spark, rows)).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


def test_keep_one_follows_the_true_resemblance(spark):
    """Groups of exact Jaccard 0.8: pairs a little below it stay apart, near fingerprints or not."""
    rng = random.Random(21)
    texts = [t for edits in (3, 4, 5, 6, 7) for _ in range(30) for t in near_copies(rng, 4, edits)]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    below = 0
    for a in range(len(texts)):
        for b in range(a - a % 4, a):
            j = resemblance(texts[a], texts[b])
            below += 0.65 <= j < 0.8
            if j >= 0.8:
                up[max(find(a), find(b))] = min(find(a), find(b))
    want = [find(i) for i in range(len(texts))]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert below > 100 and len(set(want)) < len(texts) - 40
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(got.values()))


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("first", [None, 0, 40, 119])
def test_links_of_sets_have_the_components_of_all_pairs(first):
    rng = random.Random(22)
    base = [rng.sample(range(10**6), 40) for _ in range(6)]
    sets = [np.unique(np.array(rng.sample(b, rng.randint(30, 40)) + [rng.randrange(10**6) for _ in range(rng.randint(0, 6))], np.int64)) for b in base * 20]
    sets[7], sets[9] = np.zeros(0, np.int64), np.array([5], np.int64)
    side = (lambda i, j: True) if first is None else (lambda i, j: (i < first) != (j < first))
    want = [(i, j) for i in range(120) for j in range(i) if side(i, j) and (u := len(a := np.union1d(sets[i], sets[j]))) and (len(sets[i]) + len(sets[j]) - u) / u >= 0.8 and a is not None]
    got = list(simhash.set_links(sets, 0.8, first))
    assert {tuple(sorted(x, reverse=True)) for x in got} <= set(want) and len(got) < 120
    assert components(120, got) == components(120, want) and (first == 0 or want)


def test_a_dense_group_below_the_similarity_is_cut_into_tiles(spark, monkeypatch):
    """Hundreds of texts that are all candidates of one another, most below the similarity: groups by brute force, and a bounded number of links."""
    monkeypatch.setattr(simhash, "GROUP_TILE", 64)
    rng = random.Random(23)
    texts = list(near_copies(rng, 400, 7))
    texts += [" ".join(t.split()[:-1]) for t in texts[:60]]
    want = components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if resemblance(texts[a], texts[b]) >= 0.8])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts) - 40
