from __future__ import annotations

import time
from collections import defaultdict

from tallyloom.llm import linededup

from .conftest import EDGE, documents


def plain(rows, min_sites=6, short_sites=12, short_chars=16):
    """(id, text, removed) by brute force; rows in the order of ids, which are distinct."""
    sites, first = defaultdict(set), {}
    for d, t, _, s in rows:
        for at, line in enumerate((t or "").split("\n")):
            key = line.strip(" \t\r")
            if key:
                sites[key].add(s)
                first[key] = min(first.get(key, (d, at)), (d, at))
    out = []
    for d, t, _, _ in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        lines = t.split("\n")
        keys = [x.strip(" \t\r") for x in lines]
        lost = {at for at, x in enumerate(keys) if x and len(sites[x]) >= (min_sites if len(x) >= short_chars else short_sites) and first[x] != (d, at)}
        out.append((d, "\n".join(x for at, x in enumerate(lines) if at not in lost), len(lost)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        lines = [f"A line of its own number {i} here", "  All rights reserved by everyone\r", f"Shared by some sites {i % 9} times"]
        lines += ["short line"] * (i % 3) + ["Les."] * (i % 10 < 4) + ["", "  "] + ["Twice in one document it is said"] * (2 if i % 2 else 1)
        rows.append((i, "\n".join(lines), "en", None if i % 11 == 0 else f"s{i % 11}"))
    rows += [(200 + i, "The end.\nfour", "en", f"t{i}") for i in range(12)] + [(220 + i, "four", "en", f"u{i % 2}") for i in range(6)]
    rows += [(100, None, "en", "s1"), (101, "", "en", "s2"), (102, "All rights reserved by everyone", "en", "s3")]
    rows = sorted(rows)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(documents(spark, rows)).collect())
    assert got == plain(rows)
    assert sum(x[2] for x in got) > 60
    by = {d: t for d, t, _ in got}
    # Short lines go from twelve sites on, and "short line" with eleven of them stays.
    assert by[200] == "The end.\nfour" and by[205] == "" and "short line" in by[2] and by[225] == ""


def test_cost_is_linear_in_the_lines(spark):
    """Twice the lines of one document take about twice the time, many of them lost."""

    def took(n):
        # Every other line is boilerplate that another site has first.
        text = "\n".join(f"line number {i // 2} that all sites have" if i % 2 else f"own line {i} of this one" for i in range(n))
        shared = "\n".join(f"line number {i} that all sites have" for i in range(n // 2))
        docs = spark.createDataFrame([(s, shared, "en", f"s{s}") for s in range(2)] + [(9, text, "en", "s9")], "doc_id long, text string, lang string, source string").repartition(1).cache()
        docs.count()
        start = time.perf_counter()
        (row,) = [r for r in linededup.dedup_lines(docs, min_sites=2).collect() if r.doc_id == 9]
        assert row.n_removed == n // 2 and row.n_lines == n and row.text.count("\n") == n // 2 - 1
        return time.perf_counter() - start

    took(2_000)
    assert min(took(64_000) for _ in range(2)) <= 2.5 * max(1.0, min(took(32_000) for _ in range(2)))


def test_sketch_and_exact_counts_agree_at_the_threshold(spark):
    spread = ((1, 5, 6), (2, 6, 6), (3, 7, 6), (4, 11, 6), (5, 12, 6), (6, 400, 6), (7, 1, 6), (8, 11, 12), (9, 12, 12), (10, 24, 12), (11, 6, 12))
    lines = [(k, -k, least, s) for k, n, least in spread for s in range(n) for _ in range(3)]
    got = {r.k1 for r in linededup.boilerplate(spark.createDataFrame(lines, "k1 long, k2 long, least int, site long")).collect()}
    assert got == {2, 3, 4, 5, 6, 9, 10}


def test_edge_cases(edge, empty):
    got = linededup.dedup_lines(edge, min_sites=2, short_sites=2)
    assert got.count() == len(EDGE)
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0
    assert by[2][0].text == "" and by[2][0].n_lines == 1
    # Rows that repeat keep their line, being the first together; the other site's copy goes.
    assert [r.text for r in by[5]] == [EDGE[5][1]] * 2 and by[6][0].text == ""
    assert by[7][0].text == EDGE[8][1]
    assert linededup.dedup_lines(empty).count() == 0
