"""Operators on small inputs: order, ties, empty tables, and what no oracle expresses."""

from __future__ import annotations

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import graph, meetings, notices, relational, sequences, similarity, stores
from tallyloom.streaming import watch


def test_keep_max_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 9.0, 3), (1, 9.0, 2), (2, None, 4)], "k int, v double, o int")
    assert sorted(tuple(r) for r in relational.keep_max(df, ["k"], "v", "o").collect()) == [(1, 9.0, 2), (2, None, 4)]
    assert relational.keep_max(df.limit(0), ["k"], "v", "o").count() == 0


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, "b", 1), (None, "a", 2), ("g", "c", 3)], "g string, n string, s long")
    assert sorted((r.g or "", r.n, r.names) for r in relational.rollup(df, "g", "n").collect()) == [("", 2, ["a", "b"]), ("g", 1, ["c"])]
    assert {(r.g, r["count"], r.bytes) for r in relational.inventory(df, ["g"], "n", "s", least=1).collect()} == {(None, 2, 3), ("g", 1, 3)}
    assert sorted((r.g or "", r.s, r.earlier) for r in relational.recent(df, ["g"], ["s"], 1).collect()) == [("", 2, 1), ("g", 3, 0)]


def test_fill_in_keeps_older_columns(spark):
    rows = [("a", 1, "", ["x"]), ("a", 2, "", ["ignored"]), ("a", 3, "said", []), ("b", 4, "one", ["p"]), ("b", 5, "two", ["q"])]
    df = spark.createDataFrame(rows, "k string, o int, label string, cols array<string>")
    got = {r.k: (r.label, r.cols) for r in relational.fill_in(df, "k", "o", "label", "cols").collect()}
    assert got == {"a": ("said", ["x"]), "b": ("two", ["q"])}


def test_a_day_that_comes_back_is_another_run(spark):
    df = spark.createDataFrame([("r", i, d) for i, d in enumerate("AABAA")], "k string, o int, d string")
    assert [r.run for r in sequences.runs(df, ["k"], ["o"], F.col("d")).orderBy("o").collect()] == [1, 1, 2, 3, 3]


def history(days):
    return [(f"2024-01-{d:02d}T10:00:{n:02d}", s) for d, steps in days for n, s in enumerate(steps)]


def test_repeated_sequences_in_batch_and_stream_agree(spark):
    rng = random.Random(1)
    for _ in range(6):
        steps = history([(d, [rng.choice("abcd") for _ in range(rng.randint(1, 15))]) for d in range(1, 7)])
        df = spark.createDataFrame([("r", i, at, s) for i, (at, s) in enumerate(steps)], "k string, o int, at string, s string")
        got = sequences.repeated_sequence(df, ["k"], ["o"], F.left("at", F.lit(10)), "s").collect()
        want = watch.repeated(steps)
        assert [(tuple(r.sequence), r.days) for r in got] == ([want] if want else [])


def test_import_resolution_tiers(spark):
    paths = ["a/utils.py", "b/utils.py", "src/pay/service.py", "src/pay/types.h", "web/lib/cart.js", "web/app.js", "only.rb"]
    imports = {
        ("web/app.js", "./lib/cart"): "web/lib/cart.js",
        ("web/app.js", "./lib/cart.js"): "web/lib/cart.js",
        ("web/lib/cart.js", "../app"): "web/app.js",
        ("x.py", "utils"): None,
        ("x.py", "a.utils"): "a/utils.py",
        ("x.py", "pay.service"): "src/pay/service.py",
        ("x.rs", "crate::pay::service"): "src/pay/service.py",
        ("x.c", "pay/types.h"): "src/pay/types.h",
        ("x.rb", "only"): "only.rb",
        ("x.py", "os"): None,
    }
    got = graph.resolve(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(list(imports), "importer string, name string"))
    assert {(r.importer, r.name): r.target for r in got.collect()} == imports


def test_reverse_edges_split_tests_and_drop_self(spark):
    edges = spark.createDataFrame([("a.py", "t.py"), ("a.py", "t.py"), ("tests/x.py", "t.py"), ("t.py", "t.py"), ("b.py", None)], "importer string, target string")
    got = graph.reverse_edges(edges, graph.is_test(F.col("importer"))).collect()
    assert [tuple(r) for r in got] == [("t.py", ["a.py"], ["tests/x.py"])]


def test_nested_repositories_go(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("ab/y.py",)], "path string")
    owners = spark.createDataFrame([("a/b",), ("ab",)], "owner string")
    assert [r.path for r in graph.outside_nested(paths, owners).collect()] == ["a/x.py"]


def test_similar_pairs_are_those_of_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["common"]
    sets = [(i, sorted({rng.choice(words[: 12 + i % 29]) for _ in range(rng.randint(5, 25))} | {"common"})) for i in range(120)] + [(900, [f"w{i}" for i in range(9)]), (901, [f"w{i}" for i in range(9)])]
    # Equal sets count once, at their least key, with the other members beside it.
    first = {}
    for i, t in sets:
        first.setdefault(tuple(t), i)
    own = [(i, t) for i, t in sets if first[tuple(t)] == i]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in own for b, y in own if a < b and len(x) >= 8 and len(y) >= 8}
    want = {k: v for k, v in want.items() if v >= 0.55} | {(first[tuple(t)], i): 1.0 for i, t in sets if first[tuple(t)] != i and len(t) >= 8}
    got = similarity.similar_pairs(spark.createDataFrame(sets, "id int, t array<string>"), "id", "t")
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want and (900, 901) in want
    assert similarity.similar_pairs(spark.createDataFrame([], "id int, t array<string>"), "id", "t").count() == 0


def test_meetings_lose_no_pair():
    """Every pair that brute force finds is met, over sizes, thresholds and keys that tokens share."""
    rng = random.Random(7)
    for least in (0.55, 0.8, 0.3):
        base = [sorted(rng.sample(range(400), rng.choice([1, 2, 5, 9, 30, 80, 150]))) for _ in range(40)]
        sets = [set(b) - set(rng.sample(b, len(b) * k // 6)) | set(rng.sample(range(400), k * len(b) // 12)) for b in base for k in range(5)]
        sets = [np.array(sorted(x // 2 if x % 7 == 0 else x for x in s), np.uint32) for s in sets if s]
        n = np.array([len(s) for s in sets])
        keys = [s[:p] for s, p in zip(sets, meetings.prefix_length(n, least), strict=True)]
        cell = meetings.Cell(n, np.append(0, np.cumsum([len(k) for k in keys])), np.concatenate(keys), least)
        both = lambda i, j: sum((collections.Counter(sets[i].tolist()) & collections.Counter(sets[j].tolist())).values())
        want = {(j, i) for i in range(len(n)) for j in range(i) if both(i, j) / (n[i] + n[j] - both(i, j)) >= least}
        found = [(min(p), max(p)) for a, b in cell.pairs(np.arange(len(n))) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert want <= set(found) and len(found) == len(set(found)) and len(want) > 50
        half = np.arange(len(n)) % 2 == 0
        across = {(min(p), max(p)) for a, b in cell.pairs(np.flatnonzero(half), np.flatnonzero(~half)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert {(i, j) for i, j in want if half[i] != half[j]} <= across


def test_candidates_are_few_where_words_are_few(spark, monkeypatch):
    """Sets of few words meet in cells, without a row for each meeting: hardly more pairs come out than are similar."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    sets = [(i, sorted(rng.sample(words, 60))) for i in range(600)]
    sets += [(1000 + i, sorted(set(t[:50]) | {f"new{i}"})) for i, t in sets[:40]]
    want = {(i, 1000 + i) for i in range(40)}
    monkeypatch.setattr(similarity, "CELL_SETS", 100)  # several parts of a class
    rows = similarity.token_sets(spark.createDataFrame(sets, "key int, t array<string>"), "t", "key")
    key = {r.id: r.key for r in rows.collect()}
    met = [tuple(sorted((key[r.x], key[r.y]))) for r in similarity.candidates(rows, ["key"], 0.55).collect()]
    assert want <= set(met) and len(met) == len(set(met)) < 80
    assert {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(sets, "id int, t array<string>"), "id", "t").collect()} == want


def test_families_depend_on_their_founders(spark):
    base = [f"t{i}" for i in range(20)]
    log = [("g", 1, base, "a"), ("g", 2, base[:14], "b"), ("g", 3, base[:9], "c"), ("g", 4, base[9:], "d"), ("h", 5, base, "e")]
    got = similarity.families(spark.createDataFrame(log, "g string, o int, t array<string>, h string"), "g", "o", "t", "h").collect()
    assert sorted(tuple(r) for r in got) == [("g", 1, 3, "a"), ("g", 3, 1, "c"), ("h", 5, 1, "e")]


def test_families_of_many_groups_are_those_of_a_scan(spark):
    """Null groups, equal times, copies, entries without tokens and near copies of near copies."""
    rng = random.Random(9)
    log, at = [], 0
    for g in (None, "a", "b"):
        seen = [[f"t{i}" for i in rng.sample(range(60), 20)] for _ in range(4)]
        for _ in range(60):
            at += 1
            t = rng.choice(seen)
            t = rng.choice([t, [], sorted(set(t[: rng.randint(10, 20)]) | {f"t{i}" for i in rng.sample(range(60), rng.randint(0, 5))})])
            seen.append(t or ["x"])
            log.append((g, at, t, f"h{at}"))
    want = []
    for g in (None, "a", "b"):
        scan = similarity.Families()
        for own, i, t, h in log:
            if own == g:
                scan.join(i, frozenset(t), h)
        want += [(g, *f[:3]) for f in scan.founders]
    rng.shuffle(log)
    got = similarity.families(spark.createDataFrame(log, "g string, o int, t array<string>, h string"), "g", "o", "t", "h")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and max(f[2] for f in want) > 3
    # Texts are dealt by cells; what is left to one task per group is ids.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" in plan


def test_families_find_the_first_founder_as_a_scan_does():
    rng = random.Random(4)
    words = ["x" * n + str(i) for n in range(4, 9) for i in range(6)]
    sets = [frozenset(rng.sample(words[: 10 + i % 9], rng.randint(5, 9))) for i in range(400)] + [frozenset()]
    found, plain = similarity.Families(), []
    for i, own in enumerate(sets):
        found.join(i, own, "")
        for f in plain:
            if similarity.jaccard_sets(own, f[2]) >= 0.55:
                f[1] += 1
                break
        else:
            plain.append([i, 1, own])
    assert [(f[0], f[1]) for f in found.founders] == [(f[0], f[1]) for f in plain] and max(f[1] for f in plain) > 3


def test_bulk_reads(spark):
    rows = [("a/yarn.lock", 10, False), ("a/x.min.js", 10, False), ("dist/a.py", 10, False), ("big.py", 200_000, False), ("huge.py", 1_000_000, False), ("big.py", 200_000, True), ("small.py", 199_999, False)]
    got = notices.bulk_read(spark.createDataFrame(rows, "p string, n long, r boolean"), "p", "n", F.col("r"))
    assert [r.notice for r in got.orderBy("n", "p").collect()] == ["generated", "lock file", "build directory", "large", "very large"]


def test_stores(spark):
    body = "# Title\n\n## Done\nx\n## Remaining\n- fix it\n## Blockers\n- none\n"
    records = spark.createDataFrame([("r", "2024-01-01-a.md", "old\n## Remaining\nold"), ("r", "2024-01-02-b.md", body), ("s", "2024-01-01-c.md", "## Blockers\nn/a")], "repo string, name string, text string")
    assert [tuple(r) for r in stores.carried(records, ["repo"]).collect()] == [("r", "2024-01-02-b.md", "_Last session (2024-01-02) — Title_\n\n**Remaining**\n- fix it")]
    entries = spark.createDataFrame(
        [("r", "rules", "a.md", "# Rule\nkeep " + "x" * 20), ("r", "rules", "b.md", "y" * 1600), ("r", "decisions", "use-it.md", "no heading"), ("r", "lessons", "l.md", "# Lesson one")],
        "repo string, category string, name string, text string",
    )
    rule = stores.rules(entries, ["repo"]).first()["rules"]
    assert rule.startswith("**Rule**\nkeep x") and rule.endswith("2 in total._") and len(rule) < 1600
    assert [(r.category, r.title) for r in stores.titles(entries, ["repo"]).orderBy("rank").collect()] == [("decisions", "use it"), ("lessons", "Lesson one")]
    assert tuple(stores.category_counts(entries, ["repo"]).first()) == ("r", 1, 1, 2)
    docs = spark.createDataFrame([("r", "# M\n\n## 2024-01-01 — One\nwhy\n\n## 2024-02-01 - Two\nx\n## Not a date\n## 2024-03-01 — Three\n")], "repo string, text string")
    found = stores.milestones(docs, ["repo"])
    assert [(r.date, r.title, r.body) for r in found.orderBy("ord").collect()] == [("2024-01-01", "One", "why"), ("2024-02-01", "Two", "x"), ("2024-03-01", "Three", "")]
    assert [(r.title, r.earlier) for r in stores.recent_milestones(found, ["repo"]).orderBy("rank").collect()] == [("Three", 1), ("Two", 1)]


def test_retention_keeps_what_is_not_strictly_older(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (2, TIMESTAMP '2023-12-31 23:59:59') AS t(id, ts)")
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    assert [r.id for r in relational.retained(df, "ts", now, 7).collect()] == [1]
    assert relational.retained(df, "ts", now, 0).count() == 2
