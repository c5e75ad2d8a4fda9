from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import linear, quality, queries, toxicity

from .conftest import EDGE, documents

WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "st", "rd")]


def prose(rng, n):
    out = []
    while len(out) < n:
        out += ["The", *[rng.choice(WORDS + ["of", "and", "in"]) for _ in range(9)], "is."]
    return " ".join(out)


def test_linear_scorer_learns_and_repeats():
    rng = random.Random(1)
    hasher = linear.Hasher(1 << 12)
    texts = [prose(rng, 30) + (" vile" if i % 3 == 0 else "") for i in range(400)]
    x, y = [hasher.words(t) for t in texts], np.array([float(i % 3 == 0) for i in range(400)])
    fits = [linear.Linear(1 << 12).fit(x[:300], np.zeros((300, 0)), y[:300]) for _ in range(2)]
    assert (fits[0].w == fits[1].w).all()
    p = np.array([fits[0].score(i) for i in x[300:]])
    assert ((p > 0.5) == (y[300:] > 0.5)).mean() > 0.95


def test_best_threshold_by_trying_all():
    rng = np.random.default_rng(1)
    p, y = rng.random(60).round(2), (rng.random(60) < 0.3).astype(float)
    f1 = lambda t: 2 * ((p >= t) & (y > 0)).sum() / ((p >= t).sum() + y.sum())
    assert abs(f1(linear.best_threshold(p, y)) - max(map(f1, np.unique(p)))) < 1e-12
    assert linear.best_threshold(p, np.zeros(60)) == 0.5


def test_label_model_finds_the_accuracies_of_labellers():
    rng, counts = np.random.default_rng(2), {}
    right = np.linspace(0.95, 0.6, len(quality.LABELLERS))
    for _ in range(20_000):
        y = int(rng.random() < 0.8)
        votes = [2 if rng.random() < 0.2 else (y if rng.random() < a else 1 - y) for a in right]
        counts[quality.code(votes)] = counts.get(quality.code(votes), 0) + 1
    model = quality.LabelModel(counts)
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(a - b) < 0.04 for a, b in zip(model.accuracies().values(), right, strict=True))


def test_quality_of_planted_junk(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "a") for i in range(30)]
    rows += [(2000 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "a") for i in range(30)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in quality.scored(docs, quality.fit(docs)).collect()}
    assert all(got[i].keep for i in range(300)) and not any(r.keep for d, r in got.items() if d >= 1000)


def test_quality_held_against_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in queries.op3_quality(spark, sf_dir).collect()}
    good = [got[d] for d, q in label.items() if q]
    bad = [got[d] for d, q in label.items() if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def plain_posteriors(patterns):
    """Expectation-maximisation over single texts, by loops: the chance of good for each text's votes."""
    q = [1 / (1 + np.exp(3.0 * p.count(0) - 0.5 * p.count(1))) for p in patterns]
    for _ in range(100):
        prior = min(0.99, max(0.01, sum(q) / len(q)))
        tables = []
        for weight in ([1 - x for x in q], q):
            own = [[1.0, 1.0, 1.0] for _ in quality.LABELLERS]
            for p, w in zip(patterns, weight, strict=True):
                for labeller, vote in enumerate(p):
                    own[labeller][vote] += w
            tables.append([[x / sum(t) for x in t] for t in own])
        new = []
        for p in patterns:
            odds = np.log(prior / (1 - prior)) + sum(np.log(tables[1][i][v] / tables[0][i][v]) for i, v in enumerate(p) if v != 2)
            new.append(1 / (1 + np.exp(-min(35, max(-35, odds)))))
        done = max(abs(a - b) for a, b in zip(q, new, strict=True)) < 1e-9
        q = new
        if done:
            break
    return q


def test_quality_query_against_plain_expectation_maximisation(spark, sf_dir):
    """posterior is that of a plain loop over all documents, and keep follows a scorer trained on those labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert got.keys() == text.keys()
    patterns = [quality.votes(quality.measures(t)) for t in text.values()]
    want = dict(zip(text, plain_posteriors(patterns), strict=True))
    assert all(abs(got[d].posterior - want[d]) < 1e-6 for d in text)
    scorer, hasher = quality.fit(docs), linear.Hasher(quality.BUCKETS)
    for d, t in text.items():
        own = quality.features(hasher, t, quality.measures(t))
        p = 1 / (1 + np.exp(-(sum(scorer.linear.w[i] for i in own) + scorer.linear.w[-1])))
        assert abs(got[d].quality - p) < 1e-9 and got[d].keep == (got[d].quality >= scorer.threshold)
    assert sum((got[d].quality > 0.5) == (want[d] > 0.5) for d in text) >= 0.95 * len(text)


def test_threshold_by_counts_and_descent_to_the_minimum():
    rng = np.random.default_rng(4)
    p, y = rng.random(300).round(1), (rng.random(300) < 0.3).astype(float)
    known, at = np.unique(p, return_inverse=True)
    assert linear.best_threshold(known, np.bincount(at, y), np.bincount(at)) == linear.best_threshold(p, y)
    x = (rng.random((200, 12)) < 0.4).astype(float)
    goal = linear.sigmoid(x @ rng.normal(size=12) * 2)
    model = linear.Descent(x.T @ x.sum(axis=1) / 4, 1.0)
    slope = lambda w: x.T @ (linear.sigmoid(x @ w) - goal)
    for _ in range(40):
        m = x @ model.x
        model.tell(float((np.logaddexp(0, m) - goal * m).sum()), slope(model.x))
    assert np.abs(slope(model.at) + model.at).max() < 1e-4


def test_packed_features_come_back():
    import pyarrow as pa

    rng, buckets = np.random.default_rng(5), 1 << 18
    index = [np.sort(rng.choice(buckets, n, replace=False)) for n in (9, 300, 20, 1)] + [np.arange(65_536, 200_000), np.array([0, 65_535, 65_536, buckets - 1])]
    for column in (pa.array([quality.packed(i, buckets) for i in index]), pa.array([b"x", *[quality.packed(i, buckets) for i in index]])[1:]):
        got = [i for _, _, x, n in quality.unpacked(column, buckets) for i in np.split(x, np.cumsum(n)[:-1])]
        assert len(got) == len(index) and all((a == b).all() for a, b in zip(got, index, strict=True))


def test_sums_are_those_of_loops_however_rows_are_dealt(spark, monkeypatch):
    """Loss and gradient count every row, a third of which is one text, in one leaf or several."""
    monkeypatch.setattr(quality, "CHUNK", 500)
    rng, buckets = random.Random(16), 1 << 10
    hot = prose(rng, 30)
    docs = documents(spark, [(i, hot if i % 3 == 0 else prose(rng, 1 + i % 40), "en", "a") for i in range(300)])
    seen = quality.described(docs, "doc_id", "text", buckets).cache()
    kept, hasher = {r.doc_id: r for r in seen.collect()}, linear.Hasher(buckets)
    assert len({kept[i].half for i in range(0, 300, 3)}) == 1 and {r.half for r in kept.values()} == {0, 1}
    posterior = np.random.default_rng(6).random(3 ** len(quality.LABELLERS))
    w = linear.snapped(np.random.default_rng(7).normal(size=(3, buckets + 1)) / 10)
    want, lengths = np.zeros((3, buckets + 2)), np.zeros((3, buckets + 2))
    for r in docs.select("doc_id", "text").collect():
        own, m = quality.features(hasher, r.text, quality.measures(r.text)), kept[r.doc_id]
        y = posterior[quality.code(quality.votes(quality.measures(r.text)))]
        for k in range(3):
            if k == 0 or m.half != k - 1:
                at = w[k][own].sum() + w[k][-1]
                off = 1 / (1 + np.exp(-at)) - y
                want[k][own] += off
                want[k][-2:] += off, np.log1p(np.exp(at)) - y * at
                lengths[k][own] += len(own) + 1
    got = [quality.sums(d, posterior, w, leaves, buckets) for d, leaves in ((seen, 1), (seen, 3), (seen.repartition(5, "doc_id"), 2))]
    assert np.abs(got[0] - want).max() < 1e-3 and all((g == got[0]).all() for g in got)
    assert (quality.sums(seen, posterior, None, 2, buckets)[:, :buckets] == lengths[:, :buckets]).all()


def test_threshold_is_the_best_for_all_documents(spark, sf_dir, monkeypatch):
    """More distinct texts than any sample that was taken: each document's score counts, by the model of the texts of the other half."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    used, models, best, unseen = [], [], quality.best_threshold, getattr(quality, "unseen", None)
    monkeypatch.setattr(quality, "best_threshold", lambda p, y, *n: (used.append(n[0].sum() if n else len(p)), best(p, y, *n))[1])
    monkeypatch.setattr(quality, "unseen", lambda seen, posterior, w, buckets: (models.append(w), unseen(seen, posterior, w, buckets))[1], raising=False)
    scorer = quality.fit(docs)
    assert used == [docs.count()] and docs.select("text").distinct().count() > 9_000
    hasher, p, y = linear.Hasher(quality.BUCKETS), [], []
    for r in docs.select("text", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).alias("half")).collect():
        m = quality.measures(r.text or "")
        w = models[0][1 + r.half]
        p.append(1 / (1 + np.exp(np.clip(w[quality.features(hasher, r.text or "", m)].sum() + w[-1], -35, 35))))
        y.append(float(scorer.labels.posterior(quality.code(quality.votes(m))) < 0.5))
    assert abs(1 - best(np.array(p), np.array(y)) - scorer.threshold) < 1e-9


def test_measures_of_runs_by_counting_them():
    rng = random.Random(15)
    for n in (3, 18, 19, 40, 400):
        words = [rng.choice("abc") for _ in range(n)]
        five = [tuple(words[i : i + 5]) for i in range(n - 4)]
        want = 1 - len(set(five)) / len(five) if len(five) >= 15 else 0.0
        assert abs(quality.repeated_fives(words) - want) < 1e-12


def test_chain_feeds_earlier_categories_out_of_fold():
    rng = random.Random(5)
    hasher = linear.Hasher(1 << 12)
    texts = [prose(rng, 25) + (f" rude{i % 3}" if i % 2 else "") + (f" vile{i % 3}" if i % 4 == 1 else "") for i in range(400)]
    x = [hasher.words(t) for t in texts]
    y = np.array([[float(i % 2), float(i % 4 == 1)] for i in range(400)])
    chain = toxicity.Chain(["rude", "vile"], x, y, 1 << 12)
    assert chain.models[0].w.size == (1 << 12) + 1 and chain.models[1].w.size == (1 << 12) + 2
    assert chain.out_of_fold.shape == (400, 2)
    p = np.array([chain.predict(i) for i in x])
    assert ((p[:, 1] >= chain.thresholds[1]) == (y[:, 1] > 0)).mean() > 0.95
    # A fold's predictions come from a model that has not seen it.
    rest = [i for i in range(400) if i % toxicity.FOLDS != 0]
    share = lambda own: np.bincount(np.concatenate(own), minlength=1 << 12) / len(own)
    dull = share(x) > toxicity.COMMON
    for j in range(2):
        yes, no = share([i for i, v in zip(x, y[:, j], strict=True) if v]), share([i for i, v in zip(x, y[:, j], strict=True) if not v])
        dull &= (yes <= toxicity.ALIKE * no) & (no <= toxicity.ALIKE * yes)
    assert 0 < dull.sum() < 200
    dull |= np.bincount(np.concatenate(x), minlength=1 << 12) < toxicity.RARE
    x = [i[~dull[i]] for i in x]
    model = linear.Linear(1 << 12).fit([x[i] for i in rest], np.zeros((len(rest), 0)), y[rest, 0], l1=toxicity.SPARSITY)
    assert abs(model.score(x[0]) - chain.out_of_fold[0, 0]) < 1e-12


def test_words_of_a_hot_group_of_copies_keep_their_weight(spark):
    """Toxic copies that are a third of all labelled rows don't take the telling words out of the model."""
    rng = random.Random(13)
    hot = prose(rng, 40) + " vileword of all"
    rows = [(i, hot if i % 3 == 0 else prose(rng, 40) + (" vileword so" if i % 15 == 1 else ""), "en", "a") for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0 or i % 15 == 1)) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = {r.doc_id: r.is_toxic for r in toxicity.scored(docs, toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1})).collect()}
    assert sum(got[i] == (i % 3 == 0 or i % 15 == 1) for i in range(900)) >= 890


def test_samples_keep_their_bounds_when_a_third_of_all_rows_is_one_text(spark, monkeypatch):
    rng = random.Random(14)
    hot = prose(rng, 30)
    rows = [(7 if i % 3 == 0 else i, hot if i % 3 == 0 else prose(rng, 30), "en", "a") for i in range(3000)]
    docs, sizes = documents(spark, rows).cache(), []
    fit = linear.Linear.fit
    monkeypatch.setattr(linear.Linear, "fit", lambda self, index, *a, **b: (sizes.append(len(index)), fit(self, index, *a, **b))[1])
    quality.fit(docs, train_docs=100)
    assert max(sizes) == 100
    sizes.clear()
    labels = spark.createDataFrame([(d, 1, int(d % 5 == 0)) for d, _, _, _ in rows], "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1}, train_docs=100)
    assert max(sizes) == 100


def test_kinds_come_first_in_the_chain(spark, sf_dir):
    """The registered query: each link's probabilities are those of its model on the words and the earlier probabilities."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), {"toxic": F.col("toxic") == 1}, kinds=toxicity.KINDS)
    assert chain.names == [*toxicity.KINDS, "toxic"]
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf_dir).collect()}
    text, hasher = {r.doc_id: r.text for r in docs.collect()}, linear.Hasher(chain.buckets)
    assert got.keys() == text.keys()
    for d, t in text.items():
        words, earlier = hasher.starts(t), []
        for name, model, least in zip(chain.names, chain.models, chain.thresholds, strict=True):
            m = sum(model.w[i] for i in words) + sum(a * b for a, b in zip(model.w[chain.buckets :], earlier)) + model.w[-1]
            p = 1 / (1 + np.exp(-m))
            assert abs(got[d][f"p_{name}"] - p) < 1e-9 and got[d][f"is_{name}"] == (got[d][f"p_{name}"] >= least)
            earlier.append(p)


def test_toxicity_held_against_labels_it_has_not_seen(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    own, rest = labels.where("doc_id % 2 = 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    chain = toxicity.fit(docs, own, {"toxic": F.col("toxic") == 1}, kinds=toxicity.KINDS)
    got = {r.doc_id: r.is_toxic for r in toxicity.scored(docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi"), chain).collect()}
    hit = sum(got[d] and t == 1 for d, t in rest.items())
    # Of the toxic labels some stand on texts without a telling word, which nothing can find.
    assert hit >= 0.82 * sum(rest.values()) and hit >= 0.95 * sum(got.values())


def test_toxicity_of_planted_words(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50) + (" vileword here" if i % 6 == 0 else ""), "en", "a") for i in range(600)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(400)] + [(3, None, None), (None, 1, 1), (9999, 1, 1), (0, 1, 1)]
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, table, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    got = {r.doc_id: r for r in toxicity.scored(docs, chain).collect()}
    unseen = range(400, 600)
    assert sum(got[i].is_toxic == (i % 6 == 0) for i in unseen) >= 195


def test_toxicity_of_unseen_forms_and_long_texts(spark):
    rng = random.Random(8)
    form = lambda: "loathe" + "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, prose(rng, 40) + (f" {form()} {form()}" if i % 5 == 0 else ""), "en", "a") for i in range(500)]
    rows += [(900, prose(rng, 20_000) + f" {form()} {form()}", "en", "a"), (901, prose(rng, 20_000), "en", "a")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = {r.doc_id: r.is_toxic for r in toxicity.scored(docs, toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1})).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(400, 500)) >= 98 and got[900] and not got[901]


def test_edge_cases(spark, edge, empty):
    q = quality.scored(edge, quality.fit(edge)).collect()
    assert len(q) == len(EDGE) and all(0 <= r.quality <= 1 for r in q)
    assert quality.scored(empty, quality.fit(empty)).count() == 0
    assert quality.scored(edge, quality.fit(empty)).count() == len(EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs, labels in ((edge, none), (empty, none), (edge, spark.createDataFrame([(5, 1, 1), (5, 1, 0), (7, None, None), (1, 0, 1)], none.schema))):
        chain = toxicity.fit(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
        got = toxicity.scored(edge, chain).collect()
        assert len(got) == len(EDGE) and all(0 <= r.p_toxic <= 1 for r in got)
        assert toxicity.scored(empty, chain).count() == 0
