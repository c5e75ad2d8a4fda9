from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import langid, queries

from .conftest import EDGE, documents


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        for n in range(1, 5):
            for i in range(len(p) - n + 1):
                if p[i : i + n] != " ":
                    out[p[i : i + n]] += 1
    return out


def key(gram):
    k = 0
    for c in gram:
        k = k << 16 | ord(c) & 0xFFFF
    return k


def plain_ranks(counts, profile=400):
    ranks = {g: sum(m > n for m in counts.values()) for g, n in counts.items()}
    return {g: r for g, r in ranks.items() if r < profile}


def plain_predict(profiles, text):
    mine = plain_ranks(plain_grams(text))
    if not mine:
        return "und", 0.0
    apart = {lang: sum(abs(r - p[g]) if g in p else 400 for g, r in mine.items()) for lang, p in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (400 * len(mine))


SAMPLES = {"en": "The cat and the dog were in the house with that other thing", "fr": "Le chat et le chien sont dans la maison avec cette autre chose", "de": "Die Katze und der Hund waren in dem Haus mit der anderen Sache"}


def test_counts_against_plain_counting():
    for text in [*SAMPLES.values(), "", "1 2 3", "a", "Été à l'école", "x" * 500]:
        keys, n = langid.grams(text)
        assert dict(zip(keys.tolist(), n.tolist())) == {key(g): c for g, c in plain_grams(text).items()}


def test_chunks_count_alike(monkeypatch):
    text = " ".join(SAMPLES.values()) * 5
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 61)
    parts = langid.grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_prediction_against_plain_out_of_place_distance(spark):
    train = documents(spark, [(i, t, lang, "a") for i, (lang, t) in enumerate(SAMPLES.items())])
    profiles = langid.fit(train)
    plain = {lang: plain_ranks(plain_grams(t)) for lang, t in SAMPLES.items()}
    for text in ["the house of the dog", "la maison du chien", "das Haus und der Hund", "zzz", "", "12"]:
        lang, score = profiles.predict(langid.grams(text))
        want = plain_predict(plain, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-9


def test_edge_cases(edge, empty):
    profiles = langid.fit(edge)
    got = langid.identify(edge, profiles).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and by[7].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(edge, profiles)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 4
    none = langid.fit(empty)
    assert langid.identify(edge, none).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.keep_identified(edge, none).count() == len(EDGE) - 4
    assert langid.identify(empty, profiles).count() == 0


def test_held_out_documents_are_not_learned_from(spark, sf_dir):
    got = queries.op9_language(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)


def test_letters_are_those_of_category_l(spark):
    """Numbers that are no decimal digits are no letters, nor are marks alone."""
    for text in ("½ ²", "Ⅷ ①", "\u0301", "٣ ৪", "_ __", "\U0001f600"):
        assert not len(langid.grams(text)[0]), text
    assert langid.letters_of("a½b Été_x² 中文Ⅷ") == "a b été x 中文"
    rows = [(i, t, lang, "a") for i, (lang, t) in enumerate(SAMPLES.items())] + [(9, "½ ²", "en", "a")]
    docs = documents(spark, rows)
    profiles = langid.fit(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, profiles).collect()}[9] == "und"
    assert langid.keep_identified(docs, profiles).count() == 3


def test_copies_are_one_example_and_the_bound_holds(spark):
    rows = [(i, SAMPLES["en"] if i % 3 == 0 else f"the text number {'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}{'rstuvwxyz'[i // 70 % 9]}{i}", "en", "a") for i in range(3000)]
    docs = documents(spark, rows)
    whole, once = langid.fit(docs), langid.fit(documents(spark, [r for r in rows if r[0] == 0 or r[0] % 3]))
    assert (whole.keys == once.keys).all() and (whole.ranks == once.ranks).all()
    bound = docs.select(F.xxhash64("text", F.lit(11)).alias("t")).distinct().where(F.pmod("t", F.lit(1_000_003)) < 1_000_003 * langid.MARGIN * 100 / 2001).count()
    assert 50 < bound <= 130 and len(langid.fit(docs, train_docs=100).keys)


def test_labels_alone_change_nothing(spark):
    rows = [(i, t, lang, "a") for i, (lang, t) in enumerate(SAMPLES.items())]
    profiles = langid.fit(documents(spark, rows))
    a = langid.identify(documents(spark, rows), profiles).collect()
    b = langid.identify(documents(spark, rows).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), profiles).collect()
    assert a == b
