from __future__ import annotations

import corpus_pipeline as cp
from tallyloom.llm import decontaminate, langid

from .conftest import EDGE
from .test_linededup import plain as plain_lines
from .test_simhash import components, resemblance

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
    steps = dict(cp.STAGES)

    kept = steps["language_id"](spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    want = [r for r in rows if len(langid.grams(r[1])[0])]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [r[:2] for r in want]

    cut = steps["line_dedup"](spark, kept, sf_dir)
    assert cut.columns == COLUMNS
    got = sorted((r.doc_id, r.text, r.n_chars) for r in cut.collect())
    assert [x[:2] for x in got] == [x[:2] for x in plain_lines(want)]
    assert all(n == len(t) for _, t, n in got)

    one = steps["near_dedup"](spark, cut, sf_dir)
    assert one.columns == COLUMNS
    links = [(a, b) for a in range(len(got)) for b in range(a) if resemblance(got[a][1], got[b][1]) >= 0.8]
    groups = components(len(got), links)
    assert links and sorted(r.doc_id for r in one.collect()) == sorted({got[c][0] for c in groups})

    clean = steps["decontamination"](spark, one, sf_dir)
    assert clean.columns == COLUMNS
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: decontaminate.normalised(r.text) for r in one.collect()}
    gone = left.keys() - {r.doc_id for r in clean.collect()}
    assert gone and all(any(i in left[d] for i in items) for d in gone)
    assert not any(i in left[r.doc_id] for r in clean.collect() for i in items)

    mixed = steps["mixing"](spark, clean, sf_dir)
    assert mixed.columns == [*COLUMNS, "size", "source_size", "target", "taken"]
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert sorted(cp.run(spark, sf_dir).collect()) == sorted(mixed.collect())


def test_stages_take_edge_cases_and_extra_columns(spark, sf_dir, edge, empty):
    for docs in (edge, empty):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert cp.STAGES[-1][1](spark, docs, sf_dir).count() <= len(EDGE)


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = cp.language_id(spark, docs, sf_dir)
    assert kept.count() == docs.count()
