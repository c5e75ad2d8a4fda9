from __future__ import annotations

import pytest

#: Columns that some operator uses inside under these very names.
CLASHES = ("fp", "component_id", "rid", "key", "site", "size", "taken", "target", "n_removed", "__gone", "__own", "__lost", "spans", "lang_pred", "score", "shard", "copy")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(spark, rows):
    """documents with clashing extra columns, from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *["x"] * len(CLASHES)) for d, t, lang, s in rows], SCHEMA)


LONG = " ".join(f"word{i % 7919} and" for i in range(120_000))
EDGE = [
    (None, "no id here but some words in it", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "b"),
    (3, "  \n\t ", "en", None),
    (4, "1234 5678", "en", "a"),
    (5, "the same text twice over and again", "en", "a"),
    (5, "the same text twice over and again", "en", "a"),
    (6, "the same text twice over and again", "de", "b"),
    (7, LONG, "en", "c"),
    (8, "\U0001f600 中文 café \x00 \x01 nul", "fr", "c"),
    (9, "x", "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, []).cache()
