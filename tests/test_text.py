"""Golden inputs for what the tables have none of: credentials in both directions, scripts, documentation marks, commands."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import plain, redact, text


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first()[0]


JOIN = "".join
SECRETS = [
    JOIN(["sk", "_live_", "a1B2" * 6]),
    JOIN(["sk", "-proj-", "abcd1234" * 3]),
    JOIN(["gh", "p_", "Z9" * 12]),
    JOIN(["AK", "IA", "ABCDEFGH12345678"]),
    JOIN(["AI", "za", "x" * 32]),
    JOIN(["xo", "xb-", "12345-abcdef"]),
    JOIN(["gl", "pat-", "q" * 20]),
    JOIN(["ey", "J", "a" * 10, ".", "b" * 10, ".", "c" * 10]),
    JOIN(["-----BEGIN RSA ", "PRIVATE KEY-----\nMIIabc\nxyz\n-----END RSA ", "PRIVATE KEY-----"]),
]
BENIGN = [
    "The password policy is described in the handbook.",
    "commit 3f2a9c1e7b60d45f8e21aa90c3d7b6e5f4a1b2c3",
    "See RFC 2119 and https://example.com/path?x=1",
    "550e8400-e29b-41d4-a716-446655440000 v1.2.3",
    "def total(order, amount): return amount",
    "token_ttl = 3600",
    "",
]


@pytest.mark.parametrize("secret", SECRETS)
def test_secrets_go(spark, secret):
    said = f"before {secret} after"
    for got in (one(spark, redact.scrub, said), plain.scrub(said)):
        assert secret not in got and got.startswith("before ") and got.endswith(" after")


@pytest.mark.parametrize("said", BENIGN)
def test_benign_text_stays(spark, said):
    assert one(spark, redact.scrub, said) == said == plain.scrub(said)


@pytest.mark.parametrize(
    "said,want",
    [
        ("postgres://admin:Hunter2" + "Pass@db/x", "postgres://admin:<REDACTED>@db/x"),
        ("password = 'correct" + "horse'", "password = '<REDACTED>'"),
        ('API_KEY: "abc' + 'defgh"', 'API_KEY: "<REDACTED>"'),
        ("DB_PASSWORD=s3cr3t" + "value rest", "DB_PASSWORD=<REDACTED> rest"),
        ("pwd: short", "pwd: short"),
        ("token\u00a0= abc" + "defghi", "token\u00a0= <REDACTED>"),
    ],
)
def test_assignments(spark, said, want):
    assert one(spark, redact.scrub, said) == want == plain.scrub(said)


@pytest.mark.parametrize("said,want", [(None, 0.0), ("", 0.0), ("a" * 24, 10.0), ("中" * 5, 5.0), ("ไทย", 3 * 0.84), ("a中ก", 1 + 0.84 + 1 / 2.4), ("한글カナ", 4.0)])
def test_token_estimate(spark, said, want):
    assert abs(one(spark, text.token_estimate, said) - want) < 1e-9
    assert said is None or abs(plain.estimate(said) - want) < 1e-9


@pytest.mark.parametrize("said", ["a" * 3000, "中" * 500, "ไ" * 700, "a中" * 400, "short", ""])
@pytest.mark.parametrize("budget", [0, 1, 399.5, 400])
def test_token_cut_is_the_left_to_right_sum(spark, said, budget):
    got = one(spark, lambda c: text.token_cut(c, budget), said)
    total, want = 0.0, len(said)
    for i, c in enumerate(said):
        total += 1.0 if c == "中" else 0.84 if c == "ไ" else 1 / 2.4
        if total > budget:
            want = i
            break
    assert got == (want if budget > 0 else 0) == plain.token_cut(said, budget)


@pytest.mark.parametrize(
    "said,want",
    [
        ("====== Low level stuff ======", "Low level stuff"),
        ("@file of_crc.h @brief Computes sums @param x no", "Computes sums"),
        ("<summary>Reads List<String> and Map<K, V></summary>", "Reads List<String> and Map<K, V>"),
        ('See <see cref="Thing"/> here', "See Thing here"),
        ("{@code fleet.drivers} are kept", "fleet.drivers are kept"),
        ("mail me@example.com now", "mail me@example.com now"),
        ("x" * 120, "x" * 109 + "…"),
        ("a\u00a0\n b", "a b"),
        (None, ""),
    ],
)
def test_clip(spark, said, want):
    assert one(spark, text.clip_summary, said) == want == plain.clip(said)


@pytest.mark.parametrize("said,want", [("  Hello, World! ", "hello-world"), ("été", "t"), ("!!!", "entry"), ("a" * 60, "a" * 50), ("x" * 49 + " y", "x" * 49)])
def test_slugify(spark, said, want):
    assert one(spark, text.slugify, said) == want


@pytest.mark.parametrize("n,want", [(0, "0B"), (1023, "1023B"), (1024, "1.0KB"), (1280, "1.2KB"), (1048576, "1.0MB"), (5 * 1024**4, "5120.0GB")])
def test_human_bytes(spark, n, want):
    assert spark.range(1).select(text.human_bytes(F.lit(n).cast("long"))).first()[0] == want


def test_lines_headings_and_front_matter(spark):
    assert one(spark, text.headline, "import json\n# x\n\ntotal =  1\n") == "total = 1"
    assert one(spark, text.headline, "import json\n") == "import json"
    assert one(spark, text.is_nothing, "- None.\n* n/a\n\n") and not one(spark, text.is_nothing, "- None\n- fix it")
    assert one(spark, lambda c: text.title_of(c, F.lit("stem")), "x\n# A title \n# B") == "A title" and one(spark, lambda c: text.title_of(c, F.lit("stem")), "none") == "stem"
    assert one(spark, text.described, "---\nname: x\nDescription:  does   this\n---\nbody") == "does this" and one(spark, text.described, "description: x") == ""
    assert one(spark, text.flatten_headings, "# Top\ntext\n## Sub\nmore") == "**Top**\ntext\nSub\nmore"
    assert one(spark, text.model_family, "name-4-20240101") == "name-4"
    assert one(spark, text.unescape_xml, "&amp;lt; &lt;&gt;&quot;&apos;") == "&lt; <>\"'"


def test_jaccard(spark):
    f = lambda a, b: text.jaccard(F.split(a, " "), F.split(b, " "))
    assert one(spark, f, "a b c", "b c d") == 0.5
    assert spark.range(1).select(text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))).first()[0] == 0.0
