from __future__ import annotations

import hashlib
import random
import re

from tallyloom.llm import pii, queries

from .conftest import EDGE, documents

# The expressions as the contract words them.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def plain_base(text):
    out = []
    for kind, expression in PLAIN.items():
        for m in expression.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_plain_matching(spark):
    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.0.0.1", "999999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "1", "12 ", "+1 (202) 555-0142", "+49 89.1234567-", "+1", "++33 1 23 45 67 89 ", "é", "中", "\U0001f600", " ", "\n", "-", ".", "\x01", "\x02", "%+", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "en", "a") for i in range(400)]
    got = {r.doc_id: r for r in pii.summary(pii.personal_data(documents(spark, rows))).collect()}
    found = 0
    for d, t, _, _ in rows:
        base = plain_base(t)
        found += len(base)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, got[d].spans)
        assert [got[d][f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in base) for k in PLAIN]
        assert got[d].spans == joined or got[d].spans.startswith(joined)
    assert found > 500


def test_confident_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"Please write to contact id: user{i}@example.com today", "en", "a") for i in range(12)]
    rows += [(100, "And then contact id: ZX-998-KQ was told of it", "en", "a"), (101, "In the year 2024abc nothing came of plan B12345", "en", "a")]
    got = {r.doc_id: r.spans for r in pii.personal_data(documents(spark, rows)).collect()}
    text = dict((d, t) for d, t, _, _ in rows)
    assert [text[100][s.start : s.end] for s in got[100] if s.kind == "id"] == ["ZX-998-KQ"]
    assert got[101] == [] and all([s.kind for s in got[i]] == ["email"] for i in range(12))


def test_rounds_reach_patterns_that_share_only_discovered_instances(spark):
    rows = [(i, f"reach me at: user{i}@example.com", "en", "a") for i in range(9)]
    shared = [f"TK-{n:05d}" for n in range(8)]
    rows += [(100 + n, f"reach me at: {x}", "en", "a") for n, x in enumerate(shared[:4])]
    rows += [(200 + n, f"ticket no {x}", "en", "a") for n, x in enumerate(shared)]
    first = {r.doc_id: len(r.spans) for r in pii.personal_data(documents(spark, rows), rounds=1).collect()}
    later = {r.doc_id: len(r.spans) for r in pii.personal_data(documents(spark, rows), rounds=3).collect()}
    assert all(first[100 + n] == 1 for n in range(4)) and first[207] == 0
    assert later[207] == later[200] == 0 or later[207] == 1
    plain = bootstrap_by_hand(rows, 3)
    assert {d for d, n in later.items() if n and d >= 100} == plain


def test_secrets_teach_the_pattern_that_finds_others(spark):
    rows = [(i, f'They said zeg{"abcdef"[i % 6]} key = "{hashlib.md5(str(i).encode()).hexdigest()}" and went', "en", "a") for i in range(9)]
    rows += [(100, 'It is wuf key = "plain-secret-77" now', "en", "a"), (101, f"In commit {hashlib.md5(b'x').hexdigest()} nothing", "en", "a"), (102, "w" * 90 + "7 then", "en", "a")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "id"] for r in pii.personal_data(documents(spark, rows)).collect()}
    assert [rows[9][1][a:b] for a, b in got[100]] == ["plain-secret-77"] and all(len(got[i]) == 1 for i in range(9))
    assert got[101] == [] and {d for d, s in got.items() if s} == bootstrap_by_hand(rows, 3)


def bootstrap_by_hand(rows, rounds):
    import math

    pairs, where = {}, {}
    for d, t, _, _ in rows:
        base = plain_base(t)
        for kind, expression in (("seed", None), ("id", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}"))):
            spans = [(a, b) for _, a, b in base] if kind == "seed" else [m.span() for m in expression.finditer(t)]
            for a, b in spans:
                if kind == "id" and any(a < y and x < b for _, x, y in base):
                    continue
                pattern = re.sub(r"\s+", " ", re.search(r"((?:[^\W\d_]+[^\w]{1,4})?[^\W\d_]*[^\w]{0,4})$", t[max(0, a - 48) : a])[1].lower())
                marked = re.search(r"([^\W\d_]+[^\w]{0,3}[^\w\s.,;!?][^\w]{0,3})$", pattern)
                pattern = marked[1] if marked else pattern
                key = (pattern, t[a:b])
                secret = len(t[a:b]) >= 32 and re.fullmatch("[0-9a-fA-F]+", t[a:b]) and not t[a:b].isdigit() and not t[a:b].isalpha()
                pairs[key] = pairs.get(key, False) or kind == "seed" or bool(secret)
                if kind == "id":
                    where.setdefault(pattern, set()).add(d)

    def confident():
        out = {}
        for p in {p for p, _ in pairs}:
            known = [v for (q, _), v in pairs.items() if q == p]
            c = sum(known) / (len(known) + 1)
            if sum(known) >= 3 and c >= 0.5:
                out[p] = c
        return out

    for _ in range(rounds - 1):
        sure = confident()
        for (p, i), known in list(pairs.items()):
            belief = 1 - math.exp(sum(math.log1p(-sure[q]) for q, j in pairs if j == i and q in sure))
            if belief >= 0.6:
                pairs[(p, i)] = True
    return {d for p in confident() for d in where.get(p, ())}


def test_edge_cases(edge, empty):
    got = pii.personal_data(edge).collect()
    assert len(got) == len(EDGE) and all(not r.spans for r in got if r.doc_id in (1, 2, 3, 4))
    assert pii.personal_data(empty).count() == 0


def test_long_texts_without_blanks_take_linear_time(spark):
    rows = [(1, "a" * 300_000, "en", "a"), (2, "1" * 300_000, "en", "a"), (3, "a.b" * 100_000 + "@", "en", "a"), (4, "+1" + "-" * 300_000, "en", "a"), (5, "x@" + "a." * 100_000, "en", "a"), (6, "1.2." * 60_000, "en", "a")]
    got = {r.doc_id: len(r.spans) for r in pii.personal_data(documents(spark, rows)).collect()}
    assert {d: n for d, n in got.items() if d in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert got[5] == 1 and got[6] == 30_000


def test_query_reads_no_python(spark, sf_dir):
    plan = queries.op6_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
