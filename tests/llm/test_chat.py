from __future__ import annotations

import hashlib
import random

import pytest

from tallyloom.llm import chat, common, queries

PIECES = ["\\", "<", "|", "<|end|>", "<|turn|>", "<|says|>", " ", "\n", "é", "中", "\U0001f600", "ab", "<|endoftext|>", "  ", "assistant", "\x00", "\\<|"]


def conversation(rng):
    return [(rng.choice(["user", "assistant", "assistant", "<|turn|>\\", None]), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))])) for _ in range(rng.randint(1, 7))]


def test_round_trip_and_mask():
    rng, encoder = random.Random(2), chat.Encoder(chat.TOKENIZER)
    for _ in range(300):
        turns = conversation(rng)
        text, spans = chat.render(turns)
        assert chat.parse(text) == [(r or "", t or "") for r, t in turns]
        ids, starts, ends = encoder.encode(text)
        mask = chat.loss_mask(starts, ends, spans)
        assert len(ids) == len(starts) == len(mask)
        # By brute force: a token is in the loss if it shares a character with an assistant's text.
        plain = [any(a < e and s < b for a, b, r in spans if r == "assistant") for s, e in zip(starts, ends, strict=True)]
        assert mask.astype(bool).tolist() == plain
        assert chat.masked_text(text, starts, ends, mask) == "".join(t or "" for r, t in turns if r == "assistant")


def expected(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("segment_chars", [60, 1_000_000])
def test_digests_of_many_conversations(spark, segment_chars):
    rng = random.Random(4)
    convs = {c: conversation(rng) for c in [None, *range(30)]}
    convs[7] = [("assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(300)]
    rows = [(c, n, r, t, "x") for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(table, segment_chars=segment_chars)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
        assert r.formatted_chars == len(chat.render(turns)[0])


def test_segments_encode_as_the_whole(spark):
    turns = [(1, n, "assistant" if n % 2 else "user", f"some words {n}, and more. ") for n in range(50)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    ids = [sum((r.token_ids for r in chat.format_conversations(table, segment_chars=k).collect()), []) for k in (50, 10**6)]
    assert ids[0] == ids[1]


def test_one_worker_a_task_and_one_tokenizer_a_worker(spark, sf_dir):
    """Two workers with a tokenizer of their own for each task took more than an executor's memory."""
    plan = queries.op5_chat_format(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert chat.encoder_of(chat.TOKENIZER) is chat.encoder_of(chat.TOKENIZER)
    turns = [(c, n, "assistant" if n % 2 else "user", f"some words {n}, and more. ") for c in (None, 1, 2) for n in range(9)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    within = chat.format_conversations(table, segment_chars=60, then=(chat.digest_batches, chat.DIGESTS))
    assert sorted(map(repr, within.collect())) == sorted(map(repr, chat.digests(chat.format_conversations(table)).collect()))


def test_batches_end_early_for_long_arrays():
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("a", pa.list_(pa.int32()))])
    assert [b.num_rows for b in common.in_batches(schema, ((np.zeros(60, np.int32),) for _ in range(5)), 100, 100)] == [2, 2, 1]


def test_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 0, "assistant", "w " * 200_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[2].loss_chars == 400_000


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, sf_dir).collect()}
    convs = {-7: [(r, "\\### Assistant: </turn> ok") for r in ("user", "assistant")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: expected(t) for c, t in convs.items()}
