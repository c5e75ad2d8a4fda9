"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, turn by turn, as

    <|turn|>role<|says|>text<|end|>

where the three marks are single tokens. Inside roles and texts a backslash is
written twice and a `<` before a `|` is written `<\\`, so that no mark can come
from a text and every text can be read back exactly. The rendered text is
encoded once with offsets; the sorted spans of assistant texts are intersected
with the sorted token spans by binary search, and the tokens met are the loss.
Marks are tokens of their own, so no token straddles the edge of a text.

Scale. One shuffle by conversation, then a stream over sorted turns. A rendering
that grows beyond `segment_chars` is encoded and passed on at the next end of a
turn as another segment of its conversation, which bounds memory without
changing any token (marks divide the encoding), so that even a conversation
that holds a third of all turns flows through its task. What reads the output row
by row may run in the operator's own Python worker (`then`), so that a task has
one worker, and a worker loads the tokenizer once for all its tasks.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pick, rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
SEGMENT_CHARS = 250_000
TURNS = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return re.sub(r"\\|<(?=\|)", lambda m: "\\\\" if m[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text, and (start, end, role) of each turn's text in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{SAYS}", escape(text or "")
        spans.append((at + len(head), at + len(head) + len(body), role or ""))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of render, but for null, which reads as empty."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURNS.finditer(formatted)]


class Encoder:
    """A public tokenizer with the three marks as tokens of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(path)
        self.tok.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tok.add_special_tokens([TURN, SAYS, END])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids and the code points where each token starts and ends."""
        found = self.tok.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, np.int32).reshape(-1, 2)
        return np.array(found.ids, np.int32), spans[:, 0], spans[:, 1]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The Encoder of a path, one for all tasks that a Python worker runs one after another."""
    return Encoder(path)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, str]], loss_role: str = "assistant") -> np.ndarray:
    """1 for each token that meets a text of loss_role: token spans and turn spans are sorted, so two binary searches per turn."""
    mask = np.zeros(len(starts), np.int8)
    for a, b, role in spans:
        if role == loss_role and b > a:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = 1
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped: tokens that share a character count it once."""
    at = np.flatnonzero(mask)
    if not len(at):
        return ""
    # A run is of masked tokens that follow one another and leave nothing out between them.
    first = np.append(True, (np.diff(at) > 1) | (starts[at[1:]] > ends[at[:-1]]))
    begin, end = starts[at[first]].tolist(), ends[at[np.append(first[1:], True)]].tolist()
    return unescape("".join(formatted[a:b] for a, b in zip(begin, end, strict=True)))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER, loss_role: str = "assistant", segment_chars: int = SEGMENT_CHARS, then: tuple[Callable[[Iterator], Iterator], str] | None = None) -> DataFrame:
    """(conv_id, segment, formatted, token_ids, token_starts, token_ends, loss_mask), sorted by conversation within partitions.

    A conversation's segments, in order, make up its whole rendering; most have
    one. Turns are ordered by turn, nulls first; equal turns by role and text. A
    null text or role is empty, a null conv_id is a conversation of its own.
    Repeated turns are kept. No turns give no rows. With `then`, a map over Arrow
    batches and the schema of what it makes, those rows are read by it in the same
    worker and its own are returned.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        ints = pa.list_(pa.int32())
        schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("token_ids", ints), ("token_starts", ints), ("token_ends", ints), ("loss_mask", pa.list_(pa.int8()))])

        def done(conv, segment, held):
            text, spans = render(held)
            ids, starts, ends = encoder_of(tokenizer).encode(text)
            return conv, segment, text, ids, starts, ends, loss_mask(starts, ends, spans, loss_role)

        def segments():
            first, conv, segment, held, chars = True, None, 0, [], 0
            for c, role, text in rows(batches, "conv_id", "role", "text"):
                if not first and (c != conv or chars >= segment_chars):
                    yield done(conv, segment, held)
                    segment, held, chars = (segment + 1 if c == conv else 0), [], 0
                first, conv = False, c
                held.append((role, text))
                chars += len(text or "") + len(role or "")
            if held:
                yield done(conv, segment, held)

        yield from in_batches(schema, segments(), 500, 2_000_000)

    slim = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("conv_id", F.col("conv_id").cast("long"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = "conv_id long, segment long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
    if then:
        read, out = then
        return ordered.mapInArrow(lambda batches: read(run(batches)), out)
    return ordered.mapInArrow(run, out)


def with_lists(batches) -> Iterator[tuple]:
    """Rows of formatted conversations from Arrow batches, their lists as arrays."""
    for batch in batches:
        column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        lists = []
        for name in ("token_starts", "token_ends", "loss_mask"):
            cuts, values = column(name).offsets.to_numpy(), column(name).values.to_numpy(zero_copy_only=False)
            lists.append([values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        yield from zip(column("conv_id").to_pylist(), column("segment").to_pylist(), column("formatted").to_pylist(), *lists, strict=True)


#: What digest_batches makes of formatted conversations.
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_batches(batches: Iterator) -> Iterator:
    """One row per conversation, read back from the rows of format_conversations as they come."""
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def items():
        conv = state = None
        for c, segment, text, starts, ends, mask in with_lists(batches):
            if segment == 0:
                if state:
                    yield (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            under = masked_text(text, starts, ends, mask)
            state[2] += len(under)
            state[3].update(under.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if state:
            yield (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    yield from in_batches(schema, items(), 20_000)


def digests(formatted: DataFrame) -> DataFrame:
    """digest_batches over the rows of format_conversations."""
    return formatted.mapInArrow(digest_batches, DIGESTS)
