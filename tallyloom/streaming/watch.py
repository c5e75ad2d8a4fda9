"""Detectors over a stream of tool events, with bounded state per repository.

`watch_scripts` speaks when a near-identical script comes for the third time,
`watch_workflows` when a sequence of steps has come round on a third day. Both are
stateful operators keyed by repository; state is the last 300 script
fingerprints or 400 steps, whatever the stream's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.similarity import jaccard_sets

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
HEREDOC = re.compile(r"<<-?\s*'?([A-Za-z_][A-Za-z0-9_]*)'?\s*\n(.*?)\n\1", re.S)
SIMILAR, REPEAT_AT, MIN_TOKENS, KEPT_SCRIPTS, STORED_TOKENS = 0.55, 3, 8, 300, 120
KEPT_STEPS, MIN_LENGTH, WINDOW = 400, 3, 12


def script_of(tool: str, command: str | None, path: str | None, content: str | None) -> str:
    """The script of an event: the longest here-document of a command, or what is written to a scratch file."""
    if tool == "Bash":
        return max((m[2] for m in HEREDOC.finditer(command or "")), key=len, default="")
    scratch = "/tmp/" in (path or "") or "/scratch" in (path or "")
    return content or "" if tool in ("Write", "Edit") and scratch else ""


def fingerprint(text: str) -> frozenset[str]:
    return frozenset(x.lower() for x in IDENTIFIER.findall(text))


def sequences_of(run: list[str]) -> set[tuple[str, ...]]:
    """The contiguous sequences of enough distinct steps among a run's last ones."""
    tail = run[-WINDOW:]
    spans = ((a, b) for a in range(len(tail)) for b in range(a + MIN_LENGTH, len(tail) + 1))
    return {tuple(tail[a:b]) for a, b in spans if len(set(tail[a:b])) >= MIN_LENGTH}


class Repeats:
    """Which sequences came round in how many runs, kept up as steps come in; a run ends where the day changes.

    Only the open run's sequences are looked at anew for a step. Ended runs are
    counted, and counted again only when the oldest steps are dropped.
    """

    def __init__(self, history: Iterable[tuple[str, str]] = (), most: int = KEPT_STEPS):
        self.most, self.history = most, []
        self.add(history)

    def add(self, steps: Iterable[tuple[str, str]]) -> None:
        new = list(steps)
        whole = [*self.history, *new]
        if len(whole) > self.most or not self.history:
            self.ended, self.open, self.day = Counter(), [], None
            new = whole = whole[-self.most :]
        self.history = whole
        for at, step in new:
            if at[:10] != self.day:
                self.ended.update(sequences_of(self.open))
                self.open, self.day = [], at[:10]
            self.open.append(step)

    def best(self) -> tuple[tuple[str, ...], int] | None:
        """The longest sequence that came round in enough runs, and in how many; then the most frequent, then the first by content."""
        now = sequences_of(self.open)
        often = ((s, n + (s in now)) for s, n in self.ended.items() if n >= REPEAT_AT - (s in now))
        return min(often, key=lambda x: (-len(x[0]), -x[1], x[0]), default=None)


def repeated(history: list[tuple[str, str]]) -> tuple[tuple[str, ...], int] | None:
    return Repeats(history, max(1, len(history))).best()


SCRIPT_OUT = "repo string, at string, head string, since string, count long"


def watch_scripts(events: DataFrame) -> DataFrame:
    """Notices (SCRIPT_OUT) from a stream of events(repo, at, ord, tool, command, path, content), in the order of (at, ord) within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, prints = map(list, state.get) if state.exists else ([], [])
        known = [frozenset(p) for p in prints]
        said = []
        for r in pd.concat(list(batches)).sort_values(["at", "ord"], kind="stable").itertuples(index=False):
            own = fingerprint(script_of(r.tool, r.command, r.path, r.content))
            if len(own) < MIN_TOKENS:
                continue
            alike = [n for n, p in enumerate(known) if jaccard_sets(own, p) >= SIMILAR]
            if len(alike) + 1 == REPEAT_AT:
                said.append((key[0], r.at, " ".join(sorted(own)[:8]), ats[alike[0]][:10], REPEAT_AT))
            ats, prints = [*ats, r.at][-KEPT_SCRIPTS:], [*prints, sorted(own)[:STORED_TOKENS]][-KEPT_SCRIPTS:]
            known = [*known, frozenset(prints[-1])][-KEPT_SCRIPTS:]
        state.update((ats, prints))
        yield pd.DataFrame(said, columns=["repo", "at", "head", "since", "count"])

    return events.groupBy("repo").applyInPandasWithState(step, SCRIPT_OUT, "ats array<string>, prints array<array<string>>", "append", GroupStateTimeout.NoTimeout)


WORKFLOW_OUT = "repo string, at string, sequence array<string>, days long"


def watch_workflows(events: DataFrame) -> DataFrame:
    """Notices (WORKFLOW_OUT) from a stream of events(repo, at, ord, steps): one whenever the best sequence becomes another."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Repeats(zip(*map(list, state.get), strict=True) if state.exists else ())
        best, said = held.best(), []
        for r in pd.concat(list(batches)).sort_values(["at", "ord"], kind="stable").itertuples(index=False):
            held.add((r.at, s) for s in r.steps)
            now = held.best()
            if now and (best is None or now[0] != best[0]):
                said.append((key[0], r.at, list(now[0]), now[1]))
            best = now
        state.update(([a for a, _ in held.history], [s for _, s in held.history]))
        yield pd.DataFrame(said, columns=["repo", "at", "sequence", "days"])

    return events.groupBy("repo").applyInPandasWithState(step, WORKFLOW_OUT, "ats array<string>, steps array<string>", "append", GroupStateTimeout.NoTimeout)


def drained(notices: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is now, into Parquet files, and read them; a rerun goes on where it stopped."""
    query = notices.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return notices.sparkSession.read.schema(notices.schema).parquet(f"{folder}/out")
