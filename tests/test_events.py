"""Single tool events as payloads, the logs behind them, and tables in the shared folder."""

from __future__ import annotations

import io
import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.__main__ import main
from tallyloom.functions import redact
from tallyloom.operators import similarity
from tallyloom.plans import events, repository, session
from tallyloom.sources import durable
from tallyloom.sources.workspace import Workspace, read_log

SCRIPT = "total_cost = sum(entry['cost'] for entry in records['days'])\ncall_count = sum(entry['calls'] for entry in records['days'])\nprint(f'cost={total_cost} calls={call_count}')\n"


def bash(command):
    return {"tool_name": "Bash", "tool_input": {"command": command}}


def test_scripts_speak_the_third_time_and_the_session_ends_with_a_digest(spark, tmp_path):
    ws = Workspace(tmp_path).ensure()
    said = [events.after_tool(spark, ws, bash(f"python3 - <<'PY'\n{SCRIPT}print({n})\nPY"), f"2024-01-02T0{n}:00:00+00:00") for n in range(4)]
    assert said[0] == said[1] == said[3] == "" and "promote" in said[2] and "2024-01-02" in said[2]
    assert "## Repeated this session" in events.at_session_end(spark, ws, "2024-01-02 12:00:00")
    assert events.at_session_end(spark, ws, "2024-01-05 12:00:00") == ""
    assert events.after_tool(spark, ws, {"tool_name": "Write", "tool_input": {"file_path": "/srv/a.py", "content": SCRIPT}}, "2024-01-02T05:00:00") == ""


def test_a_sequence_that_comes_on_a_third_day_speaks(spark, tmp_path):
    ws = Workspace(tmp_path).ensure()
    said = [events.after_tool(spark, ws, bash("docker compose up && alembic upgrade && pytest -x"), f"2024-01-0{d}T10:00:00") for d in (1, 2, 3, 4)]
    assert said[:2] == ["", ""] and "docker compose -> alembic -> pytest" in said[2] and said[3] == ""


def test_reads_of_machine_written_files_get_advice(spark, tmp_path):
    ws = Workspace(tmp_path).ensure()
    lock, small = tmp_path / "package-lock.json", tmp_path / "a.py"
    lock.write_text("x" * 1000)
    small.write_text("x")
    read = lambda p, **more: {"tool_name": "Read", "tool_input": {"file_path": str(p), **more}}
    advice = json.loads(events.before_read(spark, ws, read(lock)))["hookSpecificOutput"]
    assert advice["hookEventName"] == "PreToolUse" and "lock file" in advice["additionalContext"] and "permissionDecision" not in advice
    for event in (read(small), read(lock, offset=5), read(tmp_path / "none"), bash("ls"), {"tool_name": "Read"}):
        assert events.before_read(spark, ws, event) == ""


def test_payloads_that_are_no_events():
    assert events.payload(io.StringIO("no json")) is None and events.payload(io.StringIO("[1]")) is None
    assert events.payload(io.StringIO('{"tool_name": "Read"}')) == {"tool_name": "Read"}


def test_event_and_preview_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".git").mkdir()
    lock = tmp_path / "yarn.lock"
    lock.write_text("x" * 100)
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"tool_name": "Read", "tool_input": {"file_path": str(lock)}})))
    assert main(["event", "before-read"]) == 0 and "lock file" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("broken"))
    assert main(["event", "after-tool"]) == 0 and capsys.readouterr().out == ""
    assert main(["index", "--preview"]) == 0 and "nothing to tell yet" in capsys.readouterr().out
    (tmp_path / "m.go").write_text("// Runs it\npackage m\nfunc Run() {\n}\n")
    assert main(["index", "--out", "other.md", "--measure"]) == 0 and "languages go 1" in capsys.readouterr().out
    assert "`m.go`" in (tmp_path / "other.md").read_text() and not (tmp_path / ".tallyloom" / "MAP.md").exists()
    assert main(["index"]) == 0 and capsys.readouterr().out
    assert main(["session", "--json"]) == 0 and json.loads(capsys.readouterr().out)["hookSpecificOutput"]["hookEventName"] == "SessionStart"
    assert main(["index", "--preview"]) == 0 and "what every session here is told" in capsys.readouterr().out


def test_logs_are_tables(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"at": "x", "n": 1}\nbroken\n\n{"n": 2}\n{"n": "three"}\n')
    assert sorted((r.at or "", r.n) for r in read_log(spark, str(tmp_path / "log.jsonl"), "at string, n long").collect()) == [("", 2), ("x", 1)]


def test_stored_tables_and_their_folder(spark, monkeypatch):
    df = durable.stored(spark.range(5), "numbers")
    path = df._stored_at.removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and os.path.isdir(path)
    durable.forget(df, spark.range(1))
    assert not os.path.isdir(path)

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "spark://somewhere:7077" if key == "spark.master" else None

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        durable.shared_dir(Cluster)


def test_unsafe_settings(spark):
    files = lambda **named: spark.createDataFrame([(p, bytearray(c.encode())) for p, c in named.items()], "path string, content binary")
    live = files(**{".env": "A_NAME=1", "sub/.env": "B_NAME=2", ".env.sample": "C_NAME="})
    assert sorted(r.path for r in repository.unsafe_settings(live).collect()) == [".env", "sub/.env"]
    assert repository.unsafe_settings(files(**{".env": "A_NAME=1", ".gitignore": "*.log\n.env\n"})).count() == 0


def test_the_index_parses_contents_once(spark, tmp_path, monkeypatch):
    from tallyloom.plans import fixtures

    calls = []
    parsed = repository.parsed
    monkeypatch.setattr(repository, "parsed", lambda files: (calls.append("what" in files.columns), parsed(files))[1])
    repository.index_lines(fixtures.tree(spark)).count()
    assert calls.count(False) == 1


def test_digest_of_nothing():
    assert session.digest([]) == ""


# Letters that only equal ASCII ones when case is ignored, words around secrets, and quotes.
PIECES = st.sampled_from(["paſsword", "TOKEN", "apİ-key", "prıvate_key", " = ", ": ", "'", '"', "abcdefgh", "sk-", "a" * 20, "ghp_", "https://u:", "secretpw@h/", "\n", "AKIA" + "A" * 16, "-----BEGIN ", "RSA PRIVATE KEY-----", "é", "auth", "="])


def test_hints_lose_no_secret(spark):
    texts: list[str] = []

    @given(st.lists(PIECES, max_size=12))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for pattern, replacement in redact.PATTERNS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(replacement))
    assert rows.where(~plain.eqNullSafe(redact.scrub(F.col("text")))).count() == 0


def test_similar_pairs_by_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.sample(range(300), 30) for _ in range(8)]
    rows = [(i, [f"t{x}" for x in set(rng.sample(base[i % 8], rng.randint(15, 30)) + [rng.randrange(300) for _ in range(rng.randint(0, 8))])]) for i in range(160)]
    rows += [(900, rows[3][1]), (901, ["a", "b"]), (902, [])]
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens").collect()}
    want = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            j = len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
            if min(len(x), len(y)) >= 8 and j >= 0.55 and b != 900:
                want[a, b] = j
    want[3, 900] = 1.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 100
