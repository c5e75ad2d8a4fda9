"""A workspace's files, the commands over it, and the documents made from it."""

from __future__ import annotations

import json
import os
import time

import pytest

from tallyloom.__main__ import main
from tallyloom.functions.plain import estimate
from tallyloom.plans import session
from tallyloom.sources.workspace import DEFAULTS, Workspace, find_root, pending


def test_nearest_root_wins(tmp_path):
    inner = tmp_path / "outer" / "inner" / "deep"
    inner.mkdir(parents=True)
    (tmp_path / "outer" / ".tallyloom").mkdir()
    assert find_root(inner) == tmp_path / "outer"
    (tmp_path / "outer" / "inner" / ".git").write_text("x")
    assert find_root(inner) == tmp_path / "outer" / "inner"


def test_settings_merge_and_are_written_once(tmp_path):
    ws = Workspace(tmp_path)
    (tmp_path / ".tallyloom").mkdir()
    path = tmp_path / ".tallyloom" / "config.json"
    path.write_text(json.dumps({"map": False, "unknown": 1}))
    assert not ws.enabled("map") and ws.enabled("report")
    ws.ensure()
    assert json.loads(path.read_text()) == DEFAULTS | {"map": False}
    before = path.stat().st_mtime_ns
    ws.ensure()
    assert path.stat().st_mtime_ns == before
    path.write_text("no json")
    assert ws.settings() == DEFAULTS


def test_retention(tmp_path):
    ws = Workspace(tmp_path).ensure()
    for name, days in (("logs/old", 8), ("logs/new", 6), ("sessions/old.md", 31), ("sessions/new.md", 29), ("memory/rules/old.md", 900)):
        p = ws.folder / name
        p.write_text("x")
        os.utime(p, (time.time() - days * 86_400,) * 2)
    assert ws.prune() == 2 and not (ws.folder / "logs/old").exists() and (ws.folder / "memory/rules/old.md").exists()
    assert ws.prune(now=time.time() + 900 * 86_400) == 2


def test_logs_tools_and_milestones(tmp_path):
    ws = Workspace(tmp_path).ensure()
    (ws.folder / "logs" / "c.jsonl").write_text('{"n": 0}\nbroken\n')
    assert [e["n"] for e in ws.append_log("c.jsonl", ({"n": i} for i in range(1, 6)), 4)] == [2, 3, 4, 5]
    assert ws.append_log("c.jsonl", [], 400) == [{"n": i} for i in (2, 3, 4, 5)]
    script = tmp_path / "check.sh"
    script.write_text("echo ok\n")
    tool = ws.install_tool(script, "health", "checks it")
    assert tool.name == "health.sh" and os.access(tool, os.X_OK) and ws.tools()[0]["desc"] == "checks it"
    with pytest.raises(FileExistsError):
        ws.install_tool(script, "health")
    ws.append_milestone("2024-01-01", "One", why="because", affected="")
    ws.append_milestone("2024-02-01", "Two")
    assert ws.text("milestones.md") == "# Project milestones\n\n## 2024-01-01 — One\n\n**Why:** because\n\n## 2024-02-01 — Two\n"


def test_pending_cells(spark):
    cells = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "a")], "q string, arm string")
    assert sorted(tuple(r) for r in pending(cells, cells.limit(1), ["q", "arm"]).collect()) == [("q1", "b"), ("q2", "a")]


def test_index_and_session_block(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("# Adds things\ndef add(x, y):\n    return x + y\n")
    (tmp_path / "src" / "b.py").write_text("import a\n")
    ws = Workspace(tmp_path).ensure()
    assert session.session_block(spark, ws) == ""
    said = session.index_report(spark, ws, [])
    assert "2 source file(s)" in said and "1/2 files (50%)" in said and "within the budget" in said
    assert "`src/a.py`** (4L, 1fn) — Adds things" in ws.text("MAP.md")
    assert "2 source file(s)" in session.index_report(spark, ws, ["src", "."])
    (ws.folder / "memory/rules/r.md").write_text("# Rule\nnever " + "pass" + "word = abcdefghi")
    (ws.folder / "memory/decisions/d.md").write_text("# Use it")
    (ws.folder / "sessions/2024-01-02-x.md").write_text("# Work\n## Remaining\n- finish")
    (ws.folder / "skills/s.md").write_text("---\ndescription: how to deploy\n---\n")
    (ws.folder / "STATE.md").write_text("half way")
    ws.append_milestone("2024-01-01", "Started")
    block = session.session_block(spark, ws)
    order = ["Architecture index", "Rules this", "Recorded decisions", "Recent milestones", "Where the last", "Work in flight", "Recorded procedures"]
    assert [block.index(x) for x in order] == sorted(block.index(x) for x in order)
    assert "abcdefghi" not in block and "- finish" in block and "how to deploy" in block and "Full Detail" not in block
    ws.write_index("# M\n\n" + "\n".join(f"- **`p{i % 3}/f{i}.py`** (1L) — x" for i in range(2000)) + "\n\n## Full Detail\n")
    assert estimate(session.session_block(spark, ws)) < 3600


def test_usage_report(spark, tmp_path):
    usage = lambda n: {"input_tokens": n, "output_tokens": 10, "cache_read_input_tokens": 100 * n}
    lines = [{"requestId": f"r{i}", "timestamp": f"2024-01-{d:02d}T12:00:00Z", "message": {"model": "m-20240101", "usage": usage(n)}} for i, (d, n) in enumerate([(2, 4), (3, 4), (10, 9), (17, 2)])]
    lines += [lines[0] | {"message": {"model": "m", "usage": usage(1)}}, {"requestId": "x", "timestamp": "bad", "message": {"model": "m", "usage": usage(1)}}]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"usage" broken\n')
    said = session.usage_report(spark, str(tmp_path), "2024-01-10")
    assert said.startswith("4 calls across 3 week(s)")
    assert "before        2 calls   context/call        400" in said and "after         1 calls   context/call        200" in said and "-50.0% context" in said
    assert session.usage_report(spark, str(tmp_path), None).count("\n") == 5


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".git").mkdir()
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert main(["peek", "x.csv"]) == 0 and "2 columns, 1 data rows" in capsys.readouterr().out
    assert main(["promote", "x.csv", "data", "--desc", "two", "words"]) == 0 and main(["promote", "x.csv", "data"]) == 1
    assert main(["tools"]) == 0 and "two words" in capsys.readouterr().out
    (tmp_path / "m.go").write_text("// Runs it\npackage m\nfunc Run() {\n}\n")
    assert main(["index"]) == 0 and "1 source file(s)" in capsys.readouterr().out
    assert main(["session"]) == 0 and "`m.go`" in capsys.readouterr().out
