"""The detectors on streams, against a plain replay."""

from __future__ import annotations

import random

from tallyloom.streaming import watch


def streamed(spark, tmp_path, rows, schema, detector):
    """Rows written as three files, one micro-batch each."""
    folder = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame(rows[len(rows) * n // 3 : len(rows) * (n + 1) // 3], schema).coalesce(1).write.mode("append").json(str(folder))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    return watch.drained(detector(events), str(tmp_path / "out")).collect()


def test_script_repeats(spark, tmp_path):
    script = "import json\nfor record in open_records(path):\n    total_amount += record['amount_value']\nprint(total_amount, currency_name, report_header)\n"
    other = "select_rows where_clause group_by having_count order_limit offset_value window_frame partition_key"
    rows = [("r", f"2024-01-0{i + 1}T00:00:00", i, "Bash", f"python3 <<'EOF'\n{script}# try {i}\nEOF", None, None) for i in range(4)]
    rows += [("r", "2024-01-09T00:00:00", 9, "Write", None, "/tmp/x.sql", other), ("s", "2024-01-09T00:00:00", 9, "Write", None, "/home/x.py", script), ("s", "2024-01-09T00:00:01", 10, "Bash", "ls", None, None)]
    got = streamed(spark, tmp_path, rows, "repo string, at string, ord long, tool string, command string, path string, content string", watch.watch_scripts)
    assert [(r.repo, r.at, r.since, r["count"]) for r in got] == [("r", "2024-01-03T00:00:00", "2024-01-01", 3)]


def test_workflows_against_a_replay(spark, tmp_path):
    rng = random.Random(3)
    rows = [(repo, f"2024-01-{d:02d}T10:00:{n:02d}", d * 100 + n, [rng.choice("abc")]) for repo in "xy" for d in range(1, 8) for n in range(rng.randint(2, 8))]
    want = []
    for repo in "xy":
        seen, best = [], None
        for _, at, _, steps in sorted(r for r in rows if r[0] == repo):
            seen = [*seen, *((at, s) for s in steps)][-watch.KEPT_STEPS :]
            now = watch.repeated(seen)
            if now and (best is None or now[0] != best[0]):
                want.append((repo, at, list(now[0]), now[1]))
            best = now
    rows.sort(key=lambda r: (r[1], r[0]))
    got = streamed(spark, tmp_path, rows, "repo string, at string, ord long, steps array<string>", watch.watch_workflows)
    assert want and sorted((r.repo, r.at, r.sequence, r.days) for r in got) == sorted(want)
