"""Queries over inline inputs whose results are listed in `expected`: every format, language and document kind that the tables at hand have no column for.

Inputs are small on purpose, and each row is there for a rule. Credential-like
strings are put together here, so that none is written down.
"""

from __future__ import annotations

import io
import json
import os
import re
import sqlite3
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import symbols, text
from ..operators import stores
from ..sources import peek as peeks
from ..sources.durable import fresh_path
from ..sources.tree import read_tree
from ..sources.workspace import Workspace, read_documents, read_log
from ..streaming import watch
from . import budget, events, fixtures, repository, session
from .catalogue import ORACLES, QUERIES, Query
from .expected import EXPECTED


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return f"[{', '.join(map(literal, value))}]::VARCHAR[]"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def listed(columns: tuple[str, ...]) -> Callable[[Query], Query]:
    """Registers a query whose rows of these columns are listed in EXPECTED under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        rows = ", ".join(f"({', '.join(map(literal, r))})" for r in EXPECTED[f.__name__])
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {rows}) AS t({', '.join(columns)})"
        return f

    return add


def _mounted(path: str) -> str:
    """A path of the shared folder as this process sees it; these queries write small inputs there, so it has to be a mounted one."""
    return re.sub("^file:/+", "/", path)


def files(spark: SparkSession, named: dict[str, str | bytes]) -> DataFrame:
    rows = [(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in named.items()]
    return spark.createDataFrame(rows, "path string, content binary")


SOURCES = {
    "a/cart.ts": "export async function load(id, n) {\n}\nexport const add = (x) => {\n}\nexport class Cart {\n  total(tax: number): number {\n    if (tax) {\n    }\n  }\n}\nexport const MAX_ROWS = 5;\n",
    "a/pay.go": "// Package pay.\npackage pay\nfunc (s *S) Charge(a int) error {\n}\ntype S struct {\n}\nconst MaxItems = 3\n",
    "a/run.sh": "go_on() {\n}\nfunction stop() {\n}\n",
    "a/cart.rb": "class Cart\n  def total\n  end\nend\n",
    "a/bay.rs": "pub struct Bay { }\npub async fn open<T>(x: T) {\n}\n",
    "a/Ship.java": "public class Ship {\n    public static int load(int a) {\n    }\n}\n",
    "a/ship.kt": "data class Ship(val id: Int)\nfun load(x: Int) = when(x) {\n}\nval MAX_AGE = 3\n",
    "a/net.tf": 'resource "aws_s3" "logs" {\n}\nmodule "net" {\n}\n',
    "a/pay.php": "<?php\nfinal class Pay {\n  public static function charge($a) {}\n}\n",
    "a/bay.c": "#define MAX_LEN 5\nint open(int fd);\nstatic int read_all(char *p) {\n  if (p) {\n  }\n}\nstruct bay {\n};\n",
    "a/Bay.cs": "public sealed class Bay {\n    public static int Open(int x)\n}\n",
    "a/app.swift": "public final class App {\n    func run(at: Int) {\n    }\n}\n",
    "a/a.dart": "class A {\n  void run(int x) {\n    for (var i = 0; i < 3; i++) {\n    }\n  }\n}\n",
    "a/m.lua": "function M.go(a)\nend\n",
    "a/B.scala": "case class Bay(id: Int)\nobject Yard {\n  def open(x: Int) = x\n}\n",
    "a/c.ex": "defmodule Clock.Face do\n  def tick(x) do\n  end\nend\n",
    "a/z.zig": "pub fn main(a: u8) void {\n}\npub const MaxLen = 3;\n",
    "a/n.nim": "type Bay = ref object\nproc open*(x: int) =\n",
    "a/f.proto": "service Fleet {\n  rpc Run(A) returns (B);\n}\nmessage A {\n}\n",
    "a/q.graphql": "type Order {\n}\ninput Filter {\n}\n",
    "a/mod.py": '"""Counts. Then more."""\nLIMIT = 3\nab = 1\n\n\nclass Box:\n    """Holds."""\n\n    def put(self, x):\n        pass\n\n\nasync def run(a, *b, c=1):\n    """Runs it."""\n',
    "a/broken.py": "# Says this\ndef (\n",
    "a/notes.txt": "function x() {\n}\n",
}


@listed(("path", "kind", "name", "args", "doc"))
def symbols_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over a file of each language."""
    symbols.register(spark)
    rows = files(spark, SOURCES).select("path", F.decode("content", "UTF-8").alias("source"))
    return spark.sql("SELECT f.path, s.kind, s.name, s.args, s.doc FROM {rows} f, LATERAL extract_symbols(f.path, f.source) s", rows=rows)


COMMENTED = {
    "b/1.js": "#!/usr/bin/env node\n// Copyright 2020 X\n\n/* Draws\n * charts\n */\n",
    "b/2.rb": "# frozen_string_literal: true\n# Sends mail\n",
    "b/3.swift": "//\n//  App.swift\n//  Starts it\n",
    "b/4.c": "#include <x.h>\n/* ==== CRC ==== */\n",
    "b/5.ex": 'defmodule A do\n  @moduledoc """\n  Keeps time.\n  """\nend\n',
    "b/6.rs": "/*! Reads things\n   from disk */\nfn a() {}\n",
    "b/7.go": "package x\n\nfunc a() {}\n",
    "b/8.py": "",
    "b/9.py": "# only a comment\n",
    "b/a.py": 'x = "\\d"\n',
    "b/b.ts": "/** @file cart.ts\n * @brief Adds {@link Item} to <b>carts</b>\n * @param x nothing\n */\nexport const A_B = 1\n",
    "b/c.cs": "#region x\n/// <summary>Loads bays</summary>\nclass A {}\n",
    "b/d.sh": "# Released under the MIT licence, see LICENSE\n\n# Rotates logs\n",
}


@listed(("path", "doc", "describable", "warn_count"))
def leading_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.sources(files(spark, COMMENTED)).select("path", "doc", "describable", "warn_count")


IMPORTING = {
    "c/a.py": "from src.store import x\nimport os, sys\n  import re\n",
    "c/a.js": "import x from './lib/cart'\nconst y = require(\"fs\")\n",
    "c/a.go": 'import (\n  "fmt"\n  log "a/b-c"\n)\n',
    "c/A.java": "import static a.b.C.d;\nimport a.E;\n",
    "c/a.kt": "import a.b\n",
    "c/a.rb": "require 'json'\nrequire_relative 'cart'\n",
    "c/a.rs": "pub use crate::bay::Bay;\nuse std::io;\n",
    "c/a.php": "<?php\nuse App\\Cart;\nrequire_once 'x.php';\n",
    "c/a.c": '#include "bay.h"\n#include <stdio.h>\n',
    "c/a.swift": "import UIKit\n",
    "c/a.dart": "import 'package:a/b.dart';\n",
    "c/a.ex": "alias A.B\nuse C\n",
    "c/a.scala": "import a.b.C\n",
    "c/a.cs": "using static A.B;\nusing C;\n",
    "c/a.lua": "local m = require('a.b')\n",
    "c/a.sh": "source x.sh\n",
    "c/late.py": "\n" * 200 + "import late\n",
}


@listed(("path", "pos", "name"))
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of a file of each language, in the order in which the patterns find them, in the first 200 lines."""
    return repository.sources(files(spark, IMPORTING)).select("path", F.posexplode("imports").alias("pos", "name"))


TAGGED = (
    "@file cart.c Adds things",
    "Loads it <param name='x'>the x</param> and more",
    "Opens a bay @param x the bay @return y",
    'See <see cref="Bay.Open"/> for it',
    "<summary>Loads <c>bays</c></summary>",
    "Uses {@link Bay} and {@code x}",
    "\\brief Adds \\ref x",
    "a List<String> of name@host.org by @Test",
    "==== Title ==== and   blanks\n here",
    "x" * 120,
    "",
)


@listed(("id", "summary"))
def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(TAGGED)), "id int, said string")
    return rows.select("id", text.clip_summary(F.col("said")).alias("summary"))


@listed(("what", "got"))
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rule of the smaller text functions."""
    one = spark.range(1)
    thai = "\u0e01" * 500 + "a" * 500
    told = {
        "nothing: bullets": text.is_nothing(F.lit("- None.\n* n/a\n")).cast("string"),
        "nothing: empty": text.is_nothing(F.lit("")).cast("string"),
        "nothing: something": text.is_nothing(F.lit("- none\n- deploy")).cast("string"),
        "flatten": text.flatten_headings(F.lit("# Use it\n## Why\ntext # no")),
        "title": text.title_of(F.lit("x\n# The title \n# Other"), F.lit("stem")),
        "title: none": text.title_of(F.lit("## deeper"), F.lit("stem")),
        "description": text.described(F.lit("---\nname: x\nDescription:  how to   deploy\n---\nbody")),
        "description: no matter": text.described(F.lit("description: no")),
        "bar": text.bar(F.lit(37.5)),
        "headline": text.headline(F.lit("# note\nimport os\n\n  run( 1 )\nrest")),
        "headline: only comments": text.headline(F.lit("// a\n// b")),
        "model": text.model_family(F.lit("some-model-4-20240229")),
        "entities": text.unescape_xml(F.lit("&amp;lt; &lt;a&gt; &quot;&apos;")),
        "bytes": text.human_bytes(F.lit(3 * 1024**4), ("B", "KB", "MB", "GB", "TB")),
        "bytes: GB at most": text.human_bytes(F.lit(3 * 1024**4)),
        "cut: thai": text.token_cut(F.lit(thai), 400).cast("string"),
        "cut: thai, then latin": text.token_cut(F.lit(thai), 500).cast("string"),
        "cut: cjk": text.token_cut(F.lit("\u4e2d" * 500), 400).cast("string"),
        "cut: none": text.token_cut(F.lit("abc"), 0).cast("string"),
        "estimate: mixed": F.round(text.token_estimate(F.lit("\u4e2d\u0e01abcdef")), 2).cast("string"),
        "slug": text.slugify(F.lit("  Ünder_score & more!  ")),
        "slug: nothing left": text.slugify(F.lit("--")),
    }
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, told)), F.array(*told.values()))).alias("what", "got"))


def payloads() -> list[str]:
    heredoc = "python3 - <<'PY'\nshort\nPY\ncat <<E\nthe longer body of the two\nE"
    tools = [
        {"tool_name": "Bash", "tool_input": {"command": heredoc}},
        {"tool_name": "Bash", "tool_input": {"command": "ls -la"}},
        {"tool_name": "Write", "tool_input": {"file_path": "/tmp/x.py", "content": "print(1)"}},
        {"tool_name": "Edit", "tool_input": {"file_path": "/srv/scratch/x.py", "new_string": "print(2)"}},
        {"tool_name": "Write", "tool_input": {"file_path": "/srv/app/x.py", "content": "print(3)"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/package-lock.json"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/dist/app.js"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/app.min.js"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/large.log"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/huge.log"}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/huge.log", "offset": 10}},
        {"tool_name": "Read", "tool_input": {"file_path": "/srv/small.py"}},
    ]
    return [*map(json.dumps, tools), "no json", "[1]", "{}"]


def tool_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(payloads())), "ord int, value string")


@listed(("ord", "tool", "script"))
def script_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts in tool events: here-documents of commands, and what is written to scratch files."""

    @F.pandas_udf("string")
    def script(tool: pd.Series, command: pd.Series, path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([watch.script_of(*x) for x in zip(tool, command, path, content, strict=True)])

    return events.tool_events(tool_lines(spark)).where("tool <> 'Read'").select("ord", "tool", script("tool", "command", "path", "content").alias("script"))


SIZES = {"/srv/package-lock.json": 1_000, "/srv/dist/app.js": 5_000, "/srv/app.min.js": 36, "/srv/large.log": 200_000, "/srv/huge.log": 1_000_000, "/srv/small.py": 199_999}


@listed(("ord", "notice", "sentence"))
def read_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.createDataFrame(list(SIZES.items()), "path string, size long")
    return events.read_notices(events.tool_events(tool_lines(spark)).join(sizes, "path")).select("ord", "notice", "sentence")


RECORDS = [
    ("r", "2024-01-01-old.md", "# Old work\n## Remaining\n- forgotten\n"),
    ("r", "2024-02-03-new.md", "# New work\n## Done\n- all\n## Remaining\n- finish it\n## Blockers\n- none\n## Odd\nkept\n## Remaining\n- finish it well\n"),
    ("s", "2024-01-01-x.md", "# Done\n## Remaining\nnothing\n"),
    ("t", "notes.md", "text\n## Blockers\n" + "\n".join(f"- a line that takes some room, number {i:03d}" for i in range(40))),
]


@listed(("repo", "name", "carried"))
def carried_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.carried(spark.createDataFrame(RECORDS, "repo string, name string, text string"), ["repo"])


@listed(("name", "pos", "heading", "body"))
def record_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RECORDS[:2], "repo string, name string, text string")
    return rows.select("name", F.posexplode(stores.sections(F.col("text"))).alias("pos", "s")).select("name", "pos", "s.heading", "s.body")


def memory(spark: SparkSession) -> DataFrame:
    entries = [("r", "rules", f"{i}.md", f"# Rule {i}\n" + "word " * 130) for i in range(4)]
    entries += [("r", "decisions", f"d-{i}.md", f"# Decide {i}" if i else "no heading") for i in range(6)]
    entries += [("r", "lessons", f"l{i}.md", f"# Learn {i} pass" + "word = abcdefghij") for i in range(5)] + [("s", "rules", "one.md", "# Be kind\n## Why\nso")]
    return spark.createDataFrame(entries, "repo string, category string, name string, text string")


@listed(("repo", "decisions", "lessons", "rules"))
def memory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.category_counts(memory(spark), ["repo"])


@listed(("repo", "length", "ending"))
def memory_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.rules(memory(spark), ["repo"]).select("repo", F.char_length("rules").alias("length"), F.right("rules", F.lit(60)).alias("ending"))


@listed(("repo", "category", "title", "name", "rank"))
def memory_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.titles(memory(spark), ["repo"])


@listed(("date", "title", "body", "rank", "earlier"))
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "# Project milestones\n\n## 2024-01-01 — Start\n\n**Why:** because\n\n## no date\nx\n\n## 2024-02-01 - Second\n\n## 2024-03-01 — Third\nsome\ntext\n"
    found = stores.milestones(spark.createDataFrame([("r", said)], "repo string, text string"), ["repo"])
    return stores.recent_milestones(found, ["repo"]).select("date", "title", "body", "rank", "earlier")


def _lines(spark: SparkSession, said: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(said.split("\n"))), "pos int, line string")


def _workspace(root: str) -> Workspace:
    ws = Workspace(root).ensure()
    (ws.folder / "memory/rules/r.md").write_text("# Rule\nnever " + "pass" + "word = abcdefghi")
    (ws.folder / "memory/decisions/d.md").write_text("# Use it")
    (ws.folder / "sessions/2024-01-02-x.md").write_text("# Work\n## Remaining\n- finish")
    (ws.folder / "skills/s.md").write_text("---\ndescription: how to deploy\n---\n")
    (ws.folder / "STATE.md").write_text("half way\n" + "s" * 4100)
    for n in range(1, 4):
        ws.append_milestone(f"2024-0{n}-01", f"Milestone {n}", why="because", affected="")
    (ws.folder / "tools/index.json").write_text(json.dumps([{"name": f"tool{n:02d}", "desc": "checks" if n % 2 else ""} for n in range(14)]))
    (ws.folder / "config.json").write_text(json.dumps(ws.settings() | {"reply_style": "terse", "index_token_budget": 60, "agents": False, "unknown": 1}))
    ws.write_index("# Map\n\n" + "\n".join(f"- **`p{n % 2}/f{n}.py`** (1L) — x" for n in range(20)) + "\n\n## Full Detail\nnever told")
    return ws


@listed(("pos", "line"))
def session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session is told when it starts, line by line; lines over 120 characters by their length."""
    with tempfile.TemporaryDirectory() as root:
        said = session.session_block(spark, _workspace(root))
    return _lines(spark, "\n".join(x if len(x) <= 120 else str(len(x)) for x in said.split("\n")))


@listed(("name", "value"))
def workspace_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings after merging with the defaults: unknown ones gone, missing ones added."""
    with tempfile.TemporaryDirectory() as root:
        kept = json.loads((_workspace(root).ensure().folder / "config.json").read_text())
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in kept.items()], "name string, value string")


@listed(("pos", "line"))
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "\n".join(f"- **`pkg{i % 3}/deep/file{i:03d}.py`** (9L) — does something of use" for i in range(60))
    cut = budget.within("\n".join(f"line {i} of a text without rows" for i in range(200)), "MAP.md", 60)
    return _lines(spark, budget.rolled_up(f"# Map\n\n{rows}\n- **`top.py`** (1L) — x", "MAP.md", 3000) + "\n----\n" + cut)


USAGE = [("r0", "2024-01-02", 4), ("r1", "2024-01-03", 4), ("r2", "2024-01-10", 9), ("r3", "2024-01-17", 2), ("r0", "2024-01-02", 1), ("r4", "bad", 1)]


@listed(("pos", "line"))
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "usage")
    usage = lambda n: {"input_tokens": n, "output_tokens": 10, "cache_read_input_tokens": 100 * n}
    said = [json.dumps({"requestId": r, "timestamp": f"{d}T12:00:00Z", "message": {"model": "m-20240101", "usage": usage(n)}}) for r, d, n in USAGE]
    spark.createDataFrame([(x,) for x in [*said, '{"usage" broken', "{}"]], "value string").write.text(f"{folder}/deep.jsonl")
    # Spark's part files are found below a folder by their own ending.
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.lit("x").alias("path"), F.monotonically_increasing_id().alias("ord"))
    return _lines(spark, session.usage_text(lines, "2024-01-10"))


@listed(("path", "size", "repository", "opened"))
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree on disk through the file source: hidden files and nested checkouts are listed, keys and large files never opened."""
    named = {".env": "A_NAME=1", "src/a.py": "x = 1\n", ".github/b.yml": "on: x", "inner/.git/HEAD": "x", "inner/deep/z.py": "x = 1", "key.pem": "secret", "node_modules/p/.git/x": "", "node_modules/p/m.js": "", "big.txt": "x" * 60}
    root = _mounted(fresh_path(spark, "tree"))
    for path, said in named.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(said)
    return read_tree(spark, root, max_bytes="50").select("path", F.col("size").cast("int").alias("size"), "repository", F.col("content").isNotNull().alias("opened"))


def zipped(named: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, said in named.items():
            z.writestr(name, said)
    return out.getvalue()


def sheet() -> bytes:
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    rows = [("hs_code", "description"), ("0101", "horses &amp; mules"), ("0102", "cattle")]
    body = "".join("<row>" + "".join(map(cell, r)) + "<c/></row>" for r in rows)
    return zipped({"xl/workbook.xml": '<workbook><sheet name="Duty"/></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"})


def database() -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE bays(id INTEGER, code TEXT)")
    con.executemany("INSERT INTO bays VALUES (?, ?)", [(i, f"B{i}") for i in range(40)])
    con.execute("CREATE TABLE lanes(name TEXT)")
    con.commit()
    return con.serialize()


def tarball() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in range(27):
            info = tarfile.TarInfo(f"inside{n:02d}.txt")
            info.size = n
            t.addfile(info, io.BytesIO(b"x" * n))
    return out.getvalue()


def formats() -> dict[str, bytes]:
    pdf = b"%PDF-1.4\n/Type /Page \n/Type /Pages\n/Title (Report)\n/Author (Me)\nstream\n" + zlib.compress(b"(Hello there) Tj (again) Tj") + b"endstream"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + bytes([8, 2]) + b"\0" * 40
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 10
    table = "id,city,amount\n" + "".join(f"{i},town{i},{i * 2}\n" for i in range(900))
    secret = "token = abc" + "defghij"
    return {
        "a.csv": table.encode(), "b.tsv": b"a\tb\n1\t2\n3\n", "c.csv": b"\x00\x01binary", "d.json": json.dumps({"a": {"b": [1, 2]}, "c": "hidden", "e": [[[[[1]]]]]}).encode(),
        "e.json": b'{"a": 1}\n{"a": 2}', "f.xlsx": sheet(), "g.docx": zipped({"word/document.xml": "<w:p><w:t>First one</w:t></w:p><w:p></w:p><w:p><w:t>Second</w:t></w:p>", "docProps/core.xml": "<dc:title>Plan</dc:title>"}),
        "h.zip": zipped({f"m{i:02d}": "x" for i in range(30)}), "i.tar.gz": tarball(), "j.db": database(), "k.pdf": pdf, "l.png": png, "m.jpg": jpeg, "n.gif": b"GIF89a" + struct.pack("<HH", 3, 4),
        "o.parquet": b"PAR1xxxx", "p.log": b"one\ntwo\n", "q.py": b"x = 1\n", "r.xlsx": b"not a zip", "s.txt": f"{secret}\nplain\n".encode(), "id_rsa": b"whatever", "t.bin": b"\x7fELF" + bytes(range(200)), "u.dat": b"", "v.bmp": b"BM",
    }


@listed(("path", "line_no", "line"))
def peek_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a file of each format, without its header and its cost."""
    got = peeks.peek_files(files(spark, formats()))
    lines = F.slice(F.split("summary", "\n"), F.lit(4), F.greatest(F.size(F.split("summary", "\n")) - 5, F.lit(0)))
    return got.select("path", F.posexplode(lines).alias("line_no", "line"))


@listed(("path", "line_no", "line"))
def peek_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, looking for `TWO`, `town77` or the like in files of the formats that can be searched."""
    wanted = {"a.csv": "TOWN77", "d.json": "hid", "f.xlsx": "cattle", "g.docx": "second", "h.zip": "m2", "i.tar.gz": "SIDE1", "j.db": "COD", "k.pdf": "there", "p.log": "TW"}
    got = None
    for path, find in wanted.items():
        one = peeks.peek_files(files(spark, {path: formats()[path]}), find)
        got = one if got is None else got.unionByName(one)
    lines = F.slice(F.split("summary", "\n"), F.lit(4), F.greatest(F.size(F.split("summary", "\n")) - 5, F.lit(0)))
    return got.select("path", F.posexplode(lines).alias("line_no", "line"))


@listed(("path", "kind", "crc"))
def magic_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by their first bytes, and the checksum of the first 4 KB, without Python."""
    chosen = {p: c for p, c in formats().items() if p in ("b.tsv", "k.pdf", "l.png", "m.jpg", "n.gif", "o.parquet", "p.log", "t.bin", "u.dat")}
    got = files(spark, chosen)
    return got.select("path", peeks.identify(F.col("content")).alias("kind"), F.when(F.col("path") != "k.pdf", peeks.head_crc32(F.col("content"))).alias("crc"))


def scripts() -> list[tuple]:
    body = "total_cost = sum(entry['cost'] for entry in records['days'])\ncall_count = sum(entry['calls'] for entry in records['days'])\nprint(f'cost={total_cost} calls={call_count}')\n"
    rows = [("r", f"2024-01-0{n + 1}T10:00:00", n, "Bash", f"python3 - <<'PY'\n{body}print({n})\nPY", None, None) for n in range(5)]
    rows += [("r", "2024-01-02T11:00:00", 9, "Bash", "ls", None, None), ("s", "2024-01-01T10:00:00", 0, "Write", None, "/tmp/a.py", body), ("s", "2024-01-01T10:00:01", 1, "Write", None, "/srv/a.py", body)]
    return rows


@listed(("repo", "at", "since", "count"))
def watch_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script detector over a stream: silent, silent, then it speaks once."""
    folder = fresh_path(spark, "scripts")
    rows = spark.createDataFrame(scripts(), "repo string, at string, ord long, tool string, command string, path string, content string")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    return watch.drained(watch.watch_scripts(stream), folder).select("repo", "at", "since", F.col("count").cast("int").alias("count"))


@listed(("pos", "line"))
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the last day's scripts from their log, which has malformed lines."""
    tokens = [f"name{n}" for n in range(10)]
    entry = lambda at, fp, head: json.dumps({"at": at, "fp": fp, "head": head})
    said = [entry(f"2024-01-02T0{n}:00:00+00:00", [*tokens, f"own{n}"], f"counts calls {n}") for n in range(4)]
    said += [entry("2023-12-31T00:00:00+00:00", tokens, "too old"), entry("2024-01-02T05:00:00+00:00", ["other", "words"], "once"), "broken", '{"at": 3}']
    folder = fresh_path(spark, "log")
    spark.createDataFrame([(x,) for x in said], "value string").coalesce(1).write.text(folder)
    return _lines(spark, session.session_digest(spark, folder, "2024-01-02 12:00:00"))


@listed(("name", "title"))
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of a folder as a table."""
    folder = _mounted(fresh_path(spark, "documents"))
    os.makedirs(folder)
    for name, said in {"a.md": b"# First\ntext", "b.md": b"bad \xff byte", "c.txt": b"# no"}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(said)
    return read_documents(spark, folder).select("name", text.title_of(F.col("text"), F.col("text")).alias("title"))


@listed(("at", "sig"))
def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines as a table; what is malformed is left out."""
    folder = fresh_path(spark, "commands")
    said = ['{"at": "2024-01-01T10:00:00", "sig": "docker compose"}', "no json", "", '{"at": "2024-01-02T10:00:00", "sig": "pytest"}', '{"sig": "half"']
    spark.createDataFrame([(x,) for x in said], "value string").write.text(folder)
    return read_log(spark, folder, "at string, sig string")


def large(spark: SparkSession) -> DataFrame:
    """A repository over every cap: 45 tables, 62 routes, 55 settings, an .env that is ignored."""
    named = {"db/all.sql": "".join(f"CREATE TABLE t{n:02d} (id int);\n" for n in range(45)), ".gitignore": "*.log\n.env\n", ".env": "".join(f"NAME_{n:02d}=x\n" for n in range(55))}
    named["api.js"] = "".join(f"app.get('/r{n:02d}', h);\n" for n in range(62))
    return files(spark, named)


@listed(("section", "pos", "line"))
def repo_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says where a cap cuts it: the first lines of each section."""
    got = repository.index_lines(large(spark)).where("section IN ('tables', 'routes', 'settings')")
    return got.where("pos IN ('0', '1', '1t00', '1t44', '10001', '10060', '1NAME_00', '1NAME_49', '1NAME_50') OR startswith(pos, '2')")


@listed(("line_no", "line"))
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole document of the small repository, down to its detail."""
    return _lines(spark, repository.document(fixtures.tree(spark), "demo").rstrip("\n")).withColumnRenamed("pos", "line_no")


@listed(("section", "pos", "line"))
def repo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.index_lines(fixtures.tree(spark))
