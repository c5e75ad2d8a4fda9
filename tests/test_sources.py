"""Reading trees and single files of every format, and rendering a repository."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest

from tallyloom.functions import extract
from tallyloom.functions.plain import estimate
from tallyloom.plans import budget, fixtures, repository
from tallyloom.sources import peek
from tallyloom.sources.tree import read_tree


def test_tree_lists_hidden_files_and_nested_checkouts(spark, tmp_path):
    root = tmp_path / "build" / "repo"  # the root's own folders never count
    for path, text in {".env": "A_NAME=1", "__init__.py": "", "sub/_priv.py": "# x\ny = 1", ".github/b.yml": "on: x", "inner/.git/HEAD": "x", "inner/deep/z.py": "x = 1", "key.pem": "secret", "node_modules/p/.git/x": "", "node_modules/p/m.js": ""}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    rows = {r.path: r for r in read_tree(spark, str(root), files_per_task="3").collect()}
    assert set(rows) == {".env", "__init__.py", "sub/_priv.py", ".github/b.yml", "inner/.git/HEAD", "inner/deep/z.py", "key.pem", "node_modules/p/.git/x", "node_modules/p/m.js"}
    assert rows["inner/deep/z.py"].repository == "inner" and rows["node_modules/p/m.js"].repository is None
    assert rows["key.pem"].content is None and bytes(rows["sub/_priv.py"].content) == b"# x\ny = 1"
    got = repository.sources(read_tree(spark, str(root)))
    assert sorted((r.path, r.describable) for r in got.collect()) == [("__init__.py", False), ("sub/_priv.py", True)]
    assert read_tree(spark, str(tmp_path / "build" / "none")).count() == 0


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def sheet():
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    rows = [("hs_code", "description"), ("0101", "horses &amp; mules"), ("0102", "cattle")]
    body = "".join("<row>" + "".join(map(cell, r)) + "<c/></row>" for r in rows)
    return zipped({"xl/workbook.xml": '<workbook><sheet name="Duty"/></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"})


def database():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE bays(id INTEGER, code TEXT)")
    con.executemany("INSERT INTO bays VALUES (?, ?)", [(i, f"B{i}") for i in range(40)])
    con.commit()
    return con.serialize()


def tarball():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("inside.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return out.getvalue()


PDF = b"%PDF-1.4\n/Type /Page \n/Title (Report)\nstream\n" + zlib.compress(b"(Hello there) Tj") + b"endstream"
PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + bytes([8, 2]) + b"\0" * 40
CSV = "id,city,amount\n" + "".join(f"{i},town{i},{i * 2}\n" for i in range(900))


@pytest.mark.parametrize(
    "name,raw,find,wanted",
    [
        ("a.csv", CSV.encode(), None, ["3 columns, 900 data rows", "`city`", "0 | town0 | 0"]),
        ("a.csv", CSV.encode(), "TOWN77", ["line 79: 77 | town77 | 154"]),
        ("a.tsv", b"a\tb\n1\t2\n3\n", None, ["2 columns, 2 data rows", "ragged: 2"]),
        ("a.csv", b"\x00\x01binary", None, ["unrecognised"]),
        ("a.json", json.dumps({"a": {"b": [1, 2]}, "c": "secretword"}).encode(), None, ["{a: {b: [2 × int]}, c: str}"]),
        ("a.json", b'{"a": 1}\n{"a": 2}', None, ["not valid JSON", "2 lines"]),
        ("a.xlsx", sheet(), None, ["`Duty`", "`hs_code`, `description`", "horses & mules"]),
        ("a.xlsx", sheet(), "cattle", ["rows matching 'cattle' (1 of 1 shown)", "0102 | cattle"]),
        ("a.docx", zipped({"word/document.xml": "<w:p><w:t>First one</w:t></w:p><w:p></w:p><w:p><w:t>Second</w:t></w:p>"}), "second", ["2 paragraph(s)", "¶2: Second"]),
        ("a.zip", zipped({f"m{i:02d}": "x" for i in range(30)}), None, ["30 member(s)", "…+5 more"]),
        ("a.tar.gz", tarball(), None, ["1 member(s)", "inside.txt  3B"]),
        ("a.db", database(), "COD", ["`bays` (40 rows) — id, code", "tables or columns matching 'COD': bays"]),
        ("a.pdf", PDF, None, ["1 page(s)", "Title: Report", "Hello there"]),
        ("a.png", PNG, None, ["PNG 640×480, 8-bit RGB"]),
        ("a.gif", b"GIF89a" + struct.pack("<HH", 3, 4), None, ["GIF 3×4"]),
        ("a.parquet", b"PAR1xxxx", None, ["columnar (Parquet)", "Parquet; ", "crc32 of first 4KB: " + format(zlib.crc32(b"PAR1xxxx"), "08x")]),
        ("a.log", b"one\ntwo\n", "TW", ["2 lines", "2: two"]),
        ("a.py", b"x = 1\n", None, ["1 lines", "1: x = 1"]),
        ("a.xlsx", b"not a zip", None, ["1 lines"]),
        ("a.txt", ("token = abc" + "defghij\n").encode(), None, ["<REDACTED>"]),
        ("id_rsa", b"whatever", None, ["Refused"]),
    ],
)
def test_peek(name, raw, find, wanted):
    got = peek.peek(name, raw, find)
    assert all(w in got for w in wanted), got
    assert "secretword" not in got and "defghij" not in got


def test_peek_stays_within_its_budget_and_counts_code_points():
    got = peek.peek("a.txt", "\n".join(["ภาษาไทยมีความหนาแน่นสูง" * 12] * 20).encode(), budget=200)
    assert "truncated" in got and estimate(got) < 300
    assert not peek.looks_binary(("a" + "é" * 4095).encode())
    assert peek.shape([[[[[[1]]]]]]) == "[1 × [1 × [1 × [1 × [1 × …]]]]]"


def test_peek_files_and_magic(spark):
    files = spark.createDataFrame([("x.csv", bytearray(CSV.encode())), ("n.txt", None)], "path string, content binary")
    got = {r.path: r.summary for r in peek.peek_files(files).collect()}
    assert "900 data rows" in got["x.csv"] and "0 lines" in got["n.txt"]
    df = spark.createDataFrame([("p", bytearray(PNG)), ("d", bytearray(PDF)), ("t", bytearray(b"text"))], "path string, content binary")
    assert {r.path: r.k for r in df.select("path", peek.identify(df.content).alias("k")).collect()} == {"p": "PNG image", "d": "PDF document", "t": None}
    assert df.where("path = 't'").select(peek.head_crc32(df.content)).first()[0] == format(zlib.crc32(b"text"), "08x")


@pytest.mark.parametrize(
    "lang,source,wanted",
    [
        ("go", "// Package pay.\npackage pay\nfunc (s *S) Charge(a int) error {\n}\ntype S struct {\n}\nconst MaxItems = 3\n", {"Charge(a int)", "S", "MaxItems"}),
        ("rs", "pub struct Bay { }\npub async fn open<T>(x: T) {\n}\n", {"Bay", "open(x: T)"}),
        ("rb", "class Cart\n  def total\n  end\nend\n", {"Cart", "total()"}),
        ("kotlin", "data class Ship(val id: Int)\nfun load(x: Int) = when(x) {\n}\nval MAX_AGE = 3\n", {"Ship", "load(x: Int)", "MAX_AGE"}),
        ("dart", "class A {\n  void run(int x) {\n    for (var i = 0; i < 3; i++) {\n    }\n  }\n}\n", {"A", "run(int x)"}),
        ("php", "<?php\nfinal class Pay {\n  public static function charge($a) {}\n}\n", {"Pay", "charge($a)"}),
        ("tf", 'resource "aws_s3" "logs" {\n}\nmodule "net" {\n}\n', {"aws_s3.logs", "net()"}),
        ("c", "#define MAX_LEN 5\nint open(int fd);\nstatic int read_all(char *p) {\n  if (p) {\n  }\n}\nstruct bay {\n};\n", {"MAX_LEN", "open(int fd)", "read_all(char *p)", "bay"}),
        ("sh", "go_on() {\n}\n", {"go_on()"}),
        ("graphql", "type Order {\n}\n", {"Order"}),
        ("proto", "service F {\n rpc Run(A) returns (B);\n}\n", {"F", "Run(A)"}),
        ("lua", "function M.go(a)\nend\n", {"M.go(a)"}),
    ],
)
def test_symbols_by_language(lang, source, wanted):
    s = extract.symbols(source, lang)
    got = {x for x, _ in s["funcs"]} | {c for c, _, _ in s["classes"]} | set(s["consts"])
    assert got == wanted


@pytest.mark.parametrize(
    "lang,source,want",
    [
        ("js", "#!/usr/bin/env node\n// Copyright 2020 X\n\n/* Draws\n * charts\n */\n", "Draws charts"),
        ("rb", "# frozen_string_literal: true\n# Sends mail\n", "Sends mail"),
        ("swift", "//\n//  App.swift\n//  Starts it\n", "Starts it"),
        ("c", "#include <x.h>\n/* ==== CRC ==== */\n", "CRC"),
        ("ex", 'defmodule A do\n  @moduledoc """\n  Keeps time.\n  """\nend\n', "Keeps time."),
        ("rs", "/*! Reads things\n   from disk */\n", "Reads things from disk"),
        ("go", "package x\n\nfunc a() {}\n", ""),
        ("py", "", ""),
    ],
)
def test_leading_comments(lang, source, want):
    assert extract.leading_comment(source, lang) == want


def test_bad_sources_never_raise():
    for source in ("def (", "\0", "x = " + "(" * 300 + ")" * 300, '"\\d"'):
        assert set(extract.symbols(source, "py")) == {"doc", "funcs", "classes", "consts", "empty", "warn_count", "warn_msg"}
    assert extract.python_symbols('x = "\\d"\n')["warn_count"] == 1


def test_index_has_every_section_and_no_secret(spark):
    text = repository.document(fixtures.tree(spark), "demo")
    for heading in ("Quick Index", "Data model", "API surface", "Configuration", "Deployment", "Stored material", "Impact", "Full Detail"):
        assert f"## {heading}" in text
    assert "Hunter2" + "Pass" not in text and "<REDACTED>@db.internal" in text
    assert "- **`src/billing.py`** — used by `src/store.py`; **tested by** `tests/test_billing.py`" in text
    assert "- `gRPC   Fleet/Stop`  _(proto/fleet.proto)_" in text and "vendored/inner.py" not in text and "generated.py" not in text
    assert repository.index_lines(fixtures.tree(spark).limit(0)).count() == 0


def test_budget(spark):
    index = "# Map\n\n" + "\n".join(f"- **`pkg{i % 4}/file{i:03d}.py`** (9L) — does something of use" for i in range(400)) + "\n- **`top.py`** (1L) — x"
    small = budget.rolled_up(index, "MAP.md", 3000)
    assert all(f"- **pkg{i}/** (100)" in small for i in range(4)) and "(root)/** (1)" in small and "_+92 more_" in small and estimate(small) <= 3000
    odd = budget.rolled_up("\n".join(f"row {i} of another shape" for i in range(2000)), "MAP.md", 500)
    assert "Cut to fit" in odd and estimate(odd) <= 500
