"""The table function extract_symbols(path, source): a row for each symbol that a source file declares.

    register(spark)
    spark.sql("SELECT f.path, s.* FROM files f, LATERAL extract_symbols(f.path, f.source) s")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import extract

SYMBOL = "kind string, name string, args string, doc string"


class ExtractSymbols:
    """Rows (kind, name, args, doc): kinds are func, class, method and const. A path of no known language, or a null source, gives none."""

    def eval(self, path: str, source: str) -> Iterator[tuple]:
        lang = extract.LANGUAGE.get("." + (path or "").rpartition(".")[2].lower())
        if lang is None or source is None:
            return
        found = extract.symbols(source, lang)
        for signature, doc in found["funcs"]:
            name, _, args = signature.partition("(")
            yield "func", name, args.removesuffix(")"), doc
        for name, doc, methods in found["classes"]:
            yield "class", name, "", doc
            yield from (("method", f"{name}.{m}", "", "") for m in methods)
        yield from (("const", c, "", "") for c in found["consts"])


def register(spark: SparkSession, name: str = "extract_symbols") -> None:
    spark.udtf.register(name, udtf(ExtractSymbols, returnType=SYMBOL))
