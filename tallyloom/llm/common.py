"""Helpers shared by the training-data operators: durable intermediate tables and text streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import forget, shared_dir, stored

__all__ = ["forget", "fresh", "in_batches", "pick", "rows", "shared_dir", "stored", "table"]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under the operator's own names: extra or clashing ones vanish."""
    return df.select(*[F.col(f"`{source}`").alias(alias) for alias, source in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Plain tuples from Arrow batches, one at a time."""
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def in_batches(schema, items: Iterator[tuple], size: int = 2000, max_chars: int = 8_000_000) -> Iterator:
    """Arrow batches from tuples; a batch is closed early once its strings, bytes and arrays add up to max_chars."""
    import numpy as np
    import pyarrow as pa

    held: list[tuple] = []
    chars = 0

    def flush():
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for item in items:
        held.append(item)
        chars += sum(len(x) for x in item if isinstance(x, str | bytes | np.ndarray))
        if len(held) >= size or chars >= max_chars:
            yield flush()
            held, chars = [], 0
    if held:
        yield flush()
