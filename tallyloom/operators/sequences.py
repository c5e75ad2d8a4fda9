"""Runs of steps, and sequences that come back on several days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_per_group

MIN_LENGTH, REPEAT_AT, WINDOW = 3, 3, 12


def collapse(df: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """Rows whose step differs from the one before, per key."""
    before = F.lag(step).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(step))).drop("__before")


def runs(df: DataFrame, keys: list[str], order: list[str], day: Column) -> DataFrame:
    """df with the number of its run: a run ends where the day changes, so a day that comes back starts another."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag("__day").over(w).eqNullSafe(F.col("__day")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__day", day).withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__day", "__new")


def sequence_support(df: DataFrame, keys: list[str], order: list[str], day: Column, step: str, min_length: int = MIN_LENGTH, window: int = WINDOW) -> DataFrame:
    """(keys, sequence, length, days): how many runs hold each contiguous sequence of min_length or more distinct steps.

    Only the last `window` steps of a run count, so a run yields at most window**2 / 2 sequences.
    """
    numbered = runs(df, keys, order, day)
    last = top_per_group(numbered.select(*keys, "run", *order, step), [*keys, "run"], [F.desc(o) for o in order], window)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rank"), F.col(step).alias("s")))), lambda x: x["s"])
    tail = last.groupBy(*keys, "run").agg(ordered.alias("steps"))
    n = F.size("steps")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - min_length + 1, F.lit(1))), lambda a: F.transform(F.sequence(F.lit(min_length), F.greatest(n - a + 1, F.lit(min_length))), lambda k: F.struct(a.alias("a"), k.alias("k")))))
    pieces = tail.where(n >= min_length).select(*keys, "run", F.explode(F.transform(spans, lambda x: F.slice("steps", x["a"], x["k"]))).alias("sequence"))
    distinct = pieces.where(F.size(F.array_distinct("sequence")) >= min_length).distinct()
    return distinct.groupBy(*keys, "sequence").agg(F.count("*").alias("days")).withColumn("length", F.size("sequence"))


def repeated_sequence(df: DataFrame, keys: list[str], order: list[str], day: Column, step: str, repeat_at: int = REPEAT_AT, min_length: int = MIN_LENGTH, window: int = WINDOW) -> DataFrame:
    """The longest sequence of each key that came round on enough days; then the most frequent, then the first by content."""
    support = sequence_support(df, keys, order, day, step, min_length, window).where(F.col("days") >= repeat_at)
    return top_per_group(support, keys, [F.desc("length"), F.desc("days"), F.col("sequence")], 1).drop("rank")
