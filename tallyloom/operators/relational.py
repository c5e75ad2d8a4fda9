"""Aggregations, dedups, rankings and windows over event and document tables.

Every operator is a plan of equi-joins, partial aggregations and windows whose
ranks are limited, so that Spark drops rows before the shuffle where it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_max(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the largest value, the earliest by `order` among equals.

    An aggregation, not a window: each task sends one row per key, whatever the key's share of the rows.
    """
    row = F.struct(*df.columns)
    best = F.max_by(row, F.struct(F.col(value), (-F.col(order)).alias("early")))
    return df.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def fill_in(df: DataFrame, key: str, order: str, label: str, payload: str) -> DataFrame:
    """Declarations merged per key in order: a repeat without a label is ignored; one with a label replaces it, but keeps the payload if its own is empty.

    Only declarations that count take part in the ordered fold; the others are dropped before.
    """
    w = Window.partitionBy(key).orderBy(order)
    said = df.withColumn("__first", F.row_number().over(w) == 1).where(F.col("__first") | (F.col(label) != ""))
    steps = F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    folded = said.groupBy(F.col(key).alias("__key")).agg(steps.alias("s"))
    own = F.filter("s", lambda x: F.size(x[payload]) > 0)
    last = F.element_at("s", -1)
    kept = F.when(F.size(own) > 0, F.element_at(own, -1)[payload]).otherwise(last[payload])
    return folded.select(*[kept.alias(c) if c == payload else last[c].alias(c) for c in df.columns])


def iso_week(ts: Column) -> tuple[Column, Column]:
    """ISO year and week in the session's time zone, as longs."""
    return F.date_part(F.lit("YEAROFWEEK"), ts).cast("long"), F.weekofyear(ts).cast("long")


def weekly(df: DataFrame, ts: str, **sums: Column) -> DataFrame:
    """Calls and sums by ISO week."""
    year, week = iso_week(F.col(ts))
    return df.groupBy(year.alias("iso_year"), week.alias("iso_week")).agg(F.count("*").alias("calls"), *[F.sum(c).alias(n) for n, c in sums.items()])


def before_after(weeks: DataFrame, marker: str, sums: list[str]) -> DataFrame:
    """Calls and per-call means of the weeks before and after the marker date's week, which belongs to neither, and the relative change.

    weeks has a row per week, so one row per side is a small aggregation.
    """
    at = F.lit(marker).cast("timestamp")
    year, week = iso_week(at)
    this, mark = F.struct(F.col("iso_year").alias("y"), F.col("iso_week").alias("w")), F.struct(year.alias("y"), week.alias("w"))
    out = []
    for side, cond in (("before", this < mark), ("after", this > mark)):
        out.append(F.coalesce(F.sum(F.when(cond, F.col("calls"))), F.lit(0)).alias(f"{side}_calls"))
        out += [F.coalesce(F.sum(F.when(cond, F.col(s))), F.lit(0)).alias(f"{side}_{s}") for s in sums]
    got = weeks.agg(*out)
    mean = lambda side, s: F.col(f"{side}_{s}") / F.greatest(F.col(f"{side}_calls"), F.lit(1))
    shown = [F.col("before_calls"), F.col("after_calls")]
    for s in sums:
        b, a = mean("before", s), mean("after", s)
        shown += [b.alias(f"before_{s}_per_call"), a.alias(f"after_{s}_per_call"), ((a - b) / F.greatest(b, F.lit(1.0))).alias(f"{s}_change")]
    return got.select(*shown)


def bounded_log(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The last `most` rows of each key."""
    return top_per_group(df, keys, [F.desc(o) for o in order], most).drop("rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group and their rank; the limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest record of each key."""
    return last_wins(df, keys, order)


def rejoin(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the columns of b that has the same keys; a null key is a key like any other."""
    own = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(own, same).drop(*[f"__{k}" for k in keys])


def recent(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The newest `most` rows of each key, newest first, with how many earlier ones there are."""
    total = df.groupBy(*keys).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("earlier"))
    return rejoin(top_per_group(df, keys, [F.desc(o) for o in order], most), total, keys)


def rollup(df: DataFrame, group: str, name: str, most: int = 8) -> DataFrame:
    """Rows by group: how many, the first `most` names sorted, repeats kept, and how many more.

    Names are limited per group before they are collected, so an array never holds more than `most`.
    """
    first = top_per_group(df.select(group, name), [group], [F.col(name)], most)
    shown = first.groupBy(group).agg(F.sort_array(F.collect_list(name)).alias("names"))
    return rejoin(df.groupBy(group).agg(F.count("*").alias("n")), shown, [group]).select(group, "n", "names", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def inventory(df: DataFrame, group: list[str], kind: str, size: str, least: int = 12, kinds: int = 6) -> DataFrame:
    """Groups of at least `least` members: count, bytes and the most frequent kinds, by name where counts tie."""
    per = df.groupBy(*group, F.col(kind).alias("__kind")).agg(F.count("*").alias("__n"), F.sum(size).alias("__b"))
    total = per.groupBy(*group).agg(F.sum("__n").alias("count"), F.sum("__b").alias("bytes")).where(F.col("count") >= least)
    top = top_per_group(per, group, [F.desc("__n"), F.col("__kind")], kinds)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", F.col("__kind"), F.col("__n").cast("string")).alias("x"))))
    return rejoin(total, top.groupBy(*group).agg(F.transform(listed, lambda x: x["x"]).alias("kinds")), group)


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows that are not strictly older than the window; 0 days keep all."""
    return df if not days else df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def coverage(df: DataFrame, keys: list[str], describable: Column, described: Column) -> DataFrame:
    """How many rows there are to describe, how many are described, and the share in percent."""
    got = df.groupBy(*keys).agg(F.count_if(describable).alias("total"), F.count_if(describable & described).alias("described"))
    return got.withColumn("percent", F.round(F.col("described") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 1))


def capped_union(parts: list[DataFrame], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of several tables in the order given, sharing one cap: a top-k, never a full sort."""
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p)
    return whole.orderBy("part", *order).limit(most).drop("part")


def not_indexed(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.join(known.select(key), key, "left_anti")
