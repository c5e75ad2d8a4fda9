"""Documents that persist between sessions: records, memory entries and milestones, as tables (name, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact, text
from .relational import latest, recent, top_per_group

CARRIED, MAX_CARRIED, MAX_RULES, MAX_TITLES, RECENT = ("Remaining", "Blockers"), 1200, 1500, 8, 2
HEADING = r"(?md)(?=^##[ \t]+\S)"


def sections(body: Column) -> Column:
    """(heading, body) of each second-level section, in order; text before the first one is left out."""
    parts = F.filter(F.split(body, HEADING), lambda p: p.rlike(r"(?d)^##[ \t]+\S"))
    head = lambda p: F.regexp_extract(p, r"(?d)^##[ \t]+(.+?)[ \t]*(?:\n|$)", 1)
    rest = lambda p: text_trim(F.regexp_replace(p, r"(?d)^[^\n]*\n?", ""))
    return F.transform(parts, lambda p: F.struct(head(p).alias("heading"), rest(p).alias("body")))


def text_trim(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def section(found: Column, heading: str) -> Column:
    """The body of the last section of that name; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda s: s["heading"] == heading), F.lit(-1))["body"], F.lit(""))


def cut_at_line(col: Column, most: int, note: Column) -> Column:
    """At most `most` code points, cut back to the end of a line, followed by a note."""
    return F.when(F.char_length(col) > most, F.concat(F.regexp_replace(F.left(col, F.lit(most)), r"\n[^\n]*\z", ""), note)).otherwise(col)


def carried(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, carried): what the newest record of each key leaves open, redacted; no row if nothing is."""
    newest = latest(records, keys, "name").withColumn("s", sections(F.col("text")))
    part = lambda h: F.when((section(F.col("s"), h) != "") & ~text.is_nothing(section(F.col("s"), h)), F.concat(F.lit(f"**{h}**\n"), section(F.col("s"), h)))
    body = F.concat_ws("\n\n", *[part(h) for h in CARRIED])
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    date = F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1)
    head = F.concat(F.lit("_Last session ("), F.when(date != "", date).otherwise(stem), F.lit(") — "), text.title_of(F.col("text"), stem), F.lit("_"))
    note = F.concat(F.lit("\n\n_…truncated — read `"), F.col("name"), F.lit("` for the rest._"))
    return newest.where(body != "").select(*keys, "name", redact.scrub(F.concat(head, F.lit("\n\n"), cut_at_line(body, MAX_CARRIED, note))).alias("carried"))


def rules(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules): the rules of each key in the order of their names, capped and redacted.

    Entries that start beyond the cap are dropped before they are collected.
    """
    w = Window.partitionBy(*keys).orderBy("name")
    flat = entries.where("category = 'rules'").withColumn("flat", text_trim(text.flatten_headings(F.col("text")))).where("flat <> ''")
    placed = flat.withColumn("before", F.coalesce(F.sum(F.char_length("flat") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = flat.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = placed.where(F.col("before") <= MAX_RULES).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "flat"))), lambda x: x["flat"]), "\n\n").alias("all"))
    note = F.concat(F.lit("\n\n_…more rules — "), F.col("n").cast("string"), F.lit(" in total._"))
    return joined.join(total, keys).select(*keys, redact.scrub(cut_at_line(F.col("all"), MAX_RULES, note)).alias("rules"))


def titles(entries: DataFrame, keys: list[str], most: int = MAX_TITLES) -> DataFrame:
    """(keys, category, title, name, rank): decisions before lessons, by name, sharing one cap; redacted."""
    stem = F.replace(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))
    found = entries.where("category IN ('decisions', 'lessons')").withColumn("title", redact.scrub(text.title_of(F.col("text"), stem)))
    return top_per_group(found, keys, [F.col("category"), F.col("name")], most).select(*keys, "category", "title", "name", "rank")


def category_counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decisions, lessons, rules): how many entries of each category, none included."""
    return entries.groupBy(*keys).agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("decisions", "lessons", "rules")])


def milestones(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, date, title, body) of the dated sections of one document per key, in the order written."""
    shaped = r"^(\d{4}-\d{2}-\d{2})\s*[—-]\s*(.+?)\s*$"
    each = docs.select(*keys, F.posexplode(F.filter(sections(F.col("text")), lambda s: s["heading"].rlike(shaped))).alias("ord", "s"))
    return each.select(*keys, "ord", F.regexp_extract("s.heading", shaped, 1).alias("date"), F.regexp_extract("s.heading", shaped, 2).alias("title"), F.col("s.body").alias("body"))


def recent_milestones(found: DataFrame, keys: list[str], most: int = RECENT) -> DataFrame:
    """The newest `most` milestones of each key, newest first, and how many earlier ones there are."""
    return recent(found, keys, ["ord"], most)
