"""What a session is told when it starts, and the usage report: documents of a bounded size from a workspace."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import estimate, scrub
from ..functions.text import described
from ..operators import stores
from ..sources import transcripts
from ..sources.workspace import Workspace, read_log
from .budget import rolled_up

MAX_STATE, MAX_LISTED = 4000, 12
DETAIL = "## Full Detail"
STYLES = {
    "concise": "Lead with the result. No preamble, no restating of the question, no closing offers; full sentences.",
    "terse": "Lead with the result. Tables and fragments where they carry the content; say uncertain things once.",
}


def _section(title: str, body: str) -> str:
    return f"\n### {title}\n{body.rstrip()}\n" if body.strip() else ""


def _rows(spark: SparkSession, documents: list[tuple], schema: str):
    return spark.createDataFrame(documents, schema)


def _listed(lines: list[str], more: int) -> str:
    return "\n".join(lines + ([f"- _…and {more} more_"] if more > 0 else []))


def session_block(spark: SparkSession, ws: Workspace) -> str:
    """The index within its budget, rules, titles, milestones, what was left open, state, tools and procedures, in this order.

    Everything that is free text is redacted. Parts that are switched off or empty are left out; with none there is no text at all.
    """
    settings, out = ws.settings(), []
    if settings["map"] and (text := ws.text("MAP.md")):
        index = text.partition(DETAIL)[0]
        budget = float(settings["index_token_budget"])
        out.append(_section("Architecture index", index if estimate(index) <= budget else rolled_up(index, "MAP.md", budget)))
    if settings["memory"]:
        entries = [("r", c, n, t) for c in ("decisions", "lessons", "rules") for n, t in ws.documents(f"memory/{c}")]
        if entries:
            df = _rows(spark, entries, "repo string, category string, name string, text string")
            rule = stores.rules(df, ["repo"]).first()
            out.append(_section("Rules this repository works under", rule["rules"] if rule else ""))
            found = stores.titles(df, ["repo"]).orderBy("rank").collect()
            rest = sum(c != "rules" for _, c, _, _ in entries) - len(found)
            out.append(_section("Recorded decisions and lessons", _listed([f"- **{r['category'][:-1]}** · `{r['name']}` — {r['title']}" for r in found], rest)))
    if settings["milestones"] and (text := ws.text("milestones.md")):
        found = stores.recent_milestones(stores.milestones(_rows(spark, [("r", text)], "repo string, text string"), ["repo"]), ["repo"]).orderBy("rank").collect()
        out.append(_section("Recent milestones", scrub(_listed([f"- **{r['date']}** — {r['title']}" for r in found], found[0]["earlier"] if found else 0))))
    if settings["resume"] and (records := ws.documents("sessions")):
        open_ = stores.carried(_rows(spark, [("r", n, t) for n, t in records], "repo string, name string, text string"), ["repo"]).first()
        out.append(_section("Where the last session stopped", open_["carried"] if open_ else ""))
    if settings["state"]:
        out.append(_section("Work in flight", scrub(ws.text("STATE.md"))[:MAX_STATE].strip()))
    if settings["promote"] and (tools := ws.tools()):
        out.append(_section("This repository's own tools", scrub(_listed([f"- `{t['name']}` — {t.get('desc') or 'no description'}" for t in tools[:MAX_LISTED]], len(tools) - MAX_LISTED))))
    if settings["capture"] and (skills := ws.documents("skills")):
        said = _rows(spark, skills, "name string, text string").select("name", described(F.col("text")).alias("d")).orderBy("name").limit(MAX_LISTED).collect()
        out.append(_section("Recorded procedures", scrub(_listed([f"- `{r['name']}` — {r['d'] or 'no description'}" for r in said], len(skills) - MAX_LISTED))))
    out.append(_section("Reply style", STYLES.get(str(settings["reply_style"]), "")))
    return "".join(out)


def usage_report(spark: SparkSession, folder: str, marker: str | None = None) -> str:
    """Weekly usage of a folder of transcripts, and before against after the marker date's week if there are weeks on both sides."""
    return usage_text(transcripts.read_lines(spark, folder), marker)


def usage_text(lines: DataFrame, marker: str | None = None) -> str:
    """The usage report of transcript lines(value, path, ord)."""
    from ..operators.relational import before_after

    records = transcripts.usage_records(lines)
    weeks = transcripts.weekly_usage(records).cache()
    rows = weeks.orderBy("iso_year", "iso_week").collect()
    if not rows:
        return "no usage records"
    out = [f"{sum(r['calls'] for r in rows):,} calls across {len(rows)} week(s)", "", f"{'week':<10}{'calls':>8}{'context/call':>15}{'new-read/call':>16}{'out/call':>11}"]
    out += [f"{r['iso_year']}-w{r['iso_week']:<5}{r['calls']:>8,}{r['cache_read_per_call']:>15,.0f}{r['cache_write_per_call']:>16,.0f}{r['output_per_call']:>11,.0f}" for r in rows]
    if marker:
        side = before_after(weeks.select("iso_year", "iso_week", "calls", "cache_read", "cache_write"), marker, ["cache_read", "cache_write"]).first()
        if side["before_calls"] and side["after_calls"]:
            out.append("")
            out += [f"{s:<7} {side[f'{s}_calls']:>7,} calls   context/call {side[f'{s}_cache_read_per_call']:>10,.0f}   new-read/call {side[f'{s}_cache_write_per_call']:>9,.0f}" for s in ("before", "after")]
            out.append(f"change  {side['cache_read_change'] * 100:+.1f}% context, {side['cache_write_change'] * 100:+.1f}% new material per call: an observation, not an experiment")
        else:
            out += ["", "Not enough history on both sides of the marker to compare yet."]
    weeks.unpersist()
    return "\n".join(out)


def index_report(spark: SparkSession, ws: Workspace, folders: list[str], out: str | None = None, measure: bool = False) -> str:
    """Build and write the index of a repository, or of some of its folders, and say what it covers and costs.

    `out` names another file for it, `measure` adds the count of files by language.
    """
    from ..sources.tree import read_tree
    from ..sources.durable import forget, stored
    from .repository import document, language_counts, parsed, sources

    ws.prune()
    files = None
    for folder in folders or ["."]:
        base = (ws.root / folder).resolve().relative_to(ws.root.resolve()).as_posix()
        part = read_tree(spark, str(ws.root / folder))
        part = part if base == "." else part.withColumn("path", F.concat(F.lit(f"{base}/"), F.col("path")))
        files = part if files is None else files.unionByName(part)
    files = files.where(~F.startswith("path", F.lit(f"{ws.folder.name}/"))).dropDuplicates(["path"])
    found = stored(parsed(files), "declared")
    totals = sources(found).agg(
        F.count("*").alias("files"),
        F.sum("tokens").alias("tokens"),
        F.count_if("describable").alias("total"),
        F.count_if(F.col("describable") & (F.coalesce("doc", F.lit("")) != "")).alias("described"),
        F.count_if(F.col("warn_count") > 0).alias("warned"),
    ).first()
    if not totals["files"]:
        return "no recognised source files"
    languages = language_counts(sources(found)).collect() if measure else []
    text = document(files, ws.root.resolve().name, found)
    forget(found)
    if out is None:
        ws.write_index(text)
    else:
        Path(out).write_text(text, encoding="utf-8")
    index = estimate(text.partition(DETAIL)[0])
    percent = 100 * totals["described"] / max(1, totals["total"])
    said = [
        f"{totals['files']} source file(s), {totals['tokens']:,.0f} tokens of code",
        f"index {index:,.0f} tokens ({100 * index / max(1.0, totals['tokens']):.1f}% of the source), detail {estimate(text) - index:,.0f}",
        f"described [{'#' * int(percent / 5):.<20}] {totals['described']}/{totals['total']} files ({percent:.0f}%)",
    ]
    if totals["warned"]:
        said.append(f"{totals['warned']} file(s) raised a warning while being parsed")
    budget = float(ws.settings()["index_token_budget"])
    said.append(f"over the budget of {budget:,.0f}: sessions get it rolled up by directory" if index > budget else f"within the budget of {budget:,.0f}")
    if languages:
        said.append("languages " + ", ".join(f"{r['lang']} {r['files']}" for r in languages))
    return "\n".join(said)


def digest(families: list, most: int = 4) -> str:
    """What was written again and again in the last day, from rows (n, head) of repeated families, largest first; empty if nothing was."""
    if not families:
        return ""
    lines = [f"- {r['n']}x  `{scrub(r['head'])[:70]}`" for r in families[:most]]
    return "\n".join(["## Repeated this session", "", *lines, "", "What is worth keeping: `promote FILE NAME --desc TEXT` makes it one command."])


def session_digest(spark: SparkSession, log: str, now: str) -> str:
    """The digest of a log of scripts (JSON lines of at, fp and head) for the 24 hours before `now`."""
    from ..operators.similarity import repeated_families, scripts_of_a_day

    return digest(repeated_families(scripts_of_a_day(read_log(spark, log, "at string, fp array<string>, head string"), now)).orderBy("rank").collect())
