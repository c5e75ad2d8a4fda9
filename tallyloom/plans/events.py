"""What is said before and after single tool events: each comes as one JSON payload and is answered with text, or with nothing.

`tool_events` reads many payloads as a table, for the stream detectors; the
handlers below answer one at a time, with a workspace's logs as their state.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.notices import bulk_read
from ..sources.workspace import Workspace
from ..streaming import watch

PAYLOAD = "tool_name string, tool_input struct<command:string, file_path:string, content:string, new_string:string, offset:long, limit:long>"
KEPT_COMMANDS, KEPT_SCRIPTS = watch.KEPT_STEPS, watch.KEPT_SCRIPTS


def payload(stream: IO[str]) -> dict | None:
    """One event; null if it is no JSON object, which is answered with silence."""
    try:
        found = json.load(stream)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def tool_events(lines: DataFrame) -> DataFrame:
    """(the columns of lines but value, tool, command, path, content, ranged) of payloads in lines(value, ...); malformed ones are left out."""
    r = F.from_json("value", PAYLOAD)
    kept = [c for c in lines.columns if c != "value"]
    given = lambda c: F.coalesce(F.col(f"r.tool_input.{c}"), F.lit(0)) != 0
    return lines.select(*kept, r.alias("r")).where("r.tool_name IS NOT NULL").select(
        *kept,
        F.col("r.tool_name").alias("tool"),
        F.col("r.tool_input.command").alias("command"),
        F.col("r.tool_input.file_path").alias("path"),
        F.coalesce("r.tool_input.content", "r.tool_input.new_string").alias("content"),
        (given("offset") | given("limit")).alias("ranged"),
    )


def read_notices(events: DataFrame, size: str = "size") -> DataFrame:
    """The reads among tool events (with the size of the file each reads) that deserve a notice, with its reason, estimate and sentence."""
    found = bulk_read(events.where("tool = 'Read'"), "path", size, F.col("ranged"))
    name, tokens = F.regexp_extract("path", "[^/]*$", 0), F.format_number(F.bround("estimate", 0), 0)
    by_name = F.concat(F.lit("`"), name, F.lit("` is a "), F.col("notice"), F.lit(" file (~"), tokens, F.lit(" tokens): search it for the one fact that is wanted, unless the file itself is being debugged."))
    by_size = F.concat(F.lit("`"), name, F.lit("` is "), F.col("notice"), F.lit(" (~"), tokens, F.lit(" tokens), which stay in the session: a search or a range of lines costs a fraction."))
    return found.withColumn("sentence", F.when(F.col("notice").isin("large", "very large"), by_size).otherwise(F.replace(by_name, F.lit("file file"), F.lit("file"))))


def envelope(event: str, said: str) -> str:
    """Text as the context that a host adds for an event; nothing stays nothing."""
    return json.dumps({"hookSpecificOutput": {"hookEventName": event, "additionalContext": said}}, ensure_ascii=False) if said else ""


def _one(spark: SparkSession, event: dict) -> DataFrame:
    return tool_events(spark.createDataFrame([(json.dumps(event),)], "value string"))


def before_read(spark: SparkSession, ws: Workspace, event: dict) -> str:
    """Advice, never a refusal, before a large or machine-written file is read whole."""
    wanted = event.get("tool_input") or {}
    path = Path(str(wanted.get("file_path") or ""))
    if event.get("tool_name") != "Read" or not ws.enabled("warn_on_bulk_reads") or not path.is_file():
        return ""
    found = read_notices(_one(spark, event).withColumn("size", F.lit(path.stat().st_size).cast("long"))).first()
    return envelope("PreToolUse", found["sentence"] if found else "")


def after_tool(spark: SparkSession, ws: Workspace, event: dict, now: str) -> str:
    """Speaks when a sequence of commands has come round on a third day, or else a near-identical script for the third time."""
    if not ws.enabled("promote"):
        return ""
    rows = _one(spark, event).select("tool", "command", "path", "content", text.command_signatures(F.when(F.col("tool") == "Bash", F.col("command"))).alias("steps")).collect()
    if not rows:
        return ""
    r = rows[0]
    if r["steps"]:
        before = watch.repeated([(e["at"], e["sig"]) for e in ws.append_log("commands.jsonl", [], KEPT_COMMANDS)])
        found = watch.repeated([(e["at"], e["sig"]) for e in ws.append_log("commands.jsonl", ({"at": now, "sig": s} for s in r["steps"]), KEPT_COMMANDS)])
        if found and (before is None or before[0] != found[0]):
            return f"{' -> '.join(found[0])} has come round in {found[1]} sessions: worth recording as a procedure."
    script = watch.script_of(r["tool"], r["command"], r["path"], r["content"])
    own = watch.fingerprint(script)
    if len(own) < watch.MIN_TOKENS:
        return ""
    earlier = ws.append_log("scratch.jsonl", [], KEPT_SCRIPTS)
    alike = [e for e in earlier if watch.jaccard_sets(own, frozenset(e.get("fp", ()))) >= watch.SIMILAR]
    head = spark.range(1).select(text.headline(F.lit(script))).first()[0]
    ws.append_log("scratch.jsonl", [{"at": now, "fp": sorted(own)[: watch.STORED_TOKENS], "head": head}], KEPT_SCRIPTS)
    if len(alike) + 1 != watch.REPEAT_AT:
        return ""
    return f"This is script number {watch.REPEAT_AT} of nearly the same content since {alike[0]['at'][:10]}: `promote FILE NAME --desc TEXT` would keep it."


def at_session_end(spark: SparkSession, ws: Workspace, now: str) -> str:
    """The digest of the scripts that the last day wrote again and again."""
    from .session import session_digest

    log = ws.folder / "logs" / "scratch.jsonl"
    return session_digest(spark, str(log), now) if ws.enabled("promote") and log.is_file() else ""
