"""Commands over one repository: index, peek, promote, tools, report, session, event.

    python -m tallyloom index [DIR ...] [--out FILE] [--measure] [--preview]
    python -m tallyloom peek FILE [--find PATTERN] [--budget TOKENS]
    python -m tallyloom promote FILE NAME [--desc TEXT]
    python -m tallyloom tools
    python -m tallyloom report FOLDER [--marker YYYY-MM-DD]
    python -m tallyloom session [--json]
    python -m tallyloom event before-read|after-tool|session-end < PAYLOAD
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from .sources.workspace import Workspace, find_root


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    command = parser.add_subparsers(dest="command", required=True)
    index = command.add_parser("index")
    index.add_argument("folders", nargs="*")
    index.add_argument("--out")
    index.add_argument("--measure", action="store_true")
    index.add_argument("--preview", action="store_true", help="print what a session is told, and build nothing")
    peek = command.add_parser("peek")
    peek.add_argument("file")
    peek.add_argument("--find")
    peek.add_argument("--budget", type=float, default=400)
    promote = command.add_parser("promote")
    promote.add_argument("file")
    promote.add_argument("name")
    promote.add_argument("--desc", default="", nargs="+")
    command.add_parser("tools")
    report = command.add_parser("report")
    report.add_argument("folder")
    report.add_argument("--marker")
    command.add_parser("session").add_argument("--json", action="store_true", help="as the context that a host adds")
    command.add_parser("event").add_argument("when", choices=("before-read", "after-tool", "session-end"))
    a = parser.parse_args(argv)
    ws = Workspace(find_root())

    if a.command == "peek":
        from .sources.peek import peek as summary

        print(summary(a.file, Path(a.file).read_bytes(), a.find, a.budget))
        return 0
    if a.command == "promote":
        try:
            print(ws.install_tool(a.file, a.name, " ".join(a.desc)))
        except OSError as error:
            print(error, file=sys.stderr)
            return 1
        return 0
    if a.command == "tools":
        for t in ws.tools():
            print(f"{t['name']:<24} {t.get('desc') or '(no description)'}  added {t.get('added', '?')[:10]}, run {t.get('runs', 0)}x")
        return 0

    part = {"index": "map", "report": "report"}.get(a.command)
    if part and not ws.enabled(part):
        print(f"{part} is switched off in {ws.folder.name}/config.json")
        return 0
    from pyspark.sql import SparkSession

    from .plans import session

    spark = SparkSession.builder.appName("tallyloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "index" and not a.preview:
        print(session.index_report(spark, ws, a.folders, a.out, a.measure))
    elif a.command == "report":
        print(session.usage_report(spark, a.folder, a.marker))
    elif a.command == "event":
        if said := _answer(spark, ws, a.when):
            print(said)
    else:
        _session(spark, ws, a)
    return 0


def _answer(spark, ws: Workspace, when: str) -> str:
    """What is said to the event on standard input; nothing to one that can't be read."""
    from .plans import events

    event, now = events.payload(sys.stdin), datetime.now().astimezone().isoformat(timespec="seconds")
    if when == "session-end":
        return events.at_session_end(spark, ws, now)
    if event is None:
        return ""
    return events.before_read(spark, ws, event) if when == "before-read" else events.after_tool(spark, ws, event, now)


def _session(spark, ws: Workspace, a: argparse.Namespace) -> None:
    from .functions.plain import estimate
    from .plans import events, session

    block = session.session_block(spark, ws)
    if a.command == "index":
        print(f"{block.strip()}\n\n---\n[{estimate(block):,.0f} tokens: what every session here is told]" if block.strip() else "nothing to tell yet: build the index first")
    else:
        print(events.envelope("SessionStart", block) if a.json else block)


if __name__ == "__main__":
    sys.exit(main())
