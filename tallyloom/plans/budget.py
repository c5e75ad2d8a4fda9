"""Keeping a rendered document within a token budget: plain text in, plain text out."""

from __future__ import annotations

from collections import defaultdict

from ..functions.plain import estimate, token_cut

SHOWN = 8
ROW = "- **`"


def rolled_up(index: str, origin: str, budget: float | None = None) -> str:
    """An index with its file rows folded to one line per top folder; the rest stays as it is.

    If that is still over the budget, it is cut at the end of a line and says so.
    """
    rows = [x for x in index.splitlines() if x.startswith(ROW)]
    groups: dict[str, list[str]] = defaultdict(list)
    for row in rows:
        folder, slash, rest = row.removeprefix(ROW).partition("`")[0].partition("/")
        groups[folder if slash else "(root)"].append((rest if slash else folder).rpartition("/")[2])
    out = [x for x in index.splitlines() if not x.startswith(ROW)]
    out += [f"_{len(rows)} files. Rolled up by directory to stay inside the session budget — read `{origin}` for any one of them in full._", ""]
    for folder in sorted(groups):
        names = sorted(groups[folder])
        more = f" _+{len(names) - SHOWN} more_" if len(names) > SHOWN else ""
        out.append(f"- **{folder}/** ({len(names)}) — " + ", ".join(f"`{n}`" for n in names[:SHOWN]) + more)
    return within("\n".join(out), origin, budget) if budget else "\n".join(out)


def within(text: str, origin: str, budget: float) -> str:
    if estimate(text) <= budget:
        return text
    note = f"\n\n_Cut to fit the session budget. Read `{origin}` for anything missing here._"
    kept = text[: token_cut(text, budget - estimate(note))]
    return (kept.rpartition("\n")[0] if "\n" in kept else kept) + note
