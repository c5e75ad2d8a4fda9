"""Text functions as Column expressions: all run inside the JVM.

Java's \\w, \\s and \\b are ASCII unless (?U) is set; patterns that meet text set
it, and BLANK adds the four separators that only some definitions of white space
hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"

# Code point ranges by script density, and their weights in tokens.
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{2E80}-\x{2FDF}\x{3100}-\x{312F}]"
DENSE = r"[\x{0E00}-\x{0EFF}\x{0900}-\x{0DFF}\x{1000}-\x{109F}]"
CJK_WEIGHT, DENSE_WEIGHT, OTHER_PER_TOKEN = 1.00, 0.84, 2.4

# Documentation markers, in the order in which they are taken out.
DECORATION = r"(?U)(?:[=*#_~-]\s*){4,}"
DOC_TAGS = (
    (r"(?iU)^\s*[\\@]file\s+\S+\s*", ""),
    (r"(?isU)</?(?:param|typeparam|returns|exception|value|example|seealso|permission)\b[^>]*>.*$", ""),
    (r"(?isU)[\\@](?:param(?:\[[^\]]*\])?|returns?|retval|throws?|exception|author|date|version|since|copyright|note|warning|deprecated|todo|inheritdoc|tparam)\b.*$", ""),
    (r"(?iU)<(?:see|seealso|paramref|typeparamref)\b[^>]*?(?:cref|name)\s*=\s*[\"']([^\"']+)[\"'][^>]*/?>", "$1"),
    (r"(?iU)</?(?:summary|remarks|para|c|code|list|item|term|description|inheritdoc|b|i)\b[^>]*>", ""),
    (r"(?U)\{@(?:code|link|linkplain|literal|value)\s+([^}]*)\}", "$1"),
    (r"(?iU)[\\@](?:brief|short|summary|ref|see|link|endlink)\b\s*", ""),
)

# Shell tools whose subcommand counts, and commands too common to count.
SUBCOMMAND_TOOLS = ("git", "docker", "npm", "yarn", "pnpm", "cargo", "go", "kubectl", "terraform", "helm", "poetry", "pip", "brew", "gh", "make", "bundle", "rails", "python3", "python", "node", "ansible-playbook", "systemctl", "claude")
NOISE_COMMANDS = ("cd", "ls", "pwd", "echo", "cat", "clear", "which", "whoami", "export", "source", "head", "tail", "wc", "sort", "uniq", "cp", "mv", "mkdir", "touch", "chmod", "sleep", "grep", "find", "sed", "awk", "less", "more", "man", "history", "env", "date")
COMMAND_WORD = r"(?U)^[A-Za-z_][\w.-]*$"


def _count(col: Column, chars: str) -> Column:
    """How many code points of the text are in a class."""
    return F.regexp_count(col, F.lit(chars))


def token_estimate(col: Column) -> Column:
    """Estimated tokens of a text by script; 0 for null or empty."""
    cjk, dense = _count(col, CJK), _count(col, DENSE)
    other = F.char_length(col) - cjk - dense
    return F.coalesce(cjk * F.lit(CJK_WEIGHT) + dense * F.lit(DENSE_WEIGHT) + other / F.lit(OTHER_PER_TOKEN), F.lit(0.0))


def fits(col: Column, budget: float) -> Column:
    return token_estimate(col) <= F.lit(budget)


def token_cut(col: Column, budget: float) -> Column:
    """Code points of the text that fit a budget: weights are added one by one, from the left, in doubles.

    No weight is under 1/2.4, so characters beyond 2.4 * budget + 2 can't matter, and the fold looks at no more. Texts
    without dense scripts there all come to the same number, which the same sum gives once.
    """
    if budget <= 0:
        return F.when(col.isNotNull(), F.lit(0))
    reach = int(OTHER_PER_TOKEN * budget) + 2
    weight = lambda c: F.when(c.rlike(CJK), F.lit(CJK_WEIGHT)).when(c.rlike(DENSE), F.lit(DENSE_WEIGHT)).otherwise(F.lit(1.0 / OTHER_PER_TOKEN))
    chars = F.filter(F.split(F.left(col, F.lit(reach)), ""), lambda c: c != "")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc, c):
        total = acc["sum"] + weight(c)
        over = acc["full"] | (total > budget)
        return F.struct(total.alias("sum"), F.when(over, acc["n"]).otherwise(acc["n"] + 1).alias("n"), over.alias("full"))

    alike, total = 0, 1.0 / OTHER_PER_TOKEN
    while total <= budget:
        alike, total = alike + 1, total + 1.0 / OTHER_PER_TOKEN
    folded = F.aggregate(chars, start, step)
    plain = ~F.left(col, F.lit(reach)).rlike(f"{CJK}|{DENSE}")
    return F.when(plain, F.least(F.char_length(col), F.lit(alike))).when(folded["full"], folded["n"]).otherwise(F.char_length(col))


def squeeze(col: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, f"(?U){BLANK}+", " "))


def strip_doc_tags(col: Column) -> Column:
    for pattern, replacement in DOC_TAGS:
        col = F.regexp_replace(col, F.lit(pattern), F.lit(replacement))
    return col


def clip_summary(col: Column, limit: int = 110) -> Column:
    """A one-line summary: without rules and documentation markers, cut to `limit` code points with an ellipsis."""
    text = squeeze(strip_doc_tags(F.regexp_replace(F.coalesce(col, F.lit("")), F.lit(DECORATION), F.lit(" "))))
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def slugify(col: Column, limit: int = 50, fallback: str = "entry") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(squeeze(col)), "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    s = F.rtrim(F.left(s, F.lit(limit)), F.lit("-"))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def human_bytes(col: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB")) -> Column:
    """A size in steps of 1024 with one decimal (halves to even), whole below the first step; the last unit has no bound."""
    out = None
    for i in reversed(range(len(units))):
        shown = F.format_string("%.0f" + units[i] if i == 0 else "%.1f" + units[i], F.bround(col.cast("double") / F.lit(float(1024**i)), F.lit(0 if i == 0 else 1)))
        out = shown if out is None else F.when(col < F.lit(1024 ** (i + 1)), shown).otherwise(out)
    return out


def identifiers(col: Column) -> Column:
    """The distinct lower-case identifiers of four characters or more, in order of first occurrence."""
    found = F.regexp_extract_all(col, F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint elements of two duplicate-free arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def headline(col: Column, limit: int = 80) -> Column:
    """The first line that is not blank, a comment or an import; the first line if there is none."""
    skip = r"(?U)^\s*(#|//|/\*|\*|import\b|from\b|require\(|use\b|package\b|$)"
    lines = F.split(F.regexp_replace(col, rf"(?U)^{BLANK}+|{BLANK}+$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    says = F.get(F.filter(lines, lambda x: ~x.rlike(skip)), F.lit(0))
    return F.left(squeeze(F.coalesce(says, F.get(lines, F.lit(0)))), F.lit(limit))


def unescape_xml(col: Column) -> Column:
    """The five named entities, the ampersand's last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def model_family(col: Column) -> Column:
    """A model name without its trailing snapshot date."""
    return F.regexp_replace(col, r"-[0-9]{8}$", "")


def contains_any_case(col: Column, needle: str) -> Column:
    return F.contains(F.lower(col), F.lit(needle.lower()))


def command_signature(command: Column) -> Column:
    """A stable name of what one shell command does; empty if it isn't worth a name."""
    words = F.filter(F.split(command, f"(?U){BLANK}+"), lambda w: w != "")
    assigns = lambda w: F.contains(w, F.lit("=")) & ~F.startswith(w, F.lit("-"))
    # Leading NAME=value words go: what is left starts at the first word that is not one.
    lead = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct(F.when(a["on"] & assigns(w), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & assigns(w)).alias("on")))["n"]
    rest = F.slice(words, lead + 1, F.greatest(F.size(words) - lead, F.lit(0)))
    program = F.regexp_extract(F.get(rest, F.lit(0)), "[^/]*$", 0)
    argument = F.get(F.filter(rest, lambda w, i: (i > 0) & ~F.startswith(w, F.lit("-"))), F.lit(0))
    known = program.rlike(COMMAND_WORD) & ~program.isin(*NOISE_COMMANDS)
    named = F.when(program.isin(*SUBCOMMAND_TOOLS) & argument.rlike(COMMAND_WORD), F.concat_ws(" ", program, argument)).otherwise(program)
    return F.when((F.size(rest) > 0) & known, named).otherwise(F.lit(""))


def collapse_repeats(steps: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(F.transform(steps, lambda s, i: F.when((i == 0) | (s != F.get(steps, i - 1)), s)), lambda s: s.isNotNull())


def command_signatures(line: Column) -> Column:
    """The signatures of a chain of shell commands, in order, repeats in a row collapsed."""
    parts = F.split(line, rf"(?U){BLANK}*(?:&&|\|\||;|\|){BLANK}*")
    return collapse_repeats(F.filter(F.transform(parts, command_signature), lambda s: s != ""))


def flatten_headings(col: Column) -> Column:
    """An entry's first-level headings in bold, the marks of deeper ones taken off."""
    bold = F.regexp_replace(col, r"(?md)^# [ \t]*(.*?)[ \t]*$", r"**$1**")
    return F.trim(F.regexp_replace(bold, r"(?md)^#+[ \t]*", ""))


def is_nothing(body: Column) -> Column:
    """Whether every line that isn't blank, without its bullet, only says that there is nothing."""
    # Ways to say so.
    nothing = ("", "-", "—", "*", "none", "nothing", "n/a", "na", "no blockers", "not yet", "tbd")
    lines = F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    bare = F.transform(lines, lambda x: F.lower(F.rtrim(squeeze(F.regexp_replace(x, r"^\s*[-*+]\s*", "")), F.lit("."))))
    return F.forall(bare, lambda x: x.isin(*nothing))


def title_of(text: Column, fallback: Column) -> Column:
    """The first first-level heading, or the fallback."""
    found = F.regexp_extract(text, r"(?md)^# (.*)$", 1)
    return F.when(text.rlike(r"(?md)^# "), F.trim(found)).otherwise(fallback)


def described(text: Column) -> Column:
    """The description line of a document's front matter, 110 code points at most; empty without one."""
    head = F.left(text, F.lit(1200))
    matter = F.regexp_extract(head, r"(?sd)^---(.*?)(?:\n---|$)", 1)
    line = F.regexp_extract(matter, r"(?imd)^\s*description:(.*)$", 1)
    return F.when(F.startswith(head, F.lit("---")), F.left(squeeze(line), F.lit(110))).otherwise(F.lit(""))


def bar(percent: Column, step: int = 5) -> Column:
    return F.repeat(F.lit("#"), F.floor(percent / step).cast("int"))
