"""Credential redaction and file predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "<REDACTED>"
WS, NOT_WS = r"[\s\x1c-\x1f]", r"\s\x1c-\x1f"

# Token shapes, key blocks, credentialed URLs and secret assignments, in the order they are applied.
SECRET_NAME = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[\w-]*"
PATTERNS = (
    (r"(?U)\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{16,}", PLACEHOLDER),
    (r"(?U)\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{16,}", PLACEHOLDER),
    (r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}", PLACEHOLDER),
    (r"(?U)\bAKIA[0-9A-Z]{16}\b", PLACEHOLDER),
    (r"(?U)\bAIza[0-9A-Za-z_-]{30,}", PLACEHOLDER),
    (r"(?U)\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}", PLACEHOLDER),
    (r"(?U)\bglpat-[A-Za-z0-9_-]{16,}", PLACEHOLDER),
    (r"(?U)\bnpm_[A-Za-z0-9]{30,}", PLACEHOLDER),
    (r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", PLACEHOLDER),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", PLACEHOLDER),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", PLACEHOLDER),
    (rf"(?U)\b([a-zA-Z][a-zA-Z0-9+.-]*://[^{NOT_WS}:/@]+):([^{NOT_WS}@/]{{3,}})@", f"$1:{PLACEHOLDER}@"),
    (rf"(?iU)({SECRET_NAME}{WS}*[:=]{WS}*)(['\"])([^'\"]{{6,}})\2", f"$1$2{PLACEHOLDER}$2"),
    (rf"(?iU)({SECRET_NAME}{WS}*[:=]{WS}*)([^{NOT_WS}'\"#;,)\]}}]{{6,}})", f"$1{PLACEHOLDER}"),
)

#: For each pattern, in the same order, strings of which a text has to have one for the pattern to match anywhere.
HINTS = (
    ("sk-",),
    ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    ("xox",),
    ("AKIA",),
    ("AIza",),
    ("_live_", "_test_"),
    ("glpat-",),
    ("npm_",),
    ("eyJ",),
    ("-----BEGIN ",),
    ("-----BEGIN ",),
    ("://",),
    (),
    (),
)
#: The same for the assignments of SECRET_NAME, in lower case.
NAME_HINTS = ("passw", "pwd", "secret", "token", "api", "access", "private", "auth", "credential")

# Names and endings of files that hold credentials or databases.
BLOCKED_SUFFIXES = (".pem", ".key", ".pfx", ".p12", ".crt", ".cer", ".der", ".jks", ".keystore", ".db", ".sqlite", ".sqlite3", ".mdb", ".bak", ".dump")
BLOCKED_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".htpasswd", ".netrc", "credentials", "secrets.yml", "secrets.yaml")
NEVER_OPENED_SUFFIXES = (".pem", ".key", ".pfx", ".p12", ".crt", ".cer", ".der", ".jks", ".keystore", ".asc", ".gpg")


def _any_of(col: Column, needles: tuple[str, ...]) -> Column:
    found = F.contains(col, F.lit(needles[0]))
    for n in needles[1:]:
        found = found | F.contains(col, F.lit(n))
    return found


def _named_secret(col: Column) -> Column:
    """Whether a text may assign to a secret's name. Letters that only equal others when case is ignored (ſ, ı, İ) are taken for those."""
    low = F.translate(F.lower(col), "\u017f\u0131\u0307", "si")
    return _any_of(col, ("=", ":")) & _any_of(low, NAME_HINTS)


def scrub(col: Column) -> Column:
    """The text with credentials replaced; null and empty texts pass.

    A pattern is tried on texts only that have one of its hints, which is a plain
    search; each step's text is bound to a variable, so that it is computed once.
    """
    for (pattern, replacement), hints in zip(PATTERNS, HINTS, strict=True):
        col = F.get(F.transform(F.array(col), _step(pattern, replacement, hints)), F.lit(0))
    return col


def _step(pattern: str, replacement: str, hints: tuple[str, ...]) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        may = _any_of(x, hints) if hints else _named_secret(x)
        return F.when(may, F.regexp_replace(x, F.lit(pattern), F.lit(replacement))).otherwise(x)

    return step


def _basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/]*$", 0))


def _named(name: Column, suffixes: tuple[str, ...], prefixes: tuple[str, ...]) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = name.isin(*BLOCKED_NAMES) | stem.isin(*BLOCKED_NAMES)
    for s in suffixes:
        out = out | F.endswith(name, F.lit(s))
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def is_blocked(path: Column) -> Column:
    """Files that are never indexed."""
    return _named(_basename(path), BLOCKED_SUFFIXES, ("id_rsa", "id_ed25519"))


def is_never_opened(path: Column) -> Column:
    """Files that are never even summarised: databases may be, keys may not."""
    return _named(_basename(path), NEVER_OPENED_SUFFIXES, ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"))
