"""The token and redaction functions on single Python strings, for use inside Arrow functions."""

from __future__ import annotations

import re

from . import redact, text

# The same values as the Column expressions use, in Python's notation.
_CJK = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", r"\\u\1", text.CJK))
_DENSE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", r"\\u\1", text.DENSE))


def _python(pattern: str) -> re.Pattern:
    flags = pattern[2 : pattern.index(")")] if pattern.startswith("(?") and pattern[2] in "isU" else ""
    body = pattern[pattern.index(")") + 1 :] if flags else pattern
    return re.compile(body, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))


def _template(replacement: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", replacement)


_SECRETS = [(_python(p), _template(r)) for p, r in redact.PATTERNS]
_TAGS = [(_python(p), _template(r)) for p, r in text.DOC_TAGS]
_DECORATION = _python(text.DECORATION)


def estimate(s: str) -> float:
    cjk, dense = len(_CJK.findall(s)), len(_DENSE.findall(s))
    return cjk * text.CJK_WEIGHT + dense * text.DENSE_WEIGHT + (len(s) - cjk - dense) / text.OTHER_PER_TOKEN


def token_cut(s: str, budget: float) -> int:
    if budget <= 0:
        return 0
    total = 0.0
    for i, c in enumerate(s):
        total += text.CJK_WEIGHT if _CJK.match(c) else text.DENSE_WEIGHT if _DENSE.match(c) else 1.0 / text.OTHER_PER_TOKEN
        if total > budget:
            return i
    return len(s)


def scrub(s: str) -> str:
    for pattern, replacement in _SECRETS:
        s = pattern.sub(replacement, s)
    return s


def clip(s: str | None, limit: int = 110) -> str:
    s = _DECORATION.sub(" ", s or "")
    for pattern, replacement in _TAGS:
        s = pattern.sub(replacement, s)
    s = " ".join(s.split())
    return s[: limit - 1] + "…" if len(s) > limit else s
