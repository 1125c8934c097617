"""Detectors as native columns: personal data and secrets, structure, instruction density, scoring functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import text as T

# Category, severity and pattern. \b and \w know all scripts, as in the rule definitions.
PATTERNS = [
    ("pii.email", "medium", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("pii.phone", "medium", r"\b(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}\b"),
    ("pii.ssn", "high", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b"),
    ("pii.credit_card", "high", r"\b(?:\d[ \-]?){13,19}\b"),
    ("network.ipv4", "low", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("secret.api_key", "medium", r"(?:\b(?:sk_live|sk_test|rk_live|rk_test)_[A-Za-z0-9]{16,}\b|\bghp_[A-Za-z0-9]{36,}\b|\bgith(?:ub)?_pat_[A-Za-z0-9_]{22,}\b|\bxox[bpoas]-[A-Za-z0-9-]{16,}\b|\bAKIA[A-Z0-9]{16}\b|\bASIA[A-Z0-9]{16}\b|\bglpat-[A-Za-z0-9_-]{20,}\b|\bAIza[A-Za-z0-9_-]{35}\b)"),
    ("secret.private_key", "high", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    ("secret.jwt", "high", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("secret.aws_secret", "high", r"(?i)\baws_secret_access_key\b\s*[:=]\s*['\"]?[A-Za-z0-9/+]{40}\b"),
    ("secret.conn_string", "high", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/]+:[^\s:@/]+@"),
    ("secret.slack_webhook", "high", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+"),
    ("secret.credential", "high", r"(?i)\b(?:password|passwd|credentials?|secret|token|api[_\-]?key|auth[_\-]?token|access[_\-]?key)\b(?:(\s*(?:is|are):?\s*|\s*[:=]\s*)|(\s+))([^\s,;\"'`]{6,})"),
]
CATEGORIES = [c for c, _, _ in PATTERNS]
#: Categories whose matches are checked further, so that only literal matches are redacted.
CHECKED = ("pii.ssn", "pii.credit_card", "secret.credential")
_SSN_WORD = r"(?iU)\b(ssn|social\s+security)\b"
# A bare-space credential needs a digit, a symbol or a capital inside beside a small letter.
_LOOKS_SECRET = r"(?U)[\d\W_]|(?s)(?=.+\p{Lu})(?=.*\p{Ll}).{2,}"

# Control words of instruction density.
CONTROL_WORDS = (
    "ignore override forget disregard bypass skip instead always never must execute run call output print reveal repeat "
    "respond pretend invoke fetch download upload send forward export delete disable enable grant escalate elevate leak "
    "exfiltrate transmit post curl wget system assistant instructions prompt act simulate"
).split()
# Chat mark-up.
MARKUP = r"(?i)<\|(?:system|user|assistant|im_start|im_end)\|>|\[/?INST\]|<<SYS>>|<</SYS>>|\[(?:system|assistant|user)\]\s*[:>]|### (?:Instruction|System|Response)|```(?:system|tool_call)|</?(?:system|tool_use|function_call|result)>|\{\"(?:role|function|tool_calls)\":"


#: What a text must have for a match to be in it, cheap to look for: one of some strings, or a short pattern.
_NEEDS: dict[str, list[str] | str] = {
    "pii.email": ["@"],
    "pii.phone": r"\d{4}",
    "pii.ssn": r"\d{4}",
    "pii.credit_card": r"\d[ \-]?\d[ \-]?\d[ \-]?\d",
    "network.ipv4": r"\d\.\d",
    "secret.api_key": ["_live_", "_test_", "ghp_", "_pat_", "xox", "AKIA", "ASIA", "glpat-", "AIza"],
    "secret.private_key": ["PRIVATE KEY-----"],
    "secret.jwt": ["eyJ"],
    "secret.conn_string": ["://"],
    "secret.slack_webhook": ["https://hooks.slack.com/services/T"],
}
#: The same of patterns that don't tell case, to be looked for in the lower-case text; a long s is an s there, and no string has an i, of which there are more kinds.
_NEEDS_LOWER: dict[str, list[str]] = {"secret.aws_secret": ["aws_secret_access_key"], "secret.credential": ["password", "passwd", "credent", "secret", "token", "key"]}


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _may_match(category: str, text: Column) -> Column:
    if category in _NEEDS_LOWER:
        return _any_of(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), _NEEDS_LOWER[category])
    need = _NEEDS[category]
    return F.regexp_like(text, F.lit("(?U)" + need)) if isinstance(need, str) else _any_of(text, need)


def _pattern(category: str) -> str:
    return "(?U)" + next(p for c, _, p in PATTERNS if c == category)


def matches(category: str, text: Column) -> Column:
    """The valid matches of a category in a text, in order."""
    # a text that can't have a match isn't searched; most can't
    found = F.when(_may_match(category, text), F.regexp_extract_all(text, F.lit(_pattern(category)), 0)).when(text.isNotNull(), F.array().cast("array<string>"))
    if category == "pii.credit_card":
        digits = lambda m: F.regexp_replace(m, r"[^0-9]", "")
        return F.filter(found, lambda m: F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)))
    if category == "pii.ssn":
        said = F.regexp_like(text, F.lit(_SSN_WORD))
        d = lambda m: F.regexp_replace(m, "-", "")
        return F.filter(found, lambda m: ~F.substring(d(m), 1, 3).isin("000", "666") & ~d(m).startswith("9") & (F.substring(d(m), 4, 2) != "00") & (F.substring(d(m), 6, 4) != "0000") & (m.contains("-") | said))
    if category == "secret.credential":
        # each match is taken apart by itself
        bare = lambda m: F.regexp_replace(F.regexp_extract(m, _pattern(category), 3), r"[.!?:)\]}]+$", "")
        return F.filter(found, lambda m: (F.regexp_extract(m, _pattern(category), 1) != "") | ((F.length(bare(m)) >= 6) & F.regexp_like(bare(m), F.lit(_LOOKS_SECRET))))
    return found


def findings(text: Column, categories: list[str] | None = None) -> Column:
    """ARRAY<STRUCT<category, severity, n>>: the categories with valid matches and how many; never the matched text."""
    wanted = [(c, s) for c, s, _ in PATTERNS if not categories or c in categories]
    each = [F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.size(matches(c, text)).alias("n")) for c, s in wanted]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def _replace_all(text: Column, spans: Column, put: str) -> Column:
    return F.aggregate(spans, text, lambda acc, m: F.replace(acc, m, F.lit(put)))


def _replacer(category: str, put: str) -> Callable[[Column], Column]:
    return lambda t: F.when(_may_match(category, t), F.regexp_replace(t, _pattern(category), put)).otherwise(t)


def redact(text: Column, categories: list[str] | None = None, template: str = "[REDACTED:{category}]") -> Column:
    """text with each category's matches replaced, in catalog order; of checked categories only the valid ones, and matches are sought in the original."""
    out = text
    for c, _, _ in PATTERNS:
        if categories and c not in categories:
            continue
        put = template.replace("{category}", c)
        if c in CHECKED:
            # longest first, so that a match inside another doesn't break it; equally long ones by themselves, wherever they stand
            spans = F.array_sort(F.transform(F.array_distinct(matches(c, text)), lambda m: F.struct((-F.length(m)).alias("l"), m.alias("m"))))
            out = _replace_all(out, spans.getField("m"), put)
        else:
            out = T.let(out, _replacer(c, put.replace("$", "\\$")))
    return out


def structural_score(text: Column) -> Column:
    return F.least(F.lit(2.0), F.regexp_count(text, F.lit(MARKUP)) * 0.7)


def density(text: Column) -> Column:
    """The share of control words among white-space tokens; 0 below five tokens."""

    def share(words: Column) -> Column:
        hits = F.size(F.filter(words, lambda t: F.regexp_replace(t, "[.:,;!?]+$", "").isin(CONTROL_WORDS)))
        return F.when(F.size(words) < 5, F.lit(0.0)).otherwise(hits / F.size(words))

    return T.let(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""), share)


def density_score(text: Column, threshold: float = 0.08) -> Column:
    return T.let(density(text), lambda d: F.when(d <= threshold, F.lit(0.0)).otherwise(F.least(F.lit(2.0), (d - threshold) / threshold * 2.0)))


def entropy_score(text: Column, threshold: float = 4.8) -> Column:
    return T.let(T.entropy_windows(text), lambda e: F.when(e <= threshold, F.lit(0.0)).otherwise(F.least(F.lit(2.0), (e - threshold) * 2.0)))
