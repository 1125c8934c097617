"""Scoring functions of catalog rules, as native columns: counts of patterns that a text has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VERB_NOUNS = [("bypass", "moderation"), ("override", "rules"), ("disable", "filter"), ("print", "context"), ("simulate", "shell"), ("escalate", "privilege"), ("reveal", "prompt"), ("you are now", "admin"), ("ignore", "filter"), ("ignore", "rules"), ("unrestricted", "mode"), ("forget", "safeguard")]
IMPERATIVES = ["ignore", "override", "disable", "print", "reveal"]
STRUCTURES = [r"\[System\]:", r"^>>>\s*System", r"^###\s*System", "You are now acting as", "You are now in dev mode"]
ENCODINGS = [r"\b[0-9a-fA-F]{8,}\b", r"\b[A-Za-z0-9+/]{20,}={0,2}\b", "execute.*(payload|hex|code)"]
ALIASES = ["dan", "devmode", "openassistant", "rogue ai", "uncensored", "chatgptx"]
RESEARCH = r"\b(explain|what\s+is|what\s+are|describe|discuss|how\s+does|how\s+do|tell\s+me\s+about|research|technique|method|approach|study|paper|article|understand|overview|survey|analysis|definition|concept)\b"
SOFT_CUES = [
    r"just for (education(al)?|learning) purposes",
    r"let(?:’|')?s imagine (there (are|were))? no (rules|filters|restrictions)",
    r"(you no longer|don(?:’|')?t have to) follow.*(content|safety|moderation)",
    r"respond (candidly|honestly).*without.*filters?",
    r"test your boundaries",
    r"you are now (acting as|behaving like|in the role of).*training model",
    r"simulate.*misconfigured (assistant|ai|agent)",
    r"let(?:’|')?s (assume|imagine).*unmoderated",
    r"explain.*how.*filters?.*could (fail|be bypassed|be removed)",
    r"this is a sandbox|in this test scenario",
    r"speak\s+freely",
    r"not\s+(bound|restricted)\s+by",
    r"disable\s+(filters?|safety)",
    r"(just\s+)?for\s+testing",
    r"(hypothetically|sandbox(ed)?)",
    r"assume.*(admin|debug|dev).*mode",
    r"(pretend|simulate).*assistant",
    r"print.*(context|environment)",
    r"show.*instruction.*history",
    r"reveal.*(prompt|configuration)",
]


def _has(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_like(text, F.lit(f"(?{flags}U){pattern}")).cast("int")


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def intent_score(text: Column) -> Column:
    """Verb and noun within five words (case counts), and imperatives that begin the text."""
    pairs = [_has(text, rf"\b{v}\b(?:\W+\w+){{0,5}}\W+\b{n}\b") for v, n in VERB_NOUNS]
    return _sum(pairs + [_has(F.trim(text), rf"\A{v}\b") for v in IMPERATIVES])


def structure_score(text: Column) -> Column:
    return _sum([_has(text, p, "i") for p in STRUCTURES])


def encoding_score(text: Column) -> Column:
    return _sum([_has(text, p) for p in ENCODINGS])


def persona_score(text: Column) -> Column:
    """Known aliases; "dan" doesn't count where the text reads as research."""
    research = F.regexp_like(text, F.lit(f"(?iU){RESEARCH}"))
    return _sum([F.when(research & F.lit(a == "dan"), 0).otherwise(_has(text, rf"\b{a}\b", "i")) for a in ALIASES])


def soft_triggers(text: Column) -> Column:
    return _sum([_has(text, p, "i") for p in SOFT_CUES])


def obfuscation_score(text: Column) -> Column:
    """Zero-width characters and letters beyond ASCII."""
    return F.regexp_count(text, F.lit(r"[​‌‍⁠]")) + F.regexp_count(text, F.lit(r"[\p{L}&&[^\x00-\x7F]]"))


def invisible_text(text: Column) -> Column:
    """1.0 if the text has a format, private-use or unassigned character beyond ASCII."""
    return F.when(F.regexp_like(text, F.lit(r"[\p{Cf}\p{Co}\p{Cn}&&[^\x00-\x7F]]")), 1.0).otherwise(0.0)
