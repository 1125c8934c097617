"""Catalog rules: named strings, match grammar, proximity, scoring; one Arrow pass runs every catalog over a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import islice
from re import _parser
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scores

#: Severity floors of the score: low, medium, high.
FLOORS = (0.0, 3.0, 6.0)
EVIDENCE_POINTS = 2.0
SEVERITIES = ("low", "medium", "high", "critical")
# Weight of a scoring function; 1 where none is given.
WEIGHTS = {"intent_score": 1.5, "structure_score": 1.0, "encoding_score": 1.0, "persona_score": 1.2, "cumulative_soft_triggers": 1.0, "obfuscation_score": 1.2, "invisible_text": 1.0}
LOCALES = ("fr", "es", "de", "zh")


class CatalogError(ValueError):
    """A catalog that can't be used as it is."""


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    category: str
    semantic: str
    groups: tuple[tuple[str, tuple[tuple[str, Any], ...]], ...]  # (name, ((kind, compiled), ...))
    all_of: bool
    within: int | None = None
    functions: tuple[str, ...] = ()


@dataclass
class Catalog:
    scanner: str
    rules: list[Rule] = field(default_factory=list)
    family: str = "catalog"
    #: Spans of one group that a proximity test looks at; None for all of them.
    max_spans: int | None = None


def needed_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case strings of which any lower-case text that the pattern matches has one, or None if there are none to name.

    Of what a pattern needs in a row, the alternatives whose shortest string is longest tell most.
    """

    def best(sets: list[frozenset[str]]) -> frozenset[str] | None:
        return max(sets, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    def of(items) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(arg)
                continue
            if run:
                found.append(frozenset([run.lower()]))
                run = ""
            inner = None
            if op is _parser.SUBPATTERN:
                inner = of(arg[-1])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and arg[0] > 0:
                inner = of(arg[2])
            elif op is _parser.BRANCH:
                each = [of(b) for b in arg[1]]
                inner = frozenset().union(*each) if all(each) else None
            if inner:
                found.append(inner)
        return best(found)

    return of(_parser.parse(pattern, re.MULTILINE))


@cache
def _may_match(pattern: str) -> Callable[[str], bool]:
    """Whether a text has what the pattern needs: substring tests, which most patterns fail at a fraction of a search's cost."""
    words = needed_literals(pattern)
    return (lambda text: any(w in text for w in words)) if words else (lambda text: True)


def _without_locale(name: str) -> str:
    head, _, last = name.rpartition(".")
    return head if last in LOCALES and head else name


def match_group(group: Any) -> tuple[str, list[str]]:
    """(name, ids) of a group: an id, a list of ids, or {name, any: [ids]}."""
    if isinstance(group, str):
        return group, [group]
    if isinstance(group, dict):
        return group.get("name") or "|".join(group["any"]), list(group["any"])
    return "|".join(group), list(group)


def raw_rules(text: str) -> list[dict[str, Any]]:
    """The rules of a YAML text: a list, or a mapping with the list under patterns or rules."""
    got = yaml.safe_load(text) or []
    return got if isinstance(got, list) else got.get("patterns") or got.get("rules") or []


def compile_rule(raw: dict[str, Any]) -> Rule:
    """A rule of the form {name, meta: {severity, category, semantic_id?}, strings: {id: regex or {hex: ...}}, match, functions?}.

    match: "any", or {all: [[ids that may stand for each other], ...], within_chars?}. A group may also be written
    {name, any: [ids]}, and a match without proximity {any: [ids]}.
    """
    try:
        meta, strings, match = raw["meta"], raw["strings"], raw.get("match", "any")
        if meta["severity"] not in SEVERITIES:
            raise CatalogError(f"{raw['name']}: severity {meta['severity']}")
        made = {k: ("hex", v["hex"].lower().replace(" ", "")) if isinstance(v, dict) else ("regex", re.compile(v, re.MULTILINE)) for k, v in strings.items()}
        unknown = set(match) - {"all", "any", "within_chars"} if isinstance(match, dict) else ()
        if unknown:
            raise CatalogError(f"{raw['name']}: unknown match key {sorted(unknown)[0]}")
        if match == "any" or "all" not in match:
            groups, all_of, within = [(k, (made[k],)) for k in (made if match == "any" else match["any"])], False, None
        else:
            groups = [(name, tuple(made[i] for i in ids)) for name, ids in map(match_group, match["all"])]
            all_of, within = True, match.get("within_chars")
        return Rule(raw["name"], meta["severity"], meta["category"], meta.get("semantic_id") or _without_locale(raw["name"]), tuple(groups), all_of, within, tuple(raw.get("functions") or ()))
    except (KeyError, TypeError, re.error) as e:
        raise CatalogError(f"{raw.get('name', '?')}: {e!r}") from e


def load_catalog(scanner: str, texts: list[str], extra: list[dict[str, Any]] = ()) -> Catalog:
    """A catalog of YAML texts (rules each, see raw_rules; the primary first, then translations; a user's own files as well) and extra rules, of which a bad one costs only itself."""
    rules = [compile_rule(r) for t in texts for r in raw_rules(t)]
    for r in extra:
        try:
            rules.append(compile_rule(r))
        except CatalogError:
            continue
    return Catalog(scanner, rules)


def fit_within(groups: list[list[tuple[int, int]]], width: int) -> bool:
    """Whether some window of width contains a span of every group whole.

    Spans sorted by their ends enter a window's right edge; for each group the rightmost start so far is best, so one pass
    with one value for each group decides.
    """
    if not groups:
        return True
    start: list[int | None] = [None] * len(groups)
    for end, begin, g in sorted((e, s, g) for g, spans in enumerate(groups) for s, e in spans):
        if start[g] is None or begin > start[g]:
            start[g] = begin
        if None not in start and end - min(start) <= width:
            return True
    return False


def _spans(rule: Rule, group: tuple[tuple[str, Any], ...], text: str, hexed: Callable[[], str], max_spans: int | None) -> list[tuple[int, int]] | None:
    """Spans of the first alternative that matches (only one is needed without proximity), or None."""
    for kind, p in group:
        if kind == "hex":
            at = hexed().find(p)
            if at >= 0:
                return [(at // 2, at // 2 + len(p) // 2)]
            continue
        if not _may_match(p.pattern)(text):
            continue
        found = p.finditer(text)
        first = next(found, None)
        if first is not None:
            if rule.within is None:
                return [first.span()]
            return [first.span(), *(m.span() for m in islice(found, None if max_spans is None else max_spans - 1))]
    return None


def _groups_hit(catalog: Catalog, rule: Rule, text: str, hexed: Callable[[], str]) -> list[tuple[str, list[tuple[int, int]]]]:
    """(group, spans) of the rule's groups that match; none at once if one is missing of a rule that needs all."""
    out = []
    for name, group in rule.groups:
        spans = _spans(rule, group, text, hexed, catalog.max_spans)
        if spans is not None:
            out.append((name, spans))
        elif rule.all_of:
            return []
    return out


_FUNCTIONS: dict[str, Callable[[str], float]] = {}


def _python_functions() -> dict[str, Callable[[str], float]]:
    """The scoring functions for use inside the Arrow pass; the native ones in scores.py say the same."""
    if not _FUNCTIONS:
        has = lambda p, t, f=0: bool(re.search(p, t, f))
        pairs = [re.compile(rf"\b{v}\b(?:\W+\w+){{0,5}}\W+\b{n}\b") for v, n in scores.VERB_NOUNS]
        _FUNCTIONS.update(
            intent_score=lambda t: sum(bool(p.search(t)) for p in pairs) + sum(has(rf"\A{v}\b", t.strip()) for v in scores.IMPERATIVES),
            structure_score=lambda t: sum(has(p, t, re.I) for p in scores.STRUCTURES),
            encoding_score=lambda t: sum(has(p, t) for p in scores.ENCODINGS),
            persona_score=lambda t: sum(has(rf"\b{a}\b", t, re.I) and not (a == "dan" and has(scores.RESEARCH, t, re.I)) for a in scores.ALIASES),
            cumulative_soft_triggers=lambda t: sum(has(p, t, re.I) for p in scores.SOFT_CUES),
            obfuscation_score=lambda t: sum(c in "\u200b\u200c\u200d\u2060" or (not c.isascii() and unicodedata.category(c)[0] == "L") for c in t),
            invisible_text=lambda t: float(any(ord(c) > 127 and unicodedata.category(c) in ("Cf", "Co", "Cn") for c in t)),
        )
    return _FUNCTIONS


def scan(catalog: Catalog, text: str | None) -> list[dict[str, Any]]:
    """Findings of a catalog in a text, one for each category: severity, rule, and the parts of the score."""
    if not text or not text.strip():
        return []
    flat = " ".join(unicodedata.normalize("NFKC", text).lower().split())
    cache: list[str] = []

    def hexed() -> str:
        if not cache:
            cache.append(text.encode("utf-8", "ignore").hex())
        return cache[0]

    evidence: set[tuple[str, str]] = set()
    called: set[tuple[str, str]] = set()
    fired: dict[str, str] = {}
    points, worst = 0.0, 0
    for rule in catalog.rules:
        hit = _groups_hit(catalog, rule, flat, hexed)
        if not hit or (rule.within is not None and not fit_within([s for _, s in hit], rule.within)):
            continue
        evidence |= {(rule.semantic, name) for name, _ in hit}
        fired.setdefault(rule.category, rule.name)
        worst = max(worst, SEVERITIES.index(rule.severity))
        for f in rule.functions:
            if (rule.semantic, f) not in called and f in _python_functions():
                called.add((rule.semantic, f))
                points += WEIGHTS.get(f, 1.0) * _python_functions()[f](text)
    if not fired:
        return []
    total = EVIDENCE_POINTS * len(evidence) + points + len(fired)
    severity = "critical" if worst == 3 else "high" if worst == 2 or total >= FLOORS[2] else "medium" if total >= FLOORS[1] else "low"
    return [{"scanner": catalog.scanner, "category": c, "severity": severity, "rule": r, "score": total} for c, r in fired.items()]


FINDINGS = "array<struct<scanner:string,category:string,severity:string,rule:string,score:double,view_pos:int>>"


def catalog_findings(views: Column, catalogs: list[Catalog]) -> Column:
    """Findings of all catalogs over all views (ARRAY<STRING>) of a row, in one pass; view_pos is the view's place."""

    @F.pandas_udf(FINDINGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda vs: [f | {"view_pos": i} for i, v in enumerate(vs if vs is not None else ()) for c in catalogs for f in scan(c, v)])

    return run(views)


def text_findings(text: Column, catalogs: list[Catalog], max_bytes: int | None = None) -> Column:
    """Findings of all catalogs over all de-obfuscated views of a text, of each scanner, category and severity the first view's.

    One pass does it all: the views never leave Python.
    """
    from palisade.functions.views import views

    def found(t: str | None) -> list[dict[str, Any]]:
        first: dict[tuple[str, str, str], dict[str, Any]] = {}
        for i, v in enumerate(views(t, max_bytes=max_bytes)[0]):
            for c in catalogs:
                for f in scan(c, v):
                    first.setdefault((f["scanner"], f["category"], f["severity"]), f | {"view_pos": i})
        return list(first.values())

    @F.pandas_udf(FINDINGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(found)

    return run(text)


def scan_texts(docs: DataFrame, id_col: str, text: Column, catalogs: list[Catalog], normalize: bool = True) -> DataFrame:
    """(id, scanner, category, severity, rule, score, view_pos), the first view for each scanner, category and severity."""
    from palisade.operators.scan import merge_views

    found = text_findings(text, catalogs) if normalize else catalog_findings(F.array(text), catalogs)
    return merge_views(docs.select(id_col, F.explode(found).alias("f")).select(id_col, "f.*"), id_col)


def rule_rows(spark, catalogs: list[Catalog]) -> DataFrame:
    """The rules as a table for listing."""
    rows = [(c.scanner, r.name, r.category, r.severity, "all" if r.all_of else "any", r.within, sum(len(g) for _, g in r.groups)) for c in catalogs for r in c.rules]
    return spark.createDataFrame(rows, "scanner string, rule string, category string, severity string, match string, within_chars int, n_strings int")


_WIDE = re.compile(r"\\b\w{1,4}\\b|\w{1,4}")


def lint(raw: list[dict[str, Any]]) -> list[tuple[str, str]]:
    """(rule, problem) of raw rules: doubled names, missing meta, bad severity or regex, unknown match keys, strings that no group uses or that don't exist, single short words."""
    out, seen = [], set()
    for r in raw:
        name = r.get("name") or "?"
        say = lambda what, name=name: out.append((name, what))
        if name in seen:
            say("name is used twice")
        seen.add(name)
        meta, strings, match = r.get("meta") or {}, r.get("strings") or {}, r.get("match", "any")
        for k in ("severity", "category"):
            if not meta.get(k):
                say(f"meta has no {k}")
        if meta.get("severity") not in (None, *SEVERITIES):
            say("unknown severity")
        for k, v in strings.items():
            if isinstance(v, str):
                try:
                    re.compile(v)
                except re.error:
                    say(f"{k} is no regex")
                if _WIDE.fullmatch(v):
                    say(f"{k} is too broad")
        if not strings:
            say("no strings")
        if isinstance(match, dict):
            for k in set(match) - {"all", "any", "within_chars"}:
                say(f"unknown match key {k}")
            used = {i for g in [*(match.get("all") or ()), *(match.get("any") or ())] for i in match_group(g)[1]}
            out.extend((name, f"{k} is not used") for k in strings if k not in used)
            out.extend((name, f"{k} does not exist") for k in sorted(used - set(strings)))
        elif match != "any":
            say("unknown match")
        for f in r.get("functions") or ():
            if f not in _python_functions():
                say(f"unknown function {f}")
    return out


