"""Scanners by name: built-in factories, further ones through entry points; a name that can't be resolved is skipped with a warning."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import catalog, commands, scan

log = logging.getLogger(__name__)

#: The entry-point group of further scanners; each names a factory, called with the reference's configuration.
GROUP = "palisade.scanners"
FINDING = ("scanner", "category", "severity", "method_family")

#: A scanner: (rows, id column, text) -> (id, scanner, category, severity, method_family).
Scanner = Callable[[DataFrame, str, Column], DataFrame]


def _finding(rows: DataFrame, id_col: str, scanner: str, family: str) -> DataFrame:
    return rows.select(id_col, F.lit(scanner).alias("scanner"), "category", "severity", F.lit(family).alias("method_family"))


def regex_pii(categories: list[str] | None = None) -> Scanner:
    return lambda docs, id_col, text: scan.pii_findings(docs, id_col, text, categories).select(id_col, *FINDING)


def catalog_scan(name: str) -> Callable[..., Scanner]:
    """A factory for the catalog of that name, with a user's own rules or whole YAML texts beside or instead of ours."""

    def make(extra_rules: list[dict[str, Any]] = (), texts: list[str] | None = None, normalize: bool = True) -> Scanner:
        from palisade.plans import rules

        made = catalog.load_catalog(name, rules.TEXTS[name] if texts is None else texts, list(extra_rules))
        return lambda docs, id_col, text: _finding(catalog.scan_texts(docs, id_col, text, [made], normalize), id_col, name, "catalog")

    return make


def heuristic_scan() -> Scanner:
    def run(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
        found = scan.heuristic_findings(docs, id_col, text).filter("severity IS NOT NULL AND score > 0")
        return _finding(found.withColumn("category", F.when(F.col("compound"), "typoglycemia_compound").otherwise("heuristic_anomaly")), id_col, "heuristic_scan", "structural")

    return run


def command_injection_scan(max_lines: int | None = None, max_chars: int | None = None) -> Scanner:
    return lambda docs, id_col, text: _finding(commands.command_findings(docs, id_col, text, max_lines, max_chars), id_col, "command_injection_scan", "structural")


FACTORIES: dict[str, Callable[..., Scanner]] = {
    "regex_pii": regex_pii,
    "injection_scan": catalog_scan("injection_scan"),
    "heuristic_scan": heuristic_scan,
    "mcp_metadata_scan": catalog_scan("mcp_metadata_scan"),
    "jailbreak_scan": catalog_scan("jailbreak_scan"),
    "identity_spoof_scan": catalog_scan("identity_spoof_scan"),
    "command_injection_scan": command_injection_scan,
    "document_scan": catalog_scan("document_scan"),
    "sql_injection_scan": catalog_scan("sql_injection_scan"),
}


@dataclass(frozen=True)
class Configured:
    name: str
    scan: Scanner
    action: str | None = None


def factory(name: str) -> Callable[..., Scanner] | None:
    """The built-in factory of a name, else that of the entry point with it, else None."""
    if name in FACTORIES:
        return FACTORIES[name]
    return next((e.load() for e in entry_points(group=GROUP) if e.name == name), None)


def build(refs: list[str | dict[str, Any]], always: str | None = "heuristic_scan") -> tuple[list[Configured], list[str]]:
    """(scanners, names that were skipped) of references: a name, or {name, config?, action?}.

    A reference that can't be resolved or made drops out with its own action and shifts no other's. The scanner always is
    appended if no reference has placed it.
    """
    out, skipped = [], []
    for ref in [{"name": r} if isinstance(r, str) else r for r in refs]:
        name = ref["name"]
        try:
            make = factory(name)
            if make is None:
                raise LookupError(f"no scanner {name}")
            out.append(Configured(name, make(**(ref.get("config") or {})), ref.get("action")))
        except Exception as e:  # noqa: BLE001 - one bad reference must not take the others with it
            log.warning("scanner %s is skipped: %r", name, e)
            skipped.append(name)
    if always and always not in {c.name for c in out}:
        out.append(Configured(always, FACTORIES[always]()))
    return out, skipped


def scan_all(docs: DataFrame, id_col: str, text: Column, scanners: list[Configured]) -> DataFrame:
    """Findings of all scanners, one below the other."""
    return reduce(DataFrame.unionByName, [c.scan(docs, id_col, text) for c in scanners])


def verdicts(docs: DataFrame, id_col: str, text: Column, scanners: list[Configured], block_at: str = "high", default: str = "block") -> DataFrame:
    """One verdict a row (see scan.fold_status), each scanner's findings under its own action."""
    actions = {c.name: c.action for c in scanners if c.action} or {"": default}
    return scan.fold_status(docs, scan_all(docs, id_col, text, scanners), id_col, actions, block_at, default)
