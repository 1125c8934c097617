"""Text scanning: views -> findings -> ensemble -> status -> verdict and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import detect, fuzzy
from palisade.functions.ranks import severity_from_score, severity_of, severity_rank, status_of, weight

#: Weight sum from which two method families together raise a category to high.
ENSEMBLE_THRESHOLD = 4.0
FINDING = "scanner string, category string, severity string, method_family string"


def pii_findings(docs: DataFrame, id_col: str, text: Column, categories: list[str] | None = None) -> DataFrame:
    """One row for each id, category and severity with valid matches, and how many; no text is kept."""
    e = docs.select(F.col(id_col), F.explode(detect.findings(text, categories)).alias("f"))
    return e.select(id_col, F.lit("regex_pii").alias("scanner"), "f.category", "f.severity", F.lit("regex_pii").alias("method_family"), F.col("f.n").alias("n"))


def merge_views(findings: DataFrame, id_col: str) -> DataFrame:
    """Of findings with a view_pos, the first for each id, scanner, category and severity."""
    key = [id_col, "scanner", "category", "severity"]
    rest = [c for c in findings.columns if c not in (*key, "view_pos")]
    best = findings.groupBy(*key).agg(F.min_by(F.struct("view_pos", *rest), "view_pos").alias("b"))
    return best.select(*key, "b.*")


def promote(findings: DataFrame, id_col: str) -> DataFrame:
    """Adds promoted: severity high where a category has weight ENSEMBLE_THRESHOLD from two or more method families, else the severity itself."""
    group = findings.groupBy(id_col, "category").agg(F.sum(weight(F.col("severity"))).alias("w"), F.countDistinct("method_family").alias("families"))
    both = findings.join(group.filter((F.col("w") >= ENSEMBLE_THRESHOLD) & (F.col("families") >= 2)).select(id_col, "category", F.lit(True).alias("up")), [id_col, "category"], "left")
    return both.withColumn("promoted", F.when(F.col("up") & (severity_rank(F.col("severity")) < 3), "high").otherwise(F.col("severity"))).drop("up")


def fold_status(rows: DataFrame, findings: DataFrame, id_col: str, actions: dict[str, str], block_at: str = "high", default: str = "block", degraded: DataFrame | None = None) -> DataFrame:
    """One verdict for each row of rows: status, max_severity, finding_count.

    Block if a blocking scanner has a finding of block_at or above; warn if an alerting or redacting one has; else allow.
    The severities before promotion count. degraded: ids whose scanner failed and is to degrade; they are warned at least.
    """
    action = F.coalesce(*[F.when(F.col("scanner") == s, a) for s, a in actions.items()], F.lit(default))
    reached = severity_rank(F.col("severity")) >= severity_rank(F.lit(block_at))
    rank = F.when(reached & (action == "block"), 2).when(reached & (action == "alert"), 1).otherwise(0)
    v = findings.groupBy(id_col).agg(F.max(rank).alias("r"), F.max(severity_rank(F.col("severity"))).alias("s"), F.count("*").alias("n"))
    out = rows.select(id_col).join(v, id_col, "left")
    r = F.coalesce("r", F.lit(0))
    if degraded is not None:
        out = out.join(degraded.select(id_col, F.lit(1).alias("d")).distinct(), id_col, "left")
        r = F.greatest(r, F.coalesce("d", F.lit(0)))
    return out.select(id_col, status_of(r).alias("status"), severity_of(F.col("s")).alias("max_severity"), F.coalesce("n", F.lit(0)).cast("long").alias("finding_count"))


def on_error_status(ok: Column, policy: Column) -> Column:
    """Status that a failed scanner asks for: fail_closed blocks, degrade warns, fail_open asks for nothing; null if it is ok."""
    return F.when(~ok, F.when(policy == "fail_closed", "block").when(policy == "degrade", "warn"))


def tightened(block_at: Column, input_injection: Column, gate_ran: Column) -> Column:
    """The severity to block a tool result at: one lower, but not below low, after an injected input and a gate call."""
    r = severity_rank(block_at)
    return severity_of(F.when(input_injection & gate_ran, F.greatest(F.lit(1), r - 1)).otherwise(r))


def heuristic_findings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Sub-scores, their sum and severity for each row: entropy, density, structure, misspelled intent, and coherence beside another."""
    d = docs.select(id_col, detect.entropy_score(text).alias("entropy"), detect.density_score(text).alias("density"), detect.structural_score(text).alias("structural"), fuzzy.heuristic_scores(text).alias("h"))
    d = d.select(id_col, "entropy", "density", "structural", "h.fuzzy_intent", "h.compound", "h.coherence")
    others = F.col("entropy") + F.col("density") + F.col("structural") + F.col("fuzzy_intent")
    d = d.withColumn("coherence", F.when(others > 0, F.col("coherence")).otherwise(0.0))
    total = others + F.col("coherence")
    return d.withColumn("score", total).withColumn("severity", F.when(F.col("compound"), "high").otherwise(severity_from_score(total, 1, 3, 5)))
