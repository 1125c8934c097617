"""Ordered enumerations as rank columns. Severity and status strings are never compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in rising order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
STATUSES = ["allow", "warn", "block"]

# Weight of a severity in the ensemble.
ENSEMBLE_WEIGHTS = {"info": 0.0, "low": 1.0, "medium": 3.0, "high": 6.0, "critical": 10.0}


def rank(value: Column, order: list[str]) -> Column:
    """Place of value in order, from 0; null for anything else."""
    p = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(p > 0, (p - 1).cast("int"))


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def status_rank(value: Column) -> Column:
    return rank(value, STATUSES)


def severity_of(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), r)


def status_of(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), r)


def weight(severity: Column) -> Column:
    """Ensemble weight; 1 for an unknown severity."""
    return F.coalesce(F.get(F.array(*[F.lit(ENSEMBLE_WEIGHTS[s]) for s in SEVERITIES]), severity_rank(severity)), F.lit(1.0))


def severity_from_score(score: Column, low: float, medium: float, high: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low")
