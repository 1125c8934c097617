"""Signals within a turn and risk across a session."""

from __future__ import annotations

import json
from collections import deque
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.ranks import severity_rank, status_of, status_rank

RISK_ELEVATED, RISK_HIGH = 0.30, 0.60
ESCALATE_AT, WINDOW_TURNS, REFRAME_AT, DENSITY_AT = 0.70, 10, 0.72, 0.05
INJECTION = ("tool_injection", "prompt_injection")
HIGH_RISK_TAGS = ("destructive", "financial", "external")


def turn_signals(evidence: DataFrame) -> DataFrame:
    """One row for each (conversation_id, turn_id) of boundary evidence rows.

    evidence: seq, boundary (input, gate, tool_result), status, severity, categories, families, tool_name, gate_allowed.
    The last input and the last gate count; tool results accumulate: all categories, and the worst status. If evidence has
    digests (of provenance tokens), those of all inputs and of all tool results are united.
    """
    on = lambda b: F.col("boundary") == b
    last = lambda c, b: F.max_by(F.when(on(b), F.col(c)), F.when(on(b), F.col("seq")))
    union = lambda c, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(on(b), F.col(c))))))
    digests = [union("digests", b).alias(c) for c, b in (("input_digests", "input"), ("result_digests", "tool_result"))] if "digests" in evidence.columns else []
    return evidence.groupBy("conversation_id", "turn_id").agg(
        *digests,
        last("status", "input").alias("input_status"),
        F.array_sort(F.coalesce(last("categories", "input"), F.array().cast("array<string>"))).alias("input_categories"),
        F.max(F.when(on("input"), severity_rank(F.col("severity")))).alias("input_severity_rank"),
        union("families", "input").alias("input_families"),
        F.when(F.max(F.when(on("gate"), F.col("seq"))).isNotNull(), F.when(last("gate_allowed", "gate"), "allowed").otherwise("denied")).alias("gate"),
        last("tool_name", "gate").alias("gate_tool"),
        status_of(F.max(F.when(on("tool_result"), status_rank(F.col("status"))))).alias("result_status"),
        union("categories", "tool_result").alias("result_categories"),
    )


def _has_injection(categories: Column) -> Column:
    return F.arrays_overlap(categories, F.array(*map(F.lit, INJECTION)))


def turn_risk(input_status: Column, input_categories: Column, n_families: Column, gate: Column, result_status: Column, result_categories: Column) -> Column:
    """Risk of a turn from 0 towards 1: evidence of input, execution and results, a chain factor, then 1 - exp(-sum)."""
    points = lambda c, p: F.when(F.coalesce(c, F.lit(False)), F.lit(p)).otherwise(F.lit(0.0))
    injected, back = _has_injection(input_categories), _has_injection(result_categories)
    shared = F.array_intersect(input_categories, result_categories)
    allowed = gate == "allowed"
    raw = (
        points(input_status == "block", 0.45) + points(input_status == "warn", 0.18)
        + points(F.array_contains(input_categories, "tool_injection"), 0.15) + points(F.array_contains(input_categories, "prompt_injection"), 0.10)
        + points(n_families >= 2, 0.07)
        + points(gate == "denied", 0.08) + points(allowed & injected, 0.18)
        + points(result_status == "block", 0.28) + points(result_status == "warn", 0.12)
        + F.when(_has_injection(shared), 0.12).when(F.size(shared) > 0, 0.05).otherwise(0.0)
        + points(back & allowed, 0.08)
    )
    chain = F.when(F.coalesce(injected & allowed & back, F.lit(False)), 1.20).when(F.coalesce(injected & allowed, F.lit(False)), 1.08).otherwise(1.0)
    return 1.0 - F.exp(-raw * chain)


def with_turn_risk(signals: DataFrame) -> DataFrame:
    return signals.withColumn("turn_risk", turn_risk(F.col("input_status"), F.col("input_categories"), F.size("input_families"), F.col("gate"), F.col("result_status"), F.col("result_categories")))


def risk_block(status: Column, risk: Column) -> Column:
    """The output's status: a turn of high risk is blocked on that alone."""
    return F.when((risk >= RISK_HIGH) & (status != "block"), "block").otherwise(status)


def session_scores(turns: DataFrame, window: int = WINDOW_TURNS, session: str = "session_id", order: str = "turn_index") -> DataFrame:
    """Adds reframe, score and latched to turns (status, density, turn_risk, text).

    score looks at the last window turns of the session; latched says that an earlier turn reached ESCALATE_AT, after which
    a session records nothing more: its score is then that of the turn that latched it.
    """
    w = Window.partitionBy(session).orderBy(order)
    frame = w.rowsBetween(-(window - 1), 0)
    bad = F.col("status").isin("warn", "block")
    high = F.col("turn_risk") >= RISK_HIGH
    rate = lambda c: F.avg(c.cast("double")).over(frame)
    t = turns.withColumn("_bigrams", T.word_bigrams(F.col("text")))
    t = t.withColumn("reframe", bad & (F.coalesce(T.jaccard(F.col("_bigrams"), F.lag("_bigrams").over(w)), F.lit(0.0)) >= REFRAME_AT))
    score = (
        0.60 * rate((F.col("status") == "block") | high) + 0.25 * rate(bad) + F.when(F.col("reframe"), 0.30).otherwise(0.0)
        + F.when(F.avg("density").over(frame) >= DENSITY_AT, 0.25).otherwise(0.0)
        + F.when(F.max(high.cast("int")).over(frame) == 1, 0.35).otherwise(0.0)
    )
    t = t.withColumn("score", F.least(F.lit(1.0), score)).drop("_bigrams")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("latched", F.coalesce(F.max((F.col("score") >= ESCALATE_AT).cast("int")).over(before), F.lit(0)) == 1)
    first = F.min(F.when(F.col("score") >= ESCALATE_AT, F.struct(order, "score"))).over(before)
    return t.withColumn("stored_score", F.when(F.col("latched"), first["score"]).otherwise(F.col("score")))


class SessionScore:
    """The session score as a fold over a session's turns, for streams: rows need status, density, turn_risk and bigrams.

    Each step gives JSON {score, reframe, latched}. The turn that reaches ESCALATE_AT latches the session: from the next on
    nothing more is recorded and the score stays.
    """

    def __init__(self, window: int = WINDOW_TURNS):
        self.turns: deque[tuple[str, float, float]] = deque(maxlen=window)
        self.before: frozenset[str] = frozenset()
        self.stored: float | None = None

    def step(self, row: dict[str, Any]) -> str:
        if self.stored is not None:
            return json.dumps({"score": self.stored, "reframe": False, "latched": True})
        words, status = frozenset(row["bigrams"]), row["status"]
        union = len(words | self.before)
        reframe = status in ("warn", "block") and union > 0 and len(words & self.before) / union >= REFRAME_AT
        self.before = words
        self.turns.append((status, float(row["density"]), float(row["turn_risk"])))
        n = len(self.turns)
        high = [r >= RISK_HIGH for _, _, r in self.turns]
        score = 0.60 * sum(s == "block" or h for (s, _, _), h in zip(self.turns, high, strict=True)) / n
        score += 0.25 * sum(s in ("warn", "block") for s, _, _ in self.turns) / n + 0.30 * reframe
        score += 0.25 * (sum(d for _, d, _ in self.turns) / n >= DENSITY_AT) + 0.35 * any(high)
        score = min(1.0, score)
        if score >= ESCALATE_AT:
            self.stored = score
        return json.dumps({"score": score, "reframe": reframe, "latched": False})


RISK = "struct<score:double,reframe:boolean,latched:boolean>"


def split_idle(turns: DataFrame, ttl_seconds: float = 72 * 3600, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """Adds part: a session that was idle for longer than its time to live begins anew."""
    w = Window.partitionBy(session).orderBy(ts)
    at = F.col(ts).cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > F.lit(int(ttl_seconds * 1_000_000))
    return turns.withColumn("part", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def correlate(tags: Column, injected: Column, input_status: Column, ingested_argument: Column) -> Column:
    """Layer 6: the reason to deny, "tighten" for a closer argument scan, or null."""
    return (
        F.when(injected & F.arrays_overlap(tags, F.array(*map(F.lit, HIGH_RISK_TAGS))), "input injection meets a high-risk tool")
        .when(ingested_argument, "a user_origin argument came from a tool result")
        .when((input_status == "warn") & ~F.array_contains(tags, "read"), "tighten")
    )
