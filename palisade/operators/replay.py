"""Sequential state over events in order: rate limits, budgets, loops, breakers. What a denied call leaves unrecorded makes a plain window wrong.

Each fold is a small object with one method per event. In batch it runs over a key's sorted rows, streamed through
mapInPandas so that a key with many rows needs only its state; in streaming the same object lives in the state store.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class RateLimit:
    """At most cap calls in a closed window of seconds, over all tools and for single tools. A denied call isn't recorded; if the cap over all tools denies, the tool's isn't looked at."""

    def __init__(self, cap: int | None, window: float, tool_caps: dict[str, int] | None = None):
        self.cap, self.window, self.tool_caps = cap, window, tool_caps or {}
        self.all: deque[float] = deque()
        self.by_tool: dict[str, deque[float]] = {}

    def step(self, row: dict[str, Any]) -> str | None:
        now, tool = row["ts"], row["tool_name"]
        mine = self.by_tool.setdefault(tool, deque()) if tool in self.tool_caps else None
        for q in (self.all, mine):
            while q and q[0] < now - self.window:
                q.popleft()
        if self.cap is not None and len(self.all) >= self.cap:
            return "rate limit over all tools"
        if mine is not None:
            if len(mine) >= self.tool_caps[tool]:
                return "rate limit of the tool"
            mine.append(now)
        if self.cap is not None:
            self.all.append(now)
        return None


def call_fingerprint(tool: str, args: dict[str, Any] | None, arg_chars: int | None = None) -> frozenset[str]:
    """The tool and each argument with its value, whole or, with arg_chars, its first characters."""
    return frozenset([f"tool={tool}", *(f"{k}:{json.dumps(v, default=str)[:arg_chars]}" for k, v in (args or {}).items())])


class Budget:
    """Steps of a session, calls of a prompt (counted anew when the prompt changes) and near-identical calls among the last allowed ones. Only allowed calls count."""

    def __init__(self, max_steps: int | None = None, max_per_prompt: int | None = None, loop_window: int = 0, loop_at: float = 0.95, arg_chars: int | None = None):
        self.max_steps, self.max_per_prompt, self.loop_at, self.arg_chars = max_steps, max_per_prompt, loop_at, arg_chars
        self.steps = self.calls = 0
        self.prompt: str | None = None
        self.recent: deque[frozenset[str]] = deque(maxlen=loop_window)

    def step(self, row: dict[str, Any]) -> str | None:
        prompt = row.get("prompt_id")
        if prompt is not None and prompt != self.prompt:
            self.prompt, self.calls = prompt, 0
        if self.max_steps is not None and self.steps >= self.max_steps:
            return "session budget: steps"
        if prompt is not None and self.max_per_prompt is not None and self.calls >= self.max_per_prompt:
            return "session budget: calls of the prompt"
        if self.recent.maxlen:
            mine = call_fingerprint(row["tool_name"], row.get("args"), self.arg_chars)
            if any(len(mine & p) >= self.loop_at * len(mine | p) for p in self.recent):
                return "loop"
            self.recent.append(mine)
        self.steps += 1
        self.calls += prompt is not None
        return None


class Breaker:
    """Opens after failures in a row, for open_s; then one probe: success closes it, failure opens it for twice as long, at most most_s."""

    def __init__(self, failures: int = 5, open_s: float = 60.0, most_s: float = 300.0):
        self.limit, self.first, self.most = failures, open_s, most_s
        self.count, self.until, self.wait = 0, None, open_s

    def step(self, row: dict[str, Any]) -> str:
        """The state in which the outcome (ok) was met: closed, open (the call was skipped) or half_open."""
        now, ok = row["ts"], row["ok"]
        if self.until is not None and now < self.until:
            return "open"
        probe = self.until is not None
        if ok:
            self.count, self.until, self.wait = 0, None, self.first
        elif probe:
            self.wait = min(2 * self.wait, self.most)
            self.until = now + self.wait
        else:
            self.count += 1
            if self.count >= self.limit:
                self.until = now + self.wait
        return "half_open" if probe else "closed"


def replay(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Any], out: str) -> DataFrame:
    """rows with a column out: what a fresh fold of each key says of its rows in order. rows need ts in seconds or as a timestamp.

    One shuffle by key; a partition's rows are sorted and streamed, so memory holds a batch and one key's state.
    """
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    is_time = dict(rows.dtypes).get("ts", "").startswith("timestamp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            says = []
            seconds = b["ts"].astype("datetime64[us, UTC]" if b["ts"].dtype.kind == "M" and b["ts"].dt.tz is not None else "datetime64[us]").astype("int64") / 1e6 if is_time else b.get("ts")
            for i, r in enumerate(b.to_dict("records")):
                if state is None or [r[k] for k in keys] != key:
                    key, state = [r[k] for k in keys], fold()
                if seconds is not None:
                    r["ts"] = float(seconds.iloc[i])
                says.append(state.step(r))
            yield b.assign(**{out: says})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# The same where a window suffices ------------------------------------------------------------------------------------


def step_budget(calls: DataFrame, max_steps: int, keys: list[str], order: list[str]) -> DataFrame:
    """Adds allowed for a budget of steps alone."""
    return calls.withColumn("allowed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= max_steps)


def prompt_islands(calls: DataFrame, max_per_prompt: int, keys: list[str], order: list[str], prompt: str = "prompt_id") -> DataFrame:
    """Adds island (it changes whenever the prompt does, back to an old one too), nth (place in it) and allowed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c = calls.withColumn("island", F.sum(F.coalesce((F.col(prompt) != F.lag(prompt).over(w)).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)))
    return c.withColumn("allowed", F.col("nth") <= max_per_prompt)
