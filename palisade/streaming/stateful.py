"""The sequential folds over streams: rate limits, budgets, breakers and candidates in the state store, nonces by watermark, risk by session."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from palisade.functions.ranks import status_rank
from palisade.functions.text import word_bigrams
from palisade.operators.turns import RISK, SessionScore

#: Idle time after which a key's state is dropped.
STATE_TTL_MS = 72 * 3600 * 1000
#: How late an event may be.
LATENESS = "10 minutes"


def stream_fold(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Any], out: str, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """rows of a stream with a column out, as operators.replay.replay does for a batch: a key's state lives in the state store.

    Within a micro-batch a key's rows are taken in order; between micro-batches in order of arrival. A key that is idle for
    ttl_ms starts afresh. ts is a timestamp. A key's rows of one micro-batch are held at once, so a trigger bounds them.
    """
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    state_schema = StructType([StructField("pickled", BinaryType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pickle.loads(state.get[0]) if state.exists else fold()
        b = pd.concat(list(batches)).sort_values(order)
        seconds = pd.to_datetime(b["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64") / 1e6
        says = [now.step(r | {"ts": t}) for r, t in zip(b.to_dict("records"), seconds, strict=True)]
        state.update((pickle.dumps(now),))
        state.setTimeoutDuration(ttl_ms)
        yield b.assign(**{out: says})

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_risk(turns: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """A stream of turns (session_id, ts, turn_index, status, density, turn_risk, text) with score, reframe and latched.

    The window of turns, the last word pairs and the latch live in the state store; an idle session starts afresh.
    """
    t = turns.select("session_id", "ts", "turn_index", "status", "density", "turn_risk", word_bigrams(F.col("text")).alias("bigrams"))
    out = stream_fold(t, ["session_id"], ["ts", "turn_index"], SessionScore, "risk", ttl_ms)
    return out.select("session_id", "ts", "turn_index", F.from_json("risk", RISK).alias("r")).select("session_id", "ts", "turn_index", "r.*")


def upsert_sessions(risk: DataFrame, write: Callable[[DataFrame, int], None]):
    """A stream writer of each session's last score: of a micro-batch one row a session goes to write, which puts it over the old one."""

    def each(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("session_id").agg(F.max_by(F.struct("ts", "turn_index", "score", "latched"), F.struct("ts", "turn_index")).alias("r"))
        write(last.select("session_id", "r.*"), n)

    return risk.writeStream.foreachBatch(each)


def first_uses(uses: DataFrame, token: str = "token_id", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first use of each token within the watermark; any later one is a replay."""
    return uses.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([token])


def audit_rollup(events: DataFrame, window: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """Counts by window, boundary and decision of a stream of events (timestamp, boundary, decision)."""
    return events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", window), "boundary", "decision").agg(F.count("*").alias("n"))


def turn_status(evidence: DataFrame, lateness: str = LATENESS, idle: str = "10 minutes") -> DataFrame:
    """The worst status of each conversation's session window in a stream of evidence (ts, conversation_id, status)."""
    e = evidence.withWatermark("ts", lateness).groupBy(F.session_window("ts", idle), "conversation_id")
    return e.agg(F.max(status_rank(F.col("status"))).alias("status_rank"), F.count("*").alias("n"))


def with_revocations(calls: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """A stream writer of calls with a column revoked; the revocation table is read anew for each micro-batch."""

    def each(batch: DataFrame, n: int) -> None:
        revoked = read().select("agent_id", F.lit(True).alias("revoked")).distinct()
        write(batch.join(revoked, "agent_id", "left").withColumn("revoked", F.coalesce("revoked", F.lit(False))), n)

    return calls.writeStream.foreachBatch(each)


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame], None]]):
    """A stream writer that sends each micro-batch to every sink; only if all fail, the batch fails."""
    from palisade.operators.audit import emit

    return events.writeStream.foreachBatch(lambda batch, _: emit(batch, sinks) and None)


