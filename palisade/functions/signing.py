"""Canonical JSON, keyed digests and signed envelopes. Spark has no HMAC, so these run in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(record: dict[str, Any], without: tuple[str, ...] = ()) -> str:
    """JSON with sorted keys, the usual separators, ASCII escapes, and no null fields."""
    return json.dumps({k: v for k, v in record.items() if v is not None and k not in without}, sort_keys=True, default=str)


def keyed_digest(message: str, secret: str) -> str:
    return hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


def args_digest(args: dict[str, Any]) -> str:
    """SHA-256 of compact JSON with sorted keys: what an approval is bound to."""
    return hashlib.sha256(json.dumps(args, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def seal(payload: dict[str, Any], secret: str) -> str:
    """payload and its signature as one base64url text."""
    body = canonical(payload)
    raw = json.dumps({"payload": json.loads(body), "signature": keyed_digest(body, secret)})
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def unseal(text: str | None, secret: str) -> dict[str, Any] | None:
    """The payload if the envelope is well formed and its signature right, else None."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        body = canonical(got["payload"])
        return got["payload"] if hmac.compare_digest(got["signature"], keyed_digest(body, secret)) else None
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def sign_json(record: Column, secret: str) -> Column:
    """The signature of a JSON text's canonical form without its own field signature; null if it isn't an object."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: _signature(t, secret)[0])

    return run(record)


def _signature(text: str | None, secret: str) -> tuple[str | None, str]:
    try:
        record = json.loads(text)
    except (ValueError, TypeError):
        return None, "malformed"
    if not isinstance(record, dict):
        return None, "malformed"
    right = keyed_digest(canonical(record, ("signature",)), secret)
    said = record.get("signature")
    return right, "unsigned" if not said else "ok" if isinstance(said, str) and hmac.compare_digest(said, right) else "mismatched"


def verify_json(record: Column, secret: str) -> Column:
    """ok, mismatched, unsigned or malformed, of a JSON text that carries its signature."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: _signature(t, secret)[1])

    return run(record)


def grant(approver: str, agent_id: str, tenant: str, tool: str, args: dict[str, Any], now: datetime, secret: str, ttl_s: int = 300) -> str:
    """A signed approval of one call."""
    return seal({"approver": approver, "agent_id": agent_id, "tenant": tenant, "tool": tool, "args": args_digest(args), "issued": now.timestamp(), "expires": now.timestamp() + ttl_s}, secret)


def valid_approvers(grants: Column, agent_id: Column, tenant: Column, tool: Column, args_json: Column, now: Column, secret: str) -> Column:
    """ARRAY<STRING>: distinct approvers, sorted, whose grants are right, in time and for this agent, tenant, tool and arguments."""

    @F.pandas_udf("array<string>")
    def run(g: pd.Series, a: pd.Series, te: pd.Series, to: pd.Series, js: pd.Series, ts: pd.Series) -> pd.Series:
        out = []
        for gs, agent, ten, name, args, at in zip(g, a, te, to, js, ts, strict=True):
            when = at.replace(tzinfo=UTC).timestamp() if at.tzinfo is None else at.timestamp()
            want = (agent, ten, name, args_digest(json.loads(args or "{}")))
            got = [p for x in (gs if gs is not None else ()) if (p := unseal(x, secret))]
            out.append(sorted({p["approver"] for p in got if (p["agent_id"], p["tenant"], p["tool"], p["args"]) == want and p["issued"] <= when <= p["expires"]}))
        return pd.Series(out)

    return run(grants, agent_id, tenant, tool, args_json, now)
