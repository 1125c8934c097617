"""Configuration: YAML with environment and secret references, connector manifests, revocations, audit logs, tool listings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REFERENCE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}")


class ConfigError(ValueError):
    """A configuration that is refused."""


def resolve(value: Any, env: Mapping[str, str], secret: Callable[[str], str] | None = None) -> Any:
    """value with ${NAME} and ${NAME:-default} replaced, and texts secret://reference looked up, at any depth."""
    if isinstance(value, dict):
        return {k: resolve(v, env, secret) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env, secret) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match[str]) -> str:
        got = env.get(m[1], m[2])
        if got is None:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return got

    text = _REFERENCE.sub(put, value)
    if text.startswith("secret://"):
        if secret is None:
            raise ConfigError("a secret is referred to, but there is no provider")
        return secret(text.removeprefix("secret://"))
    return text


def env_secret(reference: str) -> str:
    """The secret in the environment variable of the reference's name, in upper case with "_" for other characters."""
    name = re.sub(r"\W", "_", reference).upper()
    try:
        return os.environ[name]
    except KeyError:
        raise ConfigError(f"secret {name} is not set") from None


#: Boundaries and what a section may say.
BOUNDARIES = ("scan_input", "scan_output", "scan_tool_result", "scan_file", "check_tool_call")
_SECTION = {"enabled", "scanners", "block_at", "on_error", "normalize", "scan_args_for_tags", "approvals", "max_size_mb"}
_TOP = {"version", "tenant", "audit", "sources", "connectors", "limits", "policy", "session", *BOUNDARIES}


def validate(config: dict[str, Any]) -> dict[str, Any]:
    """config, if it has no unknown key and no enabled text boundary without a scanner."""
    for k in config:
        if k not in _TOP:
            raise ConfigError(f"unknown key {k}")
    for b in BOUNDARIES:
        section = config.get(b) or {}
        for k in section:
            if k not in _SECTION:
                raise ConfigError(f"unknown key {b}.{k}")
        if b.startswith("scan_") and section.get("enabled", False) and not section.get("scanners"):
            raise ConfigError(f"{b} is enabled without a scanner")
    return config


def summary(config: dict[str, Any]) -> dict[str, Any]:
    """What a valid configuration sets up: its tenant, how many policy rules and audit sinks, and of each boundary whether it is on, its scanners and limit."""
    policy, audit = config.get("policy") or {}, config.get("audit") or {}
    sections = {b: config.get(b) or {} for b in BOUNDARIES}
    return {
        "tenant": config.get("tenant"),
        "policy_rules": len(policy.get("rules") or []),
        "forbidden_tags": [sorted(set(c)) for c in policy.get("forbidden_tags") or []],
        "audit_sinks": [s["name"] if isinstance(s, dict) else s for s in audit.get("sinks") or []],
        "boundaries": {b: {"enabled": bool(s.get("enabled", False)), "block_at": s.get("block_at"), "scanners": [x["name"] if isinstance(x, dict) else x for x in s.get("scanners") or []]} for b, s in sections.items()},
    }


def load(text: str, env: Mapping[str, str] | None = None, secret: Callable[[str], str] | None = env_secret) -> dict[str, Any]:
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ConfigError("the configuration is no mapping")
    return validate(resolve(raw, os.environ if env is None else env, secret))


#: Connector manifests: transport, address, tags, and each tool's tags and default action. Our own selection of common tools.
MANIFESTS = """
github: {transport: http, url: "https://api.githubcopilot.com/mcp/", tags: [code], tools: {list_issues: [read, allow], get_file: [read, allow], search_code: [read, allow], create_issue: [write, block], merge_pull_request: [write, block]}}
gmail: {transport: http, url: "https://gmail.googleapis.com/mcp", tags: [mail], tools: {search_mail: [read, allow], get_mail: [read, allow], create_draft: [write, alert], send_mail: [external, block]}}
google_drive: {transport: http, url: "https://drive.googleapis.com/mcp", tags: [files], tools: {list_files: [read, allow], get_file: [read, allow], share_file: [external, block], delete_file: [destructive, block]}}
jira: {transport: http, url: "https://mcp.atlassian.com/v1/sse", tags: [tickets], tools: {search: [read, allow], get_issue: [read, allow], create_issue: [write, block]}}
notion: {transport: http, url: "https://mcp.notion.com/mcp", tags: [notes], tools: {search: [read, allow], get_page: [read, allow], update_page: [write, block]}}
postgresql: {transport: stdio, url: null, tags: [database], tools: {query: [read, allow], list_tables: [read, allow], execute: [destructive, block]}}
slack: {transport: http, url: "https://mcp.slack.com/mcp", tags: [chat], tools: {list_channels: [read, allow], read_channel: [read, allow], post_message: [external, alert], invite_user: [external, block]}}
stripe: {transport: http, url: "https://mcp.stripe.com", tags: [payments], tools: {list_customers: [read, allow], get_balance: [read, allow], create_refund: [financial, block], create_payment: [financial, block]}}
"""


def manifests(spark: SparkSession, text: str = MANIFESTS) -> tuple[DataFrame, DataFrame]:
    """(sources: source, transport, url, tags; tools: source, tool_name, tags, action)."""
    raw = yaml.safe_load(text)
    sources = [(k, m["transport"], m["url"], m["tags"]) for k, m in raw.items()]
    tools = [(k, t, [v[0]], v[1]) for k, m in raw.items() for t, v in m["tools"].items()]
    return spark.createDataFrame(sources, "source string, transport string, url string, tags array<string>"), spark.createDataFrame(tools, "source string, tool_name string, tags array<string>, action string")


def revocations(raw: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(agent_id, reason) of revocation files read as whole texts (value): {"revoked": {agent: reason}}.

    If a file is unreadable, the last known rows (agent_id, reason) stay in force, as a kill switch that can't be read must
    not lift itself; without last, such a file gives none. No file at all is an empty set.
    """
    parsed = raw.select(F.from_json("value", "revoked map<string,string>")["revoked"].alias("m"))
    now = parsed.select(F.explode(F.coalesce("m", F.create_map().cast("map<string,string>"))).alias("agent_id", "reason"))
    if last is None or parsed.filter("m IS NULL").isEmpty():
        return now
    return last.select("agent_id", "reason").join(now.select("agent_id"), "agent_id", "left_anti").unionByName(now)


def audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of a log: lines are numbered from 1 in each file, by their place in it, however the file is split.

    A file's blocks are read in parallel; each line's number is its place in its block plus the lines of the blocks before.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), "raw")


def follow_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of lines."""
    return spark.readStream.text(path).withColumnRenamed("value", "raw")


def sse_events(text: str) -> list[tuple[str, str]]:
    """(event, data) of a server-sent event stream; data lines of an event are joined, comments dropped."""
    out, name, data = [], "message", []
    for line in [*text.split("\n"), ""]:
        line = line.rstrip("\r")
        key, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if not line:
            if data:
                out.append((name, "\n".join(data)))
            name, data = "message", []
        elif key == "event":
            name = value
        elif key == "data":
            data.append(value)
    return out
