"""Small dimension tables of the queries: tools, agents, rules, sources. oracle.py says the same in SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE_TYPE = "array<struct<arg:string,max_value:double,min_value:double,allowlist:array<string>,pattern:string,required:boolean,user_origin:boolean>>"


def _rule(arg, max_value=None, min_value=None, allowlist=None, pattern=None, required=False, user_origin=False):
    return (arg, max_value, min_value, allowlist, pattern, required, user_origin)


#: (tool, tags, transport, irreversibility, rules, source)
TOOLS = [
    ("click", ["read"], "local", "reversible", [_rule("value", max_value=95.0)], "web"),
    ("view", ["read", "web"], "mcp", "reversible", [], "web"),
    ("purchase", ["external", "financial"], "mcp", "sensitive", [_rule("value", max_value=90.0, min_value=2.0), _rule("k", pattern="^[0-9]$", user_origin=True)], "crm"),
    ("error", ["sensitive"], "local", "reversible", [_rule("note", required=True)], None),
    ("signup", ["destructive"], "local", "irreversible", [_rule("k", allowlist=["1", "2", "3", "4", "5", "6", "7", "8", "9"])], "crm"),
]
#: (agent, sub-agent, allowed tools, allowed tags)
AGENTS = [
    ("a0", None, ["click", "view", "purchase", "error", "signup"], ["read", "web", "external", "financial", "sensitive", "destructive"]),
    ("a1", None, ["click", "view", "purchase"], ["read", "web", "external", "financial"]),
    ("a2", None, ["click", "view", "signup", "error"], ["read", "web", "sensitive"]),
    ("a3", None, ["view", "purchase", "signup"], ["web", "read", "destructive", "external", "financial"]),
    ("a0", "a0-reader", ["view"], ["read", "web"]),
]
RULES = [
    {"id": "web-ok", "action": "allow", "match": {"tool_tags": ["web"]}},
    {"id": "no-mcp-a1", "action": "deny", "reason": "remote tools are off for this agent", "match": {"transport": ["mcp"], "agent_ids": ["a1"]}},
    {"id": "mask-purchases", "action": "redact", "redact": {"value": "***"}, "match": {"all": [{"tool_names": ["purchase"]}, {"not": {"agent_ids": ["a2"]}}]}},
    {"id": "no-signup", "action": "deny", "match": {"any": [{"tool_names": ["signup"], "agent_ids": ["a3"]}, {"tool_tags": ["nothing"]}]}},
    {"id": "hide", "action": "suppress", "match": {"source_tags": ["beta"]}},
]
#: (source, url, required)
SOURCES = [("crm", "https://u:p@crm.example/mcp?key=1", True), ("web", "https://web.example/mcp", False), ("mail", "https://crm.example/mcp#top", True), ("files", None, False)]
TOXIC = [["external", "sensitive"], ["financial", "external"], ["destructive", "sensitive"]]
REVOKED = ["a3"]
URL_PATTERNS = ["https://blog.tionsh.example.net/*", "http://thther.example.org/*", "https://www.ththhe.example.com/*", "https://m.*"]


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, f"tool_name string, tags array<string>, transport string, irreversibility string, argument_rules {RULE_TYPE}, source string")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGENTS, "agent_id string, sub_agent_id string, allowed_tool_names array<string>, allowed_tags array<string>")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, url string, required boolean")


def revoked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in REVOKED], "agent_id string")
