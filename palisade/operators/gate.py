"""The tool-call gate as one select over calls joined with small dimension tables: the first layer that denies gives the reason.

Reasons name the argument and the rule, never an argument's value.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.turns import correlate

#: Dimension tables (agents, tools, rules, revocations) of up to this many rows are broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# Layer 2 ------------------------------------------------------------------------------------------------------------


def argument_violation(args: Column, rule: Column) -> Column:
    """What a rule (arg, max_value, min_value, allowlist, pattern, required) has against a call's arguments (MAP<STRING, STRING>), or null.

    In order: required, max, min, allow list, pattern. A value that isn't numeric breaks a numeric rule; an absent optional one breaks none.
    """
    v = F.try_element_at(args, rule["arg"])
    number = v.try_cast("double")
    say = lambda what: F.concat(F.lit("argument '"), rule["arg"], F.lit(f"' {what}"))
    return (
        F.when(v.isNull(), F.when(rule["required"], say("is missing")))
        .when(rule["max_value"].isNotNull() & number.isNull(), say("is not numeric"))
        .when(number > rule["max_value"], say("exceeds its maximum"))
        .when(rule["min_value"].isNotNull() & number.isNull(), say("is not numeric"))
        .when(number < rule["min_value"], say("is below its minimum"))
        .when(rule["allowlist"].isNotNull() & ~F.array_contains(rule["allowlist"], v), say("is not in the allowed set"))
        .when(rule["pattern"].isNotNull() & ~F.regexp_like(v, rule["pattern"]), say("does not match its pattern"))
    )


def first_violation(args: Column, rules: Column) -> Column:
    """The first violation of an array of rules, or null."""
    return F.get(F.filter(F.transform(rules, lambda r: argument_violation(args, r)), lambda x: x.isNotNull()), F.lit(0))


# Layer 3 ------------------------------------------------------------------------------------------------------------


def quorum_reason(irreversibility: Column, approvers: Column, configured: bool, sensitive: int = 1, irreversible: int = 2) -> Column:
    """Why a sensitive or irreversible tool may not be called: grants aren't configured, or too few distinct approvers; else null."""
    need = F.when(irreversibility == "irreversible", irreversible).when(irreversibility == "sensitive", sensitive).otherwise(0)
    if not configured:
        return F.when(need > 0, F.lit("approval grants are not configured"))
    return F.when(F.coalesce(F.size(F.array_distinct(approvers)), F.lit(0)) < need, F.lit("too few distinct approvers"))


# Layer 4 ------------------------------------------------------------------------------------------------------------


def missing_tags(tool_tags: Column, profile_tags: Column, context_tags: Column) -> Column:
    """Tags of the tool, sorted, that the profile, narrowed by the context if that has tags, doesn't allow."""
    allowed = F.when(context_tags.isNull(), profile_tags).otherwise(F.array_intersect(profile_tags, context_tags))
    return F.array_sort(F.array_except(tool_tags, allowed))


# Layer 5 ------------------------------------------------------------------------------------------------------------


def compile_match(match: dict[str, Any], c: dict[str, Column]) -> Column:
    """A rule's match as one boolean column over c: tool_name, tool_tags, transport, agent_id, sub_agent_id, source_tags.

    All conditions must hold; a list is membership, tags overlap; any, all and not nest; an empty list says nothing.
    """
    tests: list[Column] = []
    for key, col in (("tool_names", "tool_name"), ("transport", "transport"), ("agent_ids", "agent_id"), ("sub_agent_ids", "sub_agent_id")):
        if match.get(key):
            tests.append(F.coalesce(c[col].isin(match[key]), F.lit(False)))
    for key, col in (("tool_tags", "tool_tags"), ("source_tags", "source_tags")):
        if match.get(key):
            tests.append(F.coalesce(F.arrays_overlap(c[col], F.array(*map(F.lit, match[key]))), F.lit(False)))
    if match.get("any"):
        tests.append(reduce(lambda a, b: a | b, [compile_match(m, c) for m in match["any"]]))
    tests += [compile_match(m, c) for m in match.get("all") or ()]
    if match.get("not") is not None:
        tests.append(~compile_match(match["not"], c))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_match(rules: list[dict[str, Any]], c: dict[str, Column], suppress: bool = False) -> Column:
    """STRUCT<rule_id, action, reason> of the first rule that matches (an earlier allow beats a later deny), or null.

    With suppress, only suppress rules count (for sources), else all others.
    """
    out = None
    for r in rules:
        if (r["action"] == "suppress") != suppress:
            continue
        says = F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["action"]).alias("action"), F.lit(r.get("reason") or f"denied by rule '{r['id']}'").alias("reason"))
        hit = compile_match(r.get("match") or {}, c)
        out = F.when(hit, says) if out is None else out.when(hit, says)
    return F.lit(None).cast("struct<rule_id:string,action:string,reason:string>") if out is None else out


def _without_keys(args: Column, names: list[str]) -> Column:
    return F.map_filter(args, lambda k, v: ~k.isin(names))


def redact_args(args: Column, rule_id: Column, rules: list[dict[str, Any]]) -> Column:
    """args with what the matched redact rule names replaced; all else stays."""
    out = args
    for r in rules:
        if r["action"] == "redact" and r.get("redact"):
            put = F.create_map(*[F.lit(x) for kv in r["redact"].items() for x in kv])
            out = F.when(rule_id == r["id"], F.map_concat(_without_keys(args, list(r["redact"])), put)).otherwise(out)
    return out


# Connectivity -------------------------------------------------------------------------------------------------------


def url_allowed(url: Column, patterns: Column) -> Column:
    """Whether a url equals a pattern, or begins as one that ends in "/*"; an empty list allows any."""
    fits = lambda p: F.when(p.endswith("/*"), F.startswith(url, F.substring(p, F.lit(1), F.length(p) - 1))).otherwise(url == p)
    return (F.size(patterns) == 0) | F.exists(patterns, fits)


def method_allowed(method: Column, methods: Column) -> Column:
    """Upper-cased membership; an empty list allows any."""
    return (F.size(methods) == 0) | F.array_contains(F.transform(methods, F.upper), F.upper(method))


def mark_replays(uses: DataFrame, token: str = "token_id", ts: str = "ts", order: str = "use_id") -> DataFrame:
    """Adds replayed: any use of a token but its first, in time."""
    return uses.withColumn("replayed", F.row_number().over(Window.partitionBy(token).orderBy(ts, order)) > 1)


def dispatch_reason(url: Column, method: Column, token: Column, now: Column, replayed: Column, allowed_urls: Column, allowed_methods: Column, strict: bool = True) -> Column:
    """Why a dispatch is refused, in the order of checks, or null: source url and method, signature and expiry, source, token url and method, reuse, and no token where one is required.

    token: STRUCT<valid BOOLEAN, expires_at TIMESTAMP, source STRING, right_source BOOLEAN, urls, methods>, null without a token.
    """
    has = token.isNotNull()
    return (
        F.when(~url_allowed(url, allowed_urls), "url not allowed for the source")
        .when(~method_allowed(method, allowed_methods), "method not allowed for the source")
        .when(has & ~token["valid"], "token signature is invalid")
        .when(has & (token["expires_at"] < now), "token has expired")
        .when(has & ~token["right_source"], "token is bound to another source")
        .when(has & ~url_allowed(url, token["urls"]), "url not allowed by the token")
        .when(has & ~method_allowed(method, token["methods"]), "method not allowed by the token")
        .when(has & replayed, "token was used before")
        .when(~has & F.lit(strict), "no token")
    )


# The gate -----------------------------------------------------------------------------------------------------------


def gate_calls(calls: DataFrame, agents: DataFrame, tools: DataFrame, rules: list[dict[str, Any]], revoked: DataFrame | None = None, approvals_configured: bool = False) -> DataFrame:
    """Adds allowed, layer, deny_reason, rule_id, final_args and scan_args to calls.

    calls: agent_id, sub_agent_id, context_tags, tool_name, args MAP<STRING, STRING>, approvers ARRAY<STRING>, and from earlier
    passes pre_reason (rate limit or budget; null if none), input_status, input_injection, ingested ARRAY<STRING> (arguments
    whose value came from a tool result). agents: agent_id, sub_agent_id (null for the agent itself), allowed_tool_names,
    allowed_tags. tools: tool_name, tags, transport, irreversibility, argument_rules.
    """
    a = small(agents.select(F.col("agent_id").alias("_a"), F.coalesce("sub_agent_id", F.lit("")).alias("_s"), "allowed_tool_names", "allowed_tags"))
    known = small(agents.select(F.col("agent_id").alias("_k")).distinct())
    t = small(tools.select(F.col("tool_name").alias("_t"), "tags", "transport", "irreversibility", "argument_rules"))
    j = calls.join(known, F.col("agent_id") == F.col("_k"), "left").join(a, (F.col("agent_id") == F.col("_a")) & (F.coalesce("sub_agent_id", F.lit("")) == F.col("_s")), "left").join(t, F.col("tool_name") == F.col("_t"), "left")
    if revoked is not None:
        j = j.join(small(revoked.select(F.col("agent_id").alias("_r")).distinct()), F.col("agent_id") == F.col("_r"), "left")
    else:
        j = j.withColumn("_r", F.lit(None).cast("string"))
    cols = {"tool_name": F.col("tool_name"), "tool_tags": F.col("tags"), "transport": F.col("transport"), "agent_id": F.col("agent_id"), "sub_agent_id": F.col("sub_agent_id"), "source_tags": F.array().cast("array<string>")}
    j = j.withColumns({"_m": first_match(rules, cols), "_missing": missing_tags(F.col("tags"), F.col("allowed_tags"), F.col("context_tags"))})
    user_origin = F.transform(F.filter("argument_rules", lambda r: r["user_origin"]), lambda r: r["arg"])
    j = j.withColumn("_c", correlate(F.col("tags"), F.coalesce("input_injection", F.lit(False)), F.col("input_status"), F.arrays_overlap(user_origin, F.coalesce("ingested", F.array().cast("array<string>")))))
    layers: list[tuple[str, Column]] = [
        ("R0", F.when(F.col("_r").isNotNull(), F.lit("agent is revoked"))),
        ("R1-R2", F.col("pre_reason")),
        ("registry", F.when(F.col("_k").isNull(), F.lit("agent is not registered"))),
        ("profile", F.when(F.col("_a").isNull(), F.lit("sub-agent is not declared"))),
        ("L1", F.when(~F.array_contains("allowed_tool_names", F.col("tool_name")), F.lit("tool is not in the allowed names"))),
        ("lookup", F.when(F.col("_t").isNull(), F.lit("tool is not registered"))),
        ("L2", first_violation(F.col("args"), F.col("argument_rules"))),
        ("L3", quorum_reason(F.col("irreversibility"), F.col("approvers"), approvals_configured)),
        ("L4", F.when(F.size("_missing") > 0, F.concat(F.lit("tool requires tags "), F.array_join("_missing", ", ")))),
        ("L5", F.when(F.col("_m.action") == "deny", F.col("_m.reason"))),
        ("L6", F.when(F.col("_c") != "tighten", F.col("_c"))),
    ]
    j = j.withColumn("_d", F.coalesce(*[F.when(why.isNotNull(), F.struct(F.lit(name).alias("layer"), why.alias("reason"))) for name, why in layers]))
    redacted = F.when(F.col("_m.action") == "redact", redact_args(F.col("args"), F.col("_m.rule_id"), rules)).otherwise(F.col("args"))
    allowed = F.col("_d").isNull()
    return j.select(
        *calls.columns,
        allowed.alias("allowed"),
        F.col("_d.layer").alias("layer"),
        F.col("_d.reason").alias("deny_reason"),
        F.col("_m.rule_id").alias("rule_id"),
        F.when(allowed, redacted).alias("final_args"),
        (allowed & (F.array_contains("tags", "sensitive") | (F.coalesce("_c", F.lit("")) == "tighten"))).alias("scan_args"),
    )


def scan_arguments(decided: DataFrame, action: str = "block") -> DataFrame:
    """Layer 7 over gate_calls' result: each argument of calls to scan is read as "name: value"; a finding of high severity blocks, redacts or alerts."""
    from palisade.functions import detect

    lines = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.concat(e["key"], F.lit(": "), e["value"]).alias("line")))
    high = lambda line: F.filter(detect.findings(line), lambda f: f["severity"].isin("high", "critical"))
    found = F.filter(F.transform(lines(F.col("final_args")), lambda x: F.struct(x["key"].alias("key"), F.get(high(x["line"]), F.lit(0))["category"].alias("category"))), lambda x: x["category"].isNotNull())
    d = decided.withColumn("_f", F.when(F.col("scan_args"), found))
    hit = F.size(F.coalesce("_f", F.array().cast("array<struct<key:string,category:string>>"))) > 0
    if action == "block":
        d = d.withColumn("deny_reason", F.when(hit, F.concat(F.lit("argument scan found "), F.col("_f")[0]["category"])).otherwise(F.col("deny_reason")))
        d = d.withColumn("layer", F.when(hit, "L7").otherwise(F.col("layer"))).withColumn("allowed", F.col("allowed") & ~hit).withColumn("final_args", F.when(~hit, F.col("final_args")))
    elif action == "redact":
        keys = F.transform("_f", lambda x: x["key"])
        clean = lambda k, v: F.when(F.array_contains(keys, k), F.substring(detect.redact(F.concat(k, F.lit(": "), v)), F.length(k) + 3, F.lit(1 << 30))).otherwise(v)
        d = d.withColumn("final_args", F.when(hit, F.transform_values("final_args", clean)).otherwise(F.col("final_args")))
    return d.withColumn("arg_finding", F.when(hit, F.col("_f")[0]["category"])).drop("_f")
