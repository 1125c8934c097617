"""Queries over the driver's tables, one for each operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import detect
from palisade.functions import text as T
from palisade.functions.ranks import severity_rank
from palisade.operators import audit, candidates, gate, replay, scan, topology, turns
from palisade.plans import dims
from palisade.session import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return scan.pii_findings(_docs(spark, sf), "doc_id", F.col("text"))


# Detection ------------------------------------------------------------------------------------------------------------


@query
def pii_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select("doc_id", "category", "severity", "n")


@query
def pii_page_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scan.pii_findings(table(spark, sf, "pages"), "page_id", F.col("html")).select("page_id", "category", "n")


@query
def pii_luhn_cards(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.explode(detect.matches("pii.credit_card", F.col("text"))).alias("m"))
    return d.select("doc_id", F.sha2(F.regexp_replace("m", "[^0-9]", ""), 256).alias("card_sha256")).groupBy("doc_id", "card_sha256").agg(F.count("*").alias("n"))


@query
def pii_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in which one of the twelve categories was replaced."""
    d = _docs(spark, sf).withColumn("r", detect.redact(F.col("text")))
    return d.filter("r != text").select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.length("r").alias("n_chars"))


@query
def scan_verdict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by verdict and worst severity: the flagship."""
    v = scan.fold_status(_docs(spark, sf), _findings(spark, sf), "doc_id", {"regex_pii": "block"})
    return v.groupBy("status", "max_severity").agg(F.count("*").alias("n_docs"), F.sum("finding_count").alias("n_findings"))


@query
def severity_threshold(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    levels = F.explode(F.array(*[F.lit(x) for x in ("low", "medium", "high")])).alias("block_at")
    e = f.select("doc_id", "severity", levels).filter(severity_rank(F.col("severity")) >= severity_rank(F.col("block_at")))
    return e.groupBy("block_at").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_findings"))


@query
def ensemble_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two families, of which the second sees long documents, promoted where both agree."""
    f = _findings(spark, sf).select("doc_id", "scanner", "category", "severity", "method_family")
    second = table(spark, sf, "documents").filter("n_chars >= 1500").select("doc_id").join(f, "doc_id").withColumn("scanner", F.lit("length_scan")).withColumn("method_family", F.lit("structural"))
    return scan.promote(f.unionByName(second), "doc_id").groupBy("category", "severity", "promoted").agg(F.count("*").alias("n"))


@query
def view_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all categories over the folded, the reversed and the rotated text, the first view kept for each category."""
    # a column of its own, as the three views are made of it and a generator makes its input anew for each
    folded, t = T.fold_native(F.col("text")), F.col("folded")
    d = _docs(spark, sf).select("doc_id", folded.alias("folded")).select("doc_id", F.posexplode(F.array(t, F.reverse(t), T.rot13(t))).alias("view_pos", "v"))
    f = d.select("doc_id", "view_pos", F.explode(detect.findings(F.col("v"))).alias("f")).select("doc_id", "view_pos", F.lit("regex_pii").alias("scanner"), "f.category", "f.severity")
    return scan.merge_views(f, "doc_id").select("doc_id", "category", "severity", "view_pos")


@query
def on_error_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses when a scanner fails on empty-ish texts, by policy."""
    d = _docs(spark, sf).select("doc_id", (F.length("text") >= 100).alias("ok"), F.explode(F.array(*map(F.lit, ("fail_closed", "fail_open", "degrade")))).alias("policy"))
    return d.groupBy("policy", F.coalesce(scan.on_error_status(F.col("ok"), F.col("policy")), F.lit("allow")).alias("status")).agg(F.count("*").alias("n"))


@query
def block_at_tightening(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf).groupBy("doc_id").agg(F.max(severity_rank(F.col("severity"))).alias("r"))
    d = table(spark, sf, "documents").join(f, "doc_id").withColumn("gate_ran", F.col("doc_id") % 2 == 0).withColumn("injected", F.col("doc_id") % 3 == 0)
    at = scan.tightened(F.lit("high"), F.col("injected"), F.col("gate_ran"))
    return d.select("doc_id", at.alias("block_at"), (F.col("r") >= severity_rank(at)).alias("blocked"))


@query
def detector_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict against the labels: counts by quality, toxicity and status."""
    v = scan.fold_status(_docs(spark, sf), _findings(spark, sf), "doc_id", {"regex_pii": "block"}, block_at="medium")
    return table(spark, sf, "labels").join(v, "doc_id").groupBy("quality", "toxic", "status").agg(F.count("*").alias("n"))


# Normalization and scores -----------------------------------------------------------------------------------------------


@query
def norm_strip_translate(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).withColumn("folded", T.fold_native(F.col("text")))
    return d.select("doc_id", F.length("folded").alias("n_chars"), F.sha2("folded", 256).alias("folded_sha256"))


@query
def norm_rot13_reverse_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", T.word_score(t).alias("words"), T.word_score(T.rot13(t)).alias("words_rot13"), T.if_recovered(t, F.reverse(t)).isNotNull().alias("reversed_kept"))


@query
def norm_split_glued(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", (F.length(T.split_glued(F.col("text"))) - F.length("text")).alias("n_splits"))


@query
def text_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(T.entropy(F.col("text")), 6).alias("bits"))


@query
def entropy_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(T.entropy_windows(F.col("text")), 6).alias("bits"))


@query
def instruction_density(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(detect.density(F.col("text")), 6).alias("density"), F.round(detect.density_score(F.col("text")), 6).alias("score"))


@query
def structural_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit(detect.MARKUP)).alias("n_markers"), F.round(detect.structural_score(F.col("html")), 6).alias("score"))


@query
def scoring_functions(spark: SparkSession, sf: str) -> DataFrame:
    from palisade.functions import scores

    t = F.col("text")
    return _docs(spark, sf).select("doc_id", scores.structure_score(t).alias("structure"), scores.encoding_score(t).alias("encoding"), scores.obfuscation_score(t).alias("obfuscation"), scores.intent_score(t).alias("intent"), scores.soft_triggers(t).alias("soft"), scores.persona_score(t).alias("persona"), scores.invisible_text(t).alias("invisible"))


@query
def token_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.token_digests(F.col("text"))).alias("n"), F.coalesce(F.array_min(T.token_digests(F.col("text"))), F.lit("")).alias("least"))


@query
def provenance_ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Of each conversation, the answers' tokens that the system turn has and the user's turns have not."""
    c = table(spark, sf, "conversations").select("conv_id", "role", F.explode(T.token_digests(F.col("text"))).alias("d")).distinct()
    of = lambda r: c.filter(F.col("role") == r).select("conv_id", "d")
    got = of("assistant").join(of("system"), ["conv_id", "d"], "left_semi").join(of("user"), ["conv_id", "d"], "left_anti")
    return got.groupBy("conv_id").agg(F.count("*").alias("n_ingested"))


@query
def minhash_signature(spark: SparkSession, sf: str) -> DataFrame:
    m = T.minhash(T.char_bigrams(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.array_join(F.transform(m, lambda x: x.cast("string")), ","), 256).alias("minima_sha256"))


@query
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of conversation turns with character-pair signatures that agree in 0.7 of places."""
    t = table(spark, sf, "conversations").select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), T.minhash(T.char_bigrams(F.col("text"))).alias("minhash"))
    return candidates.like_pairs(t, "id").select("a", "b", F.round("likeness", 6).alias("likeness"))


@query
def redact_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.redact_url(F.col("url")).alias("url"))


# Tool calls: events are calls, their type the tool, their user the agent ----------------------------------------------


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.concat(F.lit("a"), F.col("user_id") % 5).alias("agent_id"), "user_id", F.col("event_type").alias("tool_name"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("args"))


@query
def arg_rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).join(gate.small(dims.tools(spark).select("tool_name", "argument_rules")), "tool_name")
    v = c.select("tool_name", gate.first_violation(F.col("args"), F.col("argument_rules")).alias("violation"))
    return v.groupBy("tool_name", "violation").agg(F.count("*").alias("n"))


@query
def policy_first_match(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).join(gate.small(dims.tools(spark).select("tool_name", "tags", "transport")), "tool_name")
    m = gate.first_match(dims.RULES, {"tool_name": F.col("tool_name"), "tool_tags": F.col("tags"), "transport": F.col("transport"), "agent_id": F.col("agent_id"), "sub_agent_id": F.lit(None).cast("string"), "source_tags": F.array().cast("array<string>")})
    d = c.withColumn("m", m)
    return d.groupBy(F.coalesce("m.rule_id", F.lit("none")).alias("rule_id"), F.coalesce("m.action", F.lit("allow")).alias("action")).agg(F.count("*").alias("n"))


@query
def policy_redaction(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).filter("tool_name = 'purchase'")
    out = gate.redact_args(F.col("args"), F.lit("mask-purchases"), dims.RULES)
    return c.groupBy(out["value"].alias("value")).agg(F.count("*").alias("n"), F.sum(out["k"].cast("long")).alias("sum_k"))


@query
def tag_capability_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).join(gate.small(dims.tools(spark).select("tool_name", "tags")), "tool_name").join(gate.small(dims.agents(spark).filter("sub_agent_id IS NULL").select("agent_id", "allowed_tags")), "agent_id")
    missing = gate.missing_tags(F.col("tags"), F.col("allowed_tags"), F.lit(None).cast("array<string>"))
    return c.select("agent_id", "tool_name", F.array_join(missing, ",").alias("missing")).groupBy("agent_id", "tool_name", "missing").agg(F.count("*").alias("n"))


@query
def toxic_tag_combos(spark: SparkSession, sf: str) -> DataFrame:
    return topology.toxic_tags(dims.agents(spark).filter("sub_agent_id IS NULL"), dims.TOXIC)


@query
def revoked_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).join(gate.small(dims.revoked(spark)), "agent_id", "left_anti")
    return c.groupBy("agent_id").agg(F.count("*").alias("n_calls"))


@query
def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """All layers over all calls: decisions by layer and reason."""
    c = _calls(spark, sf).withColumns({"sub_agent_id": F.lit(None).cast("string"), "context_tags": F.lit(None).cast("array<string>"), "approvers": F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))), "pre_reason": F.lit(None).cast("string"), "input_status": F.when(F.col("event_id") % 7 == 0, "warn").otherwise("allow"), "input_injection": F.col("event_id") % 11 == 0, "ingested": F.when(F.col("event_id") % 13 == 0, F.array(F.lit("k")))})
    g = gate.gate_calls(c, dims.agents(spark), dims.tools(spark), dims.RULES, dims.revoked(spark), approvals_configured=True)
    return g.groupBy("allowed", F.coalesce("layer", F.lit("allow")).alias("layer"), "scan_args").agg(F.count("*").alias("n"))


@query
def url_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by scheme and whether the list allows their address."""
    p = table(spark, sf, "pages").select("page_id", F.substring_index("url", "://", 1).alias("scheme"), gate.url_allowed(F.col("url"), F.array(*map(F.lit, dims.URL_PATTERNS))).alias("allowed"))
    return p.groupBy("scheme", "allowed").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query
def method_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", gate.method_allowed(F.col("event_type"), F.array(*map(F.lit, ("Click", "VIEW")))).alias("allowed"))
    return e.groupBy("event_type", "allowed").agg(F.count("*").alias("n"))


@query
def quorum_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Approvers of a user's calls of an hour (of every other kind of event, one for each): whether they make a quorum for sensitive and for irreversible tools."""
    approver = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    e = table(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.collect_set(approver).alias("approvers"))
    reason = lambda kind: gate.quorum_reason(F.lit(kind), F.col("approvers"), True).isNull()
    return e.groupBy(reason("sensitive").alias("sensitive_ok"), reason("irreversible").alias("irreversible_ok")).agg(F.count("*").alias("n"))


@query
def nonce_replay(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "events").select(F.col("event_id").alias("use_id"), "ts", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("token_id"))
    return gate.mark_replays(uses).groupBy("token_id").agg(F.count_if("replayed").alias("n_replayed"), F.min_by("use_id", F.struct("ts", "use_id")).alias("first_use"))


# Sequences ------------------------------------------------------------------------------------------------------------


@query
def step_budget(spark: SparkSession, sf: str) -> DataFrame:
    c = replay.step_budget(_calls(spark, sf), 20, ["user_id"], ["ts", "event_id"])
    return c.groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_denied"))


@query
def fanout_islands(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).withColumn("prompt_id", F.date_format("ts", "yyyy-MM-dd"))
    c = replay.prompt_islands(c, 2, ["user_id"], ["ts", "event_id"])
    return c.groupBy("user_id").agg(F.countDistinct("island").alias("n_islands"), F.count_if("allowed").alias("n_allowed"))


@query
def rate_limit_replay(spark: SparkSession, sf: str) -> DataFrame:
    """At most 10 calls of a user in seven days and 3 of a tool; denied calls don't count."""
    fold = lambda: replay.RateLimit(10, 7 * 86400.0, {"purchase": 3, "click": 3})
    r = replay.replay(_calls(spark, sf).select("user_id", "ts", "event_id", "tool_name"), ["user_id"], ["ts", "event_id"], fold, "denied")
    return r.groupBy("user_id", F.coalesce("denied", F.lit("allowed")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def rate_limit_global(spark: SparkSession, sf: str) -> DataFrame:
    """At most 10 calls of a user in seven days, over all tools."""
    r = replay.replay(_calls(spark, sf).select("user_id", "ts", "event_id", "tool_name"), ["user_id"], ["ts", "event_id"], lambda: replay.RateLimit(10, 7 * 86400.0), "denied")
    return r.groupBy("user_id").agg(F.count_if(F.col("denied").isNull()).alias("n_allowed"), F.count_if(F.col("denied").isNotNull()).alias("n_denied"))


@query
def loop_detection(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf).select("user_id", "ts", "event_id", "tool_name", F.date_format("ts", "yyyy-MM-dd").alias("prompt_id"))
    r = replay.replay(c, ["user_id"], ["ts", "event_id"], lambda: replay.Budget(None, 5, 3, 0.95), "denied")
    return r.groupBy("user_id", F.coalesce("denied", F.lit("allowed")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "events").select(F.col("event_type").alias("scanner"), "ts", "event_id", (F.col("event_id") % 8 == 0).alias("ok"))
    r = replay.replay(o, ["scanner"], ["ts", "event_id"], replay.Breaker, "state")
    return r.groupBy("scanner", "state").agg(F.count("*").alias("n"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a status from their length and a density from their words."""
    n = F.length("text")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "text", F.when(n % 5 == 0, "block").when(n % 3 == 0, "warn").otherwise("allow").alias("status"), ((n % 10) / 100.0).alias("density"), F.when(n % 7 == 0, 0.65).otherwise(0.1).alias("turn_risk"))


@query
def session_score_window(spark: SparkSession, sf: str) -> DataFrame:
    return turns.session_scores(_turns(spark, sf)).select("session_id", "turn_index", F.round("score", 6).alias("score"), "reframe")


@query
def session_escalation_latch(spark: SparkSession, sf: str) -> DataFrame:
    s = turns.session_scores(_turns(spark, sf))
    return s.groupBy("session_id").agg(F.count_if("latched").alias("n_latched"), F.round(F.max_by("stored_score", "turn_index"), 6).alias("last_score"))


@query
def reframe_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("b", T.word_bigrams(F.col("text")))
    return c.select("conv_id", "turn", F.round(F.coalesce(T.jaccard(F.col("b"), F.lag("b").over(w)), F.lit(0.0)), 6).alias("similarity"))


@query
def session_ttl(spark: SparkSession, sf: str) -> DataFrame:
    e = turns.split_idle(table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id"))
    return e.groupBy("session_id").agg((F.max("part") + 1).alias("n_parts"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary evidence of conversations: a user's turn is input, the system's a tool result, the assistant's a gate call."""
    n = F.length("text")
    status = F.when(n % 4 == 0, "block").when(n % 3 == 0, "warn").otherwise("allow")
    none = F.array().cast("array<string>")
    cats = F.when(n % 4 == 0, F.array(F.lit("prompt_injection"))).when(n % 3 == 0, F.array(F.lit("tool_injection"))).otherwise(none)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), F.floor(F.col("turn") / 4).alias("turn_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "input").when(F.col("role") == "assistant", "gate").otherwise("tool_result").alias("boundary"), status.alias("status"), F.when(n % 4 == 0, "high").otherwise("low").alias("severity"), cats.alias("categories"), F.when(n % 3 == 0, F.array(F.lit("catalog"), F.lit("structural"))).otherwise(F.array(F.lit("catalog"))).alias("families"), F.lit("send_mail").alias("tool_name"), (n % 2 == 0).alias("gate_allowed"))


@query
def turn_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = turns.turn_signals(_evidence(spark, sf))
    return s.select("conversation_id", "turn_id", "input_status", F.array_join("input_categories", ",").alias("input_categories"), F.size("input_families").alias("n_families"), "gate", "result_status", F.array_join("result_categories", ",").alias("result_categories"))


@query
def turn_risk(spark: SparkSession, sf: str) -> DataFrame:
    s = turns.with_turn_risk(turns.turn_signals(_evidence(spark, sf)))
    return s.select("conversation_id", "turn_id", F.round("turn_risk", 6).alias("risk"), turns.risk_block(F.coalesce("result_status", F.lit("allow")), F.col("turn_risk")).alias("final_status"))


# Audit and topology ---------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines made from events: JSON, and now and then something else."""
    e = table(spark, sf, "events")
    js = F.to_json(F.struct(F.col("event_type").alias("boundary"), F.when(F.col("value") >= 50, "deny").otherwise("allow").alias("decision"), F.col("user_id").cast("string").alias("agent_id")))
    return e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 97 == 0, "not json").otherwise(js).alias("raw"))


@query
def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Of the log's last 200 lines the denied purchases."""
    parsed = audit.read_log(_log(spark, sf), "boundary string, decision string, agent_id string")
    return audit.tail(parsed, 200, "purchase", "deny").drop("bad")


@query
def audit_decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = audit.read_log(_log(spark, sf), "boundary string, decision string, agent_id string")
    return parsed.groupBy(F.coalesce("boundary", F.lit("malformed")).alias("boundary"), F.coalesce("decision", F.lit("malformed")).alias("decision")).agg(F.count("*").alias("n"))


@query
def audit_network_join(spark: SparkSession, sf: str) -> DataFrame:
    """Gate events (views) and network events (purchases) of a user's day, which is the token; counts by user."""
    e = table(spark, sf, "events").withColumn("token_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    gates = e.filter("event_type = 'view'").groupBy("token_id").agg(F.min("event_id").alias("gate_event"))
    net = e.filter("event_type = 'purchase'").select("token_id", "value")
    return audit.join_network(gates, net).groupBy("token_id", "gate_event").agg(F.count("*").alias("n_requests"), F.round(F.sum("value"), 4).alias("bytes"))


@query
def audit_reason_truncation(spark: SparkSession, sf: str) -> DataFrame:
    r = audit.truncate_reason(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(r).alias("n_chars"), F.sha2(r, 256).alias("reason_sha256"))


@query
def audit_line_format(spark: SparkSession, sf: str) -> DataFrame:
    """Events as printed lines: with findings, reasons of three kinds, signals, views and durations."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    reason = F.when(n % 5 == 0, "argument rule violation: value").when(n % 5 == 1, "irreversible call without approval").when(n % 5 == 2, "the agent's limit")
    line = audit.line_format(
        F.col("ts"), F.col("event_type"), F.when(F.col("value") >= 50, "deny").otherwise("allow"), F.col("user_id").cast("string"), reason,
        tool=F.when(n % 2 == 0, F.col("event_type")), severity=F.lit("high"), n_findings=n % 3,
        signals=F.when(n % 7 == 0, F.array(F.lit("session_escalation"))), transforms=F.when(n % 11 == 0, F.array(F.lit("base64"), F.lit("hex"))), duration_ms=F.when(n % 4 == 0, n % 100),
    )
    return e.select("event_id", line.alias("line"))


@query
def audit_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    s = turns.with_turn_risk(turns.turn_signals(_evidence(spark, sf))).select(F.concat_ws("-", "conversation_id", "turn_id").alias("event_id"), F.coalesce("result_status", F.lit("allow")).alias("decision"), "turn_risk")
    e = audit.consolidated_events(s.select("event_id", "decision"), s, turns.RISK_HIGH)
    return e.groupBy("decision", F.coalesce("signal_source", F.lit("scan")).alias("signal_source")).agg(F.count("*").alias("n"))


@query
def attestation_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the kinds of events that each user has, and of names with quotes, line ends and letters beyond ASCII."""
    e = table(spark, sf, "events")
    odd = F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.lit('"a\\\n')).when(F.col("event_id") % 3 == 1, F.lit("é€")).otherwise(""))
    g = e.groupBy("user_id").agg(F.collect_set("event_type").alias("tools"), F.collect_set(odd).alias("odd"))
    return g.select("user_id", audit.list_digest(F.col("tools")).alias("digest"), audit.list_digest(F.col("odd")).alias("odd_digest"))


@query
def topology_edges(spark: SparkSession, sf: str) -> DataFrame:
    a = dims.agents(spark)
    return topology.graph(a.filter("sub_agent_id IS NULL"), a.filter("sub_agent_id IS NOT NULL"), dims.tools(spark), dims.sources(spark))[1]


@query
def shadow_sources(spark: SparkSession, sf: str) -> DataFrame:
    return topology.shadow_sources(dims.sources(spark)).select("url", F.array_join("names", ",").alias("names"))


@query
def tools_for_agents(spark: SparkSession, sf: str) -> DataFrame:
    return topology.tools_for(dims.agents(spark).filter("sub_agent_id IS NULL"), dims.tools(spark))


@query
def local_tool_source(spark: SparkSession, sf: str) -> DataFrame:
    reg = dims.tools(spark).select("tool_name", "tags")
    want = spark.createDataFrame([("crm", "click", None, ["crm"]), ("crm", "purchase", ["read"], ["crm"]), ("web", "view", ["read", "web"], ["web", "a"]), ("web", "gone", None, [])], "source string, tool_name string, tag_filter array<string>, source_tags array<string>")
    return topology.local_tools(reg, want).select("source", "tool_name", F.array_join("tags", ",").alias("tags"))


@query
def source_activation(spark: SparkSession, sf: str) -> DataFrame:
    declared = dims.sources(spark).select("source", "required")
    ok = spark.createDataFrame([("crm", True), ("mail", False), ("files", False)], "source string, ok boolean")
    sup = spark.createDataFrame([("web",)], "source string")
    return topology.activate_sources(declared, ok, sup)


@query
def source_resolution(spark: SparkSession, sf: str) -> DataFrame:
    claims = spark.createDataFrame([("click", "web", 2), ("click", "crm", 1), ("view", "web", 2), ("view", "files", 2)], "tool_name string, source string, priority int")
    return topology.resolve_source(dims.tools(spark).select("tool_name"), claims)


@query
def manifest_overrides(spark: SparkSession, sf: str) -> DataFrame:
    mine = spark.createDataFrame([("crm", None, "https://mine.example"), ("mail", "stdio", None)], "source string, transport string, url string")
    base = spark.createDataFrame([("crm", "http", "https://base.example"), ("mail", "http", "https://mail.example")], "source string, transport string, url string")
    return topology.with_overrides(mine, base, ["transport", "url"])


@query
def candidate_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all conversation turns."""
    zero, t = F.lit(0.0), F.col("text")
    d = table(spark, sf, "conversations").select("conv_id", "turn", candidates.fingerprint(t, detect.entropy_score(t), detect.density_score(t), zero, detect.structural_score(t)).alias("f"))
    return d.select("conv_id", "turn", "f.entropy", "f.density", "f.structural", "f.length", F.array_join("f.control_words", ",").alias("control_words"), F.array_min("f.minhash").alias("least"))


@query
def candidate_should_record(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "injection_scan").otherwise("heuristic_scan").alias("scanner"), F.when(F.col("quality") == 0, "medium").otherwise("low").alias("severity"))
    return candidates.should_record(f, "doc_id")


