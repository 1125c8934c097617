"""Tools, sources and agents as tables: activation, resolution, merging, the topology graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import redact_url


def tag_list(tags: Column) -> Column:
    """Tags sorted, each once."""
    return F.array_sort(F.array_distinct(tags))


def local_tools(registry: DataFrame, wanted: DataFrame, source_tags: DataFrame | None = None) -> DataFrame:
    """Registered tools that a source names (missing names are skipped) and, with a tag filter, whose tags are all in it; tags get the source's.

    registry: tool_name, tags. wanted: source, tool_name, tag_filter ARRAY (null: none), source_tags ARRAY.
    """
    j = wanted.join(registry, "tool_name").filter(F.col("tag_filter").isNull() | (F.size(F.array_except("tags", "tag_filter")) == 0))
    return j.select("source", "tool_name", tag_list(F.array_union("tags", "source_tags")).alias("tags"))


def mcp_tools(listing: DataFrame, source: str, source_tags: list[str], spec_tags: DataFrame) -> DataFrame:
    """Tools of a tools/list answer (line JSON with result.tools); blank names are skipped; tags: source, spec and "mcp"."""
    t = listing.select(F.explode(F.from_json("raw", "result struct<tools:array<struct<name:string,description:string>>>")["result"]["tools"]).alias("t")).select("t.*")
    t = t.filter(F.trim(F.coalesce("name", F.lit(""))) != "").join(spec_tags, F.col("name") == F.col("tool_name"), "left")
    return t.select(F.lit(source).alias("source"), F.col("name").alias("tool_name"), "description", tag_list(F.concat(F.coalesce("spec", F.array().cast("array<string>")), F.array(*map(F.lit, [*source_tags, "mcp"])))).alias("tags"))


def activate_sources(declared: DataFrame, available: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Adds state: active, skipped (optional and missing or failed), suppressed (by policy) or error (required and missing or failed)."""
    d = declared.join(available.select(F.col("source"), F.col("ok")), "source", "left").join(suppressed.select("source", F.lit(True).alias("sup")), "source", "left")
    return d.withColumn("state", F.when(F.col("sup"), "suppressed").when(F.coalesce("ok", F.lit(False)), "active").when(F.col("required"), "error").otherwise("skipped")).drop("ok", "sup")


def resolve_source(tools: DataFrame, claims: DataFrame) -> DataFrame:
    """For each tool the source of the best claim: manifest (0), named (1), open source (2), else "local". claims: tool_name, source, priority."""
    best = claims.groupBy("tool_name").agg(F.min_by("source", F.struct("priority", "source")).alias("source"))
    return tools.join(best, "tool_name", "left").withColumn("source", F.coalesce("source", F.lit("local")))


def with_overrides(declared: DataFrame, manifests: DataFrame, fields: list[str], key: str = "source") -> DataFrame:
    """declared over its manifest: a field that the operator wrote wins, an unwritten (null) one comes from the manifest."""
    m = manifests.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return declared.join(m, key, "left").select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def toxic_tags(profiles: DataFrame, combos: list[list[str]]) -> DataFrame:
    """(agent_id, combo) of tag combinations that a profile's allowed tags contain whole."""
    listed = F.array(*[F.array(*map(F.lit, sorted(c))) for c in combos])
    e = profiles.select("agent_id", "allowed_tags", F.explode(listed).alias("c")).filter(F.size(F.array_except("c", "allowed_tags")) == 0)
    return e.select("agent_id", F.array_join("c", "+").alias("combo"))


def shadow_sources(sources: DataFrame) -> DataFrame:
    """Urls, without credentials and queries, that more than one source uses, with the sources' names."""
    g = sources.filter("url IS NOT NULL").groupBy(redact_url(F.col("url")).alias("url")).agg(F.array_sort(F.collect_set("source")).alias("names"))
    return g.filter(F.size("names") > 1)


def tools_for(agents: DataFrame, tools: DataFrame) -> DataFrame:
    """(agent_id, tool_name) that a profile may call by names and tags."""
    named = agents.select("agent_id", "allowed_tags", F.explode("allowed_tool_names").alias("tool_name")).join(tools, "tool_name")
    return named.filter(F.size(F.array_except("tags", "allowed_tags")) == 0).select("agent_id", "tool_name")


def graph(agents: DataFrame, sub_agents: DataFrame, tools: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, label) and edges (from, to, type): agent delegates to sub-agent and uses tool, source provides tool."""
    node = lambda d, c, kind: d.select(F.concat(F.lit(f"{kind}:"), F.col(c)).alias("id"), F.lit(kind).alias("type"), F.col(c).alias("label")).distinct()
    nodes = node(agents, "agent_id", "agent").unionByName(node(sub_agents, "sub_agent_id", "subagent")).unionByName(node(tools, "tool_name", "tool")).unionByName(node(sources, "source", "source"))
    uses = tools_for(agents, tools).select(F.concat(F.lit("agent:"), F.col("agent_id")).alias("from"), F.concat(F.lit("tool:"), F.col("tool_name")).alias("to"), F.lit("uses").alias("type"))
    kids = sub_agents.select(F.concat(F.lit("agent:"), F.col("agent_id")).alias("from"), F.concat(F.lit("subagent:"), F.col("sub_agent_id")).alias("to"), F.lit("delegates").alias("type"))
    gives = tools.filter("source IS NOT NULL").select(F.concat(F.lit("source:"), F.col("source")).alias("from"), F.concat(F.lit("tool:"), F.col("tool_name")).alias("to"), F.lit("provides").alias("type"))
    return nodes, uses.unionByName(kids).unionByName(gives)


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of DOT, in order; for topologies, which are small."""
    n = nodes.select(F.lit(1).alias("k"), F.format_string('  "%s" [label="%s"];', "id", "label").alias("line"))
    e = edges.select(F.lit(2).alias("k"), F.format_string('  "%s" -> "%s" [label="%s"];', "from", "to", "type").alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph topology {"), (3, "}")], "k int, line string")
    return n.unionByName(e).unionByName(ends).orderBy("k", "line")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one JSON text, {"nodes": [{id, type, label}], "edges": [{from, to, type}]}, both sorted; for topologies, which are small."""
    rows = lambda d: d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias("x"))
    both = rows(nodes).select(F.col("x").alias("nodes")).crossJoin(rows(edges).select(F.col("x").alias("edges")))  # of one row each
    return both.select(F.to_json(F.struct("nodes", "edges")).alias("graph"))
