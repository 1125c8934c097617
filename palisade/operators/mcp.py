"""Tool metadata: every surface of a tool's description is scanned, and a source is blocked or reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.ranks import severity_of, severity_rank
from palisade.operators.catalog import Catalog, catalog_findings

TOOL = "struct<name:string,description:string,inputSchema:struct<properties:map<string,struct<type:string,description:string>>>>"


def surfaces(tools: DataFrame) -> DataFrame:
    """(source, tool_name, surface, text): a tool's name, description, each argument's description, and, of several, all together.

    tools: source, raw (the tool as JSON).
    """
    t = tools.select("source", F.from_json("raw", TOOL).alias("t"))
    args = F.transform(F.map_entries(F.coalesce(F.col("t.inputSchema.properties"), F.create_map().cast("map<string,struct<type:string,description:string>>"))), lambda e: F.struct(F.concat(F.lit("argument:"), e["key"]).alias("surface"), e["value"]["description"].alias("text")))
    own = F.array(F.struct(F.lit("name").alias("surface"), F.col("t.name").alias("text")), F.struct(F.lit("description").alias("surface"), F.col("t.description").alias("text")))
    full = F.filter(F.concat(own, args), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    t = t.select("source", F.col("t.name").alias("tool_name"), full.alias("s"))
    joined = F.when(F.size("s") > 1, F.array(F.struct(F.lit("all").alias("surface"), F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text")))).otherwise(F.array().cast("array<struct<surface:string,text:string>>"))
    return t.select("source", "tool_name", F.explode(F.concat("s", joined)).alias("s")).select("source", "tool_name", "s.*")


def metadata_findings(tools: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Findings of each surface; the same finding on two surfaces counts twice."""
    f = surfaces(tools).select("source", "tool_name", "surface", F.explode(catalog_findings(F.array("text"), catalogs)).alias("f"))
    return f.select("source", "tool_name", "surface", "f.category", "f.severity", "f.rule")


def metadata_decision(findings: DataFrame, action: str = "block", block_at: str = "medium") -> DataFrame:
    """(source, tool_name, decision, max_severity) of tools with a finding of block_at or above: what action says."""
    g = findings.groupBy("source", "tool_name").agg(F.max(severity_rank(F.col("severity"))).alias("r"))
    return g.select("source", "tool_name", F.when(F.col("r") >= severity_rank(F.lit(block_at)), action).otherwise("allow").alias("decision"), severity_of(F.col("r")).alias("max_severity"))
