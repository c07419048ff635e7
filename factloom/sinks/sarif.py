"""Matches as SARIF 2.1.0."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import PATTERNS, pattern_key

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def results(reported: DataFrame) -> DataFrame:
    """(unit, pattern, match_id, result): a SARIF result object of each match, as JSON without nulls.

    The first role with a place is the result's location, the others with one are related.
    """
    said = F.transform("roles", lambda r: F.concat(r["role"], F.lit(" = "), r["label"]))
    text = F.concat("pattern", F.lit(": "), F.array_join(said, ", "))
    outcome = rationale = model = F.lit(None).cast("string")
    if "verdict" in reported.columns:
        outcome, rationale, model = (F.col(f"verdict.{c}") for c in ("outcome", "rationale", "model"))
        text = F.when(outcome.isNull(), text).otherwise(F.concat(text, F.lit(" ["), outcome, F.lit(": "), F.coalesce(rationale, F.lit("")), F.lit("]")))
    place = lambda r: F.struct(
        F.struct(F.struct(F.concat(F.lit("file://"), r["file"]).alias("uri")).alias("artifactLocation"), F.struct(r["start_line"].alias("startLine"), r["end_line"].alias("endLine")).alias("region")).alias("physicalLocation"),
        F.struct(F.concat(r["role"], F.lit(" = "), r["label"]).alias("text")).alias("message"),
    )
    spanned = F.transform(F.filter("roles", lambda r: r["file"].isNotNull()), place)
    iris = F.map_from_entries(F.transform(F.filter("roles", lambda r: r["iri"].isNotNull()), lambda r: F.struct(r["role"], r["iri"])))
    rules = F.create_map(*[F.lit(x) for k, p in enumerate(PATTERNS) for x in (p, k)])
    some = F.size(F.map_keys(iris)) > 0
    body = F.struct(
        F.regexp_replace("pattern", "[^\\p{L}\\p{Nd}]", "").alias("ruleId"),
        F.element_at(rules, F.col("pattern")).alias("ruleIndex"),
        F.lit("note").alias("level"),
        F.struct(text.alias("text")).alias("message"),
        F.when(F.size(spanned) > 0, F.slice(spanned, 1, 1)).alias("locations"),
        F.when(F.size(spanned) > 1, F.slice(spanned, 2, 100)).alias("relatedLocations"),
        F.when(outcome.isNotNull() | some, F.struct(outcome.alias("verdict"), rationale.alias("rationale"), model.alias("reviewedBy"), F.when(some, iris).alias("fdpRoles"))).alias("properties"),
    )
    return reported.select("unit", "pattern", "match_id", F.to_json(body).alias("result"))


def envelope(found: list[str], tool: str, version: str) -> str:
    """A whole log of result objects (one report's matches, on the driver as a file is)."""
    rules = [{"id": pattern_key(p), "name": p, "shortDescription": {"text": f"{p} design pattern"}} for p in PATTERNS]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": [json.loads(x) for x in found]}
    return json.dumps({"$schema": SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2)
