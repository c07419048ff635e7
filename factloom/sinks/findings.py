"""Matches as RDF findings: a scan, its occurrences, and their role bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _triple(s: Column, p: str, o: Column, kind: str = "iri") -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind"))


def occurrence_triples(reported: DataFrame) -> DataFrame:
    """(unit, s, p, o, kind) of reported matches; kind: iri, string, integer, anyURI.  Types are described once."""
    named = F.when(F.col("pattern_iri").isNotNull(), F.element_at(F.split("pattern_iri", "#"), -1)).otherwise(F.regexp_replace("pattern", "[^\\p{L}\\p{Nd}]", ""))
    occ = F.concat(F.lit("occurrence-"), named, F.lit("-"), F.col("match_id").cast("string"))
    rows = reported.withColumn("occ", occ)
    verdict = "verdict" in reported.columns
    heads = [
        _triple(F.lit("scan"), "hasOccurrence", F.col("occ")),
        _triple(F.col("occ"), "type", F.lit("PatternOccurrence")),
        _triple(F.col("occ"), "patternName", F.col("pattern"), "string"),
        _triple(F.col("occ"), "pattern", F.col("pattern_iri")),
    ]
    if verdict:
        heads += [_triple(F.col("occ"), p, F.col(f"verdict.{c}"), "string") for p, c in (("verdict", "outcome"), ("rationale", "rationale"), ("reviewedBy", "model"))]
    first = rows.select("unit", F.explode(F.array(*heads)).alias("t"))
    roles = rows.select("unit", "occ", F.explode("roles").alias("r")).withColumn("b", F.concat("occ", F.lit("-"), "r.role"))
    parts = [
        _triple(F.col("occ"), "hasRole", F.col("b")),
        _triple(F.col("b"), "type", F.lit("RoleBinding")),
        _triple(F.col("b"), "role", F.col("r.role"), "string"),
        _triple(F.col("b"), "playsRole", F.col("r.iri")),
        _triple(F.col("b"), "filledBy", F.col("r.fragment")),
        _triple(F.col("r.fragment"), "label", F.when(F.col("r.fragment").isNotNull(), F.col("r.label")), "string"),
        _triple(F.col("r.fragment"), "declaredIn", F.when(F.col("r.file").isNotNull(), F.concat(F.lit("file://"), "r.file")), "anyURI"),
        _triple(F.col("r.fragment"), "startLine", F.col("r.start_line"), "integer"),
        _triple(F.col("r.fragment"), "endLine", F.col("r.end_line"), "integer"),
    ]
    second = roles.select("unit", F.explode(F.array(*parts)).alias("t"))
    return first.union(second).select("unit", "t.*").where("s is not null and o is not null").distinct()


def scan_triples(reported: DataFrame, tool: str, files: DataFrame) -> DataFrame:
    """occurrence_triples and the scan's own: files is (unit, file_count)."""
    own = files.select("unit", F.explode(F.array(_triple(F.lit("scan"), "type", F.lit("Scan")), _triple(F.lit("scan"), "tool", F.lit(tool), "string"), _triple(F.lit("scan"), "fileCount", F.col("file_count"), "integer"), _triple(F.lit("scan"), "created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "dateTime"))).alias("t"))
    return own.select("unit", "t.*").union(occurrence_triples(reported))


def turtle(triples: DataFrame) -> DataFrame:
    """(unit, s, turtle) blocks."""
    from ..vocab import DCTERMS, DET, RDFS, SCAN, XSD

    escaped = F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    term = F.col("o").isin("Scan", "PatternOccurrence", "RoleBinding")
    iri = F.when(F.contains("o", F.lit("://")), F.concat(F.lit("<"), "o", F.lit(">"))).when(term, F.concat(F.lit(f"<{DET}"), "o", F.lit(">"))).otherwise(F.concat(F.lit(f"<{SCAN}"), "o", F.lit(">")))
    value = F.when(F.col("kind") == "iri", iri).when(F.col("kind") == "string", F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit('"'), escaped, F.lit(f'"^^<{XSD}'), "kind", F.lit(">")))
    verb = F.when(F.col("p") == "type", F.lit("a")).when(F.col("p") == "label", F.lit(f"<{RDFS}label>")).when(F.col("p") == "created", F.lit(f"<{DCTERMS}created>")).otherwise(F.concat(F.lit(f"<{DET}"), "p", F.lit(">")))
    rows = triples.select("unit", "s", F.concat(verb, F.lit(" "), value).alias("line")).groupBy("unit", "s").agg(F.array_join(F.array_sort(F.collect_set("line")), " ;\n    ").alias("lines"))
    return rows.select("unit", "s", F.concat(F.lit(f"<{SCAN}"), "s", F.lit("> "), "lines", F.lit(" .")).alias("turtle"))
