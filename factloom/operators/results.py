"""From role tuples to reported matches: labels, places, ontology names, ordinals, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import label
from ..vocab import FDP, PATTERNS, ROLES, pattern_iri


def roles_table(spark: SparkSession) -> DataFrame:
    """(pattern, role, role_order, iri): all roles; iri is null where the ontology has none."""
    rows = [(p, r, i, FDP + iri if iri else None) for p in PATTERNS for i, (r, iri) in enumerate(ROLES[p].items())]
    return spark.createDataFrame(rows, "pattern string, role string, role_order int, iri string")


def patterns_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, pattern_iri(p)) for p in PATTERNS], "pattern string, pattern_iri string")


def bindings(matches: DataFrame) -> DataFrame:
    """One row for each role of each match: unit, pattern, match (its roles as text), role, role_order, fragment, label.

    Roles that are unbound are left out.
    """
    key = F.concat_ws("|", F.transform("roles", lambda r: F.concat_ws("=", r["role"], r["fragment"])))
    rows = matches.select("unit", "pattern", key.alias("match"), F.posexplode("roles").alias("role_order", "r")).where("r.fragment is not null")
    return rows.select("unit", "pattern", "match", F.col("r.role").alias("role"), "role_order", F.col("r.fragment").alias("fragment"), label(F.col("r.fragment")).alias("label"))


def with_iris(bound: DataFrame) -> DataFrame:
    """Adds iri; the role table is a constant of 72 rows."""
    roles = roles_table(bound.sparkSession).select("pattern", "role", "iri")
    return bound.join(F.broadcast(roles), ["pattern", "role"], "left")


def with_locations(bound: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds file, start_line and end_line of each fragment; null for what was not scanned."""
    places = locations.select("unit", "fragment", "file", "start_line", "end_line")
    return bound.join(places, ["unit", "fragment"], "left")


def first_locations(seen: DataFrame) -> DataFrame:
    """One place for each (unit, fragment) of (unit, fragment, file, file_order, start_line, end_line): the first seen."""
    first = F.min_by(F.struct("file", "start_line", "end_line"), F.struct("file_order", "start_line", "end_line"))
    return seen.groupBy("unit", "fragment").agg(first.alias("l")).select("unit", "fragment", "l.file", "l.start_line", "l.end_line")


def ordinals(matches: DataFrame) -> DataFrame:
    """Adds match_id: 1, 2, ... within each unit and pattern, in the order of the roles' fragments."""
    order = Window.partitionBy("unit", "pattern").orderBy(F.transform("roles", lambda r: F.coalesce(r["fragment"], F.lit(""))))
    return matches.withColumn("match_id", F.row_number().over(order).cast("long"))


def reported(matches: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Matches as reported: unit, pattern, match_id, pattern_iri, roles array<struct<role,label,fragment,iri,file,start_line,end_line>>."""
    numbered = ordinals(matches)
    rows = numbered.select("unit", "pattern", "match_id", F.posexplode("roles").alias("role_order", "r")).where("r.fragment is not null")
    rows = rows.select("unit", "pattern", "match_id", "role_order", F.col("r.role").alias("role"), F.col("r.fragment").alias("fragment"), label(F.col("r.fragment")).alias("label"))
    rows = with_iris(rows)
    if locations is None:
        none = F.lit(None)
        rows = rows.select("*", none.cast("string").alias("file"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"))
    else:
        rows = with_locations(rows, locations)
    fields = F.struct("role_order", "role", "label", "fragment", "iri", "file", "start_line", "end_line")
    # a match has as many roles as its pattern, six at the most
    grouped = rows.groupBy("unit", "pattern", "match_id").agg(F.array_sort(F.collect_list(fields)).alias("roles"))
    roles = F.transform("roles", lambda r: r.dropFields("role_order"))
    return grouped.join(F.broadcast(patterns_table(matches.sparkSession)), "pattern").select("unit", "pattern", "match_id", "pattern_iri", roles.alias("roles"))


def slowest(durations: DataFrame, by: list[str], name: str, seconds: str, most: int = 3, at_least: float = 0.0) -> DataFrame:
    """The `most` longest entries of each group that took at_least seconds; ties go to the smaller name."""
    order = Window.partitionBy(*by).orderBy(F.desc(seconds), name)
    return durations.where(F.col(seconds) >= at_least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
