"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star round over links (u, v) with u > v."""
    ways = links.select("u", "v")
    if larger:
        ways = ways.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = ways.join(lowest, "u")
    if larger:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(lowest.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where("u > v")


def _settled(links: DataFrame) -> bool:
    """Whether each node u has one link, and that to a node without one: then v is the smallest of its component."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not found.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1")).alias("n")).first().n


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Null ends and self-links are ignored; unlinked nodes have no row.  Every
    round is written to the shared folder, so a lost executor costs one round;
    the number of rounds grows with the logarithm of the longest chain.  A hub
    is never gathered: its links are only grouped with map-side minima and
    joined to one row.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct()
    now = materialise(now, "links")
    # asked before each round: no round runs only to change nothing
    while not _settled(now):
        now = materialise(_star(_star(now, True), False).distinct(), "stars")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
