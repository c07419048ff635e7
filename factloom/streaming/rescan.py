"""Incremental scans: a stream of changed sources rescans the units it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..csharp.extract import extract, facts_of
from ..facts import Facts
from ..operators.detectors import detect


def rescans(sources: DataFrame, target: str, checkpoint: str, patterns: list[str] | None = None, **trigger):
    """Start a query over a stream of whole units (unit, file, file_order, text).

    Each micro-batch scans its units and writes their matches under
    target/batch=<id>, so a batch that is run again replaces its own rows; the
    latest batch of a unit holds its present matches (`latest`).
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = facts_of(extract(rows))
        facts = Facts(found)
        scanned = rows.select("unit").distinct()
        matches = detect(facts, patterns)
        scanned.join(matches, "unit", "left").write.mode("overwrite").parquet(f"{target}/batch={number}")
        facts.table.unpersist()

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(written: DataFrame) -> DataFrame:
    """Present matches of a target written by `rescans`: those of each unit's last batch."""
    last = written.groupBy("unit").agg(F.max("batch").alias("batch"))
    return written.join(last, ["unit", "batch"], "left_semi").where("pattern is not null").drop("batch")
