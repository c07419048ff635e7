"""Scans: all queries over a fact table, one failing query never costing the others."""

from __future__ import annotations

import logging
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .facts import Facts
from .operators.detectors import DETECTORS, matches
from .shared import checkpoint

log = logging.getLogger("factloom")

#: Seconds that one query may take.
QUERY_SECONDS = 50.0

MATCH_SCHEMA = "unit string, pattern string, roles array<struct<role:string,fragment:string>>"


@dataclass
class Scan:
    """matches (unit, pattern, roles); seconds and errors by pattern."""

    matches: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def slowest(self, most: int = 3) -> list[tuple[str, float]]:
        return sorted(self.seconds.items(), key=lambda x: (-x[1], x[0]))[:most]


def scan(facts: Facts, patterns: list[str] | None = None, *, timeout: float | None = QUERY_SECONDS, at_once: int = 4) -> Scan:
    """Run the named queries (all, in name order, by default), each as a job of its own.

    Results go to the checkpoint folder.  A query that fails or takes longer
    than `timeout` seconds (None: no limit) is cancelled, reported and has no matches.
    """
    spark = facts.table.sparkSession
    facts.settle()
    names = sorted(DETECTORS) if patterns is None else patterns
    seconds, errors, tables = {}, {}, {}

    def one(pattern: str) -> None:
        tag, began = f"factloom-{pattern.replace(' ', '-')}-{id(facts)}", time.monotonic()
        late = threading.Event()

        def stop():
            late.set()
            spark.interruptTag(tag)

        timer = threading.Timer(timeout or 0, stop)
        timer.daemon = True
        if timeout is not None:
            timer.start()
        spark.addTag(tag)
        try:
            tables[pattern] = checkpoint(matches(facts, pattern))
        except Exception as e:
            errors[pattern] = f"stopped after {timeout:g} s" if late.is_set() else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            log.warning("%s: %s", pattern, errors[pattern])
        finally:
            timer.cancel()
            spark.removeTag(tag)
            seconds[pattern] = time.monotonic() - began

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, names))
    found = [tables[p] for p in names if p in tables]
    return Scan(reduce(DataFrame.unionByName, found) if found else _empty(spark), seconds, errors)


def complete(facts: Facts) -> DataFrame:
    """Matches of all queries without a time limit; raises if any query failed."""
    found = scan(facts, timeout=None)
    if found.errors:
        raise RuntimeError("; ".join(f"{p}: {e}" for p, e in sorted(found.errors.items())))
    return found.matches


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MATCH_SCHEMA)
