"""Scans and evaluations of source code, from Python."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csharp.extract import extract, facts_of, locations_of
from .engine import QUERY_SECONDS, Scan, scan
from .facts import Facts
from .operators import evaluation
from .operators.results import reported
from .operators.review import Review, reviewed
from .shared import checkpoint
from .sinks import reports
from .sources.corpora import Units
from .sources.files import read_files


def scan_sources(spark: SparkSession, sources: DataFrame, timeout: float = QUERY_SECONDS) -> tuple[Facts, DataFrame, Scan]:
    """Facts, locations and matches of (unit, file, file_order, text)."""
    made = checkpoint(extract(sources))
    facts = Facts(facts_of(made))
    return facts, locations_of(made), scan(facts, timeout=timeout)


def scan_files(spark: SparkSession, files: list[str], how: Review | None = None, root: str = "") -> tuple[Facts, DataFrame, dict]:
    """Facts, reported matches and the JSON report of files scanned as one unit; with how, after review."""
    sources = read_files(spark, {"scan": files})
    facts, places, found = scan_sources(spark, sources)
    rows, tally = checkpoint(reported(found.matches, places)), None
    if how is not None:
        rows, tally = reviewed(rows, sources, how, root)
    report = reports.scan_report(reports.match_json(rows), len(files), found.errors)
    report["slowest"] = [{"pattern": p, "seconds": round(s, 3)} for p, s in found.slowest()]
    return facts, rows, report | ({"review": tally} if tally else {})


#: Between the corpus and the unit in the name of a scanned unit.
_MARK = "\x1f"


def evaluate(spark: SparkSession, corpora: dict[str, Units], timeout: float = QUERY_SECONDS, how: Review | None = None) -> dict:
    """A report over corpora of labelled units; corpora of one time limit are scanned in one run.

    What a corpus says of its own limit counts before `timeout`.  With how, `structural` is what queries found and
    `detected` what review left of it; metrics are those after review.
    """
    files = {f"{c}{_MARK}{u.name}": u.files for c, us in corpora.items() for u in us.units}
    corpus, unit = F.split("unit", _MARK)[0].alias("corpus"), F.col("unit")
    limits: dict[float, list[str]] = {}
    for c, us in corpora.items():
        limits.setdefault(us.query_timeout or timeout, []).append(c)
    before, after, tallies, seconds, errors = [], [], [], {}, {}
    for limit, names in limits.items():
        sources = read_files(spark, {k: v for k, v in files.items() if k.split(_MARK)[0] in names})
        _, places, found = scan_sources(spark, sources, limit)
        kept = found.matches
        before.append(evaluation.detected_sets(found.matches))
        if how is not None:
            kept, tally = reviewed(checkpoint(reported(found.matches, places)), sources, how)
            tallies.append({"unit": ", ".join(names)} | tally)
        after.append(evaluation.detected_sets(kept))
        seconds = {p: seconds.get(p, 0) + s for p, s in found.seconds.items()}
        errors |= found.errors
    structural, detected = (checkpoint(reduce(DataFrame.unionByName, x).select(corpus, unit, "pattern", "match_rows")) for x in (before, after))
    labels = [(c, f"{c}{_MARK}{u.name}", p) for c, us in corpora.items() for u in us.units for p in sorted(u.expected)]
    expected = spark.createDataFrame(labels, "corpus string, unit string, pattern string")
    counts = checkpoint(evaluation.confusion(expected, detected, spark.createDataFrame([(c,) for c in corpora], "corpus string")))
    outcomes: dict[str, dict] = {k: {"labeled": [], "structural": [], "detected": []} for k in files}
    for r in labels:
        outcomes[r[1]]["labeled"].append(r[2])
    for name, table in (("structural", structural), ("detected", detected)):
        for r in table.orderBy("unit", "pattern").toLocalIterator():
            outcomes[r.unit][name].append(r.pattern)

    def part(name: str, rows: DataFrame, units: list[str], skipped: int) -> dict:
        rated = evaluation.rated(rows).orderBy("pattern")
        metrics = ("precision", "recall", "f1")
        summed = rows.withColumn("corpus", F.lit(name))
        return {
            "corpus": name,
            "generatedAt": datetime.now(UTC).isoformat(),
            "unitCount": len(units),
            "skippedDirectories": skipped,
            "detectionSeconds": round(sum(seconds.values()), 1),
            "perPattern": [{"pattern": r.pattern, "truePositives": r.tp, "falsePositives": r.fp, "falseNegatives": r.fn, "matchRows": r.match_rows, **{m: r[m] for m in metrics if r[m] is not None}} for r in rated.toLocalIterator()],
            "macro": {m: v for r in evaluation.macro(summed, ["corpus"]).collect() for m in metrics if (v := r[m]) is not None},
            "micro": {m: v for r in evaluation.micro(summed, ["corpus"]).collect() for m in metrics if (v := r[m]) is not None},
            "errors": [f"{p}: {e}" for p, e in sorted(errors.items())],
            "slowest": [{"pattern": p, "seconds": round(x, 3)} for p, x in sorted(seconds.items(), key=lambda x: (-x[1], x[0]))[:3]],
            "units": [{"unit": u.split(_MARK)[1], **outcomes[u]} for u in units],
        }

    review = {}
    if tallies:
        types = "unit string, model string, reviewed long, confirmed long, uncertain long, rejected long, dropped long, unreviewed long, cache_hits long, tokens_in long, tokens_out long, failure string"
        rows = spark.createDataFrame([tuple(t[f.split(" ")[0]] for f in types.split(", ")) for t in tallies], types)
        review = {"review": evaluation.combined_reviews(rows, []).first().asDict()}
    parts = [part(c, counts.where(F.col("corpus") == c), [k for k in files if k.startswith(f"{c}{_MARK}")], us.skipped) | ({"commit": us.commit} if us.commit else {}) for c, us in corpora.items()]
    if len(parts) == 1:
        return parts[0] | review
    pool = evaluation.pooled(counts).where("corpus is null")
    whole = part("pooled", pool, list(files), sum(us.skipped for us in corpora.values()))
    del whole["units"]
    return whole | review | {"corpora": parts}


def analyse(spark: SparkSession, units: list[dict]) -> list[dict]:
    """What review changed, with jackknife intervals, from the unit outcomes of a report."""
    if not units:
        raise ValueError("the report has no units")
    rows = [("all", str(i), u["labeled"], u["structural"], u["detected"]) for i, u in enumerate(units)]
    table = spark.createDataFrame(rows, "corpus string, unit string, labeled array<string>, structural array<string>, detected array<string>")
    return [r.asDict() for r in evaluation.jackknife(evaluation.unit_counts(table), ["corpus"]).drop("corpus").collect()]
