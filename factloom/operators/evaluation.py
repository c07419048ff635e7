"""Scoring: confusion counts, precision, recall and F1, pooling, baselines, jackknife intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import f1, precision, ratio, recall
from ..vocab import PATTERNS

#: The 97.5 % point of the normal distribution.
Z = 1.959964


def detected_sets(matches: DataFrame) -> DataFrame:
    """(unit, pattern, match_rows) of patterns with a match."""
    return matches.groupBy("unit", "pattern").agg(F.count(F.lit(1)).alias("match_rows"))


def confusion(expected: DataFrame, detected: DataFrame, corpora: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Counts by (corpus, pattern), with a row for every pattern of every corpus.

    expected: (corpus, unit, pattern); detected: (corpus, unit, pattern, match_rows); corpora: (corpus), the names.
    """
    spark = expected.sparkSession
    e = expected.select("corpus", "unit", "pattern").distinct().withColumn("e", F.lit(1))
    d = detected.groupBy("corpus", "unit", "pattern").agg(F.sum("match_rows").alias("match_rows")).withColumn("d", F.lit(1))
    both = e.join(d, ["corpus", "unit", "pattern"], "full_outer")
    counts = both.groupBy("corpus", "pattern").agg(
        F.count_if(F.col("e").isNotNull() & F.col("d").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull() & F.col("d").isNotNull()).alias("fp"),
        F.count_if(F.col("e").isNotNull() & F.col("d").isNull()).alias("fn"),
        F.coalesce(F.sum("match_rows"), F.lit(0)).alias("match_rows"),
    )
    # names of corpora times a constant list of patterns
    names = F.explode(F.array(*[F.lit(p) for p in patterns]))
    every = corpora.select("corpus").distinct().select("corpus", names.alias("pattern"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "match_rows")}
    return every.join(counts, ["corpus", "pattern"], "left").select("corpus", "pattern", *zero.values())


def rated(counts: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds precision, recall and f1; each is null where its denominator is 0."""
    a, b, c = F.col(tp), F.col(fp), F.col(fn)
    return counts.withColumns({"precision": precision(a, b), "recall": recall(a, c), "f1": f1(a, b, c)})


def macro(counts: DataFrame, by: list[str]) -> DataFrame:
    """Means of the defined values of each group's rows."""
    return rated(counts).groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def micro(counts: DataFrame, by: list[str]) -> DataFrame:
    """The formulas over each group's summed counts."""
    return rated(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def pooled(counts: DataFrame) -> DataFrame:
    """Counts by (corpus, pattern), and by pattern over all corpora where corpus is null."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "match_rows")]
    return counts.groupingSets([[F.col("corpus"), F.col("pattern")], [F.col("pattern")]], "corpus", "pattern").agg(*sums)


def combined_reviews(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Sums of review counters, the models' names joined, and the first failure in unit order."""
    counters = [c for c in reviews.columns if c not in (*by, "unit", "model", "failure")]
    return reviews.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in counters],
        F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"),
        F.min_by(F.when(F.col("failure").isNotNull(), F.col("failure")), F.when(F.col("failure").isNotNull(), F.col("unit"))).alias("failure"),
    )


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """current joined to a baseline by pattern: both F1, their difference, and whether it fell."""
    base = baseline.select("pattern", F.col("f1").alias("baseline_f1"))
    rows = current.select("pattern", F.col("f1").alias("current_f1")).join(base, "pattern", "left")
    fell = F.coalesce(F.col("current_f1") < F.col("baseline_f1") - tolerance, F.lit(False))
    return rows.withColumns({"delta": F.col("current_f1") - F.col("baseline_f1"), "fell": fell})


def passes_gate(current_micro: float | None, baseline_micro: float | None, tolerance: float = 1e-9) -> bool:
    """Whether a run stands against its baseline: the micro F1 alone decides."""
    if baseline_micro is None:
        return True
    return current_micro is not None and current_micro >= baseline_micro - tolerance


def unit_counts(outcomes: DataFrame) -> DataFrame:
    """(corpus, unit, labeled, structural, detected arrays) -> tp, fp, fn before and after review."""

    def counts(found: str, suffix: str):
        return {
            f"tp_{suffix}": F.size(F.array_intersect("labeled", found)).cast("long"),
            f"fp_{suffix}": F.size(F.array_except(found, "labeled")).cast("long"),
            f"fn_{suffix}": F.size(F.array_except("labeled", found)).cast("long"),
        }

    return outcomes.withColumns(counts("structural", "before") | counts("detected", "after"))


_COUNTS = [f"{k}_{s}" for k in ("tp", "fp", "fn") for s in ("before", "after")]


def before_after(counted: DataFrame, by: list[str]) -> DataFrame:
    """Summed counts and metrics of both stages for each group."""
    rows = counted.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return rows.withColumns({f"{n}_{s}": m for s in ("before", "after") for n, m in _metrics(s).items()})


def _metrics(stage: str, columns=None) -> dict:
    c = columns or F.col
    tp, fp, fn = c(f"tp_{stage}"), c(f"fp_{stage}"), c(f"fn_{stage}")
    return {"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)}


def jackknife(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, before, after, delta, lower, upper): change by review, with leave-one-unit-out intervals.

    Every metric is computed once more without each unit, as the group's sums
    less the unit's counts; units without which it is undefined are left out.
    The sums are made by a grouped aggregate and joined back, so no group is
    held by one task.  With fewer than two values the bounds are null.
    """
    sums = counted.groupBy(*by).agg(*[F.sum(c).alias(f"sum_{c}") for c in _COUNTS])
    each = counted.join(sums, by) if by else counted.crossJoin(F.broadcast(sums))
    rest = each.withColumns({f"rest_{c}": F.col(f"sum_{c}") - F.col(c) for c in _COUNTS})
    left = lambda c: F.col(f"rest_{c}")
    whole = lambda c: F.col(f"sum_{c}")
    names = ("precision", "recall", "f1")
    changes = {n: _metrics("after", left)[n] - _metrics("before", left)[n] for n in names}
    # sqrt((n - 1) / n * sum of squared deviations) = sqrt((n - 1) * population variance)
    spread = rest.groupBy(*by).agg(*[x for n in names for x in (F.count(changes[n]).alias(f"n_{n}"), F.var_pop(changes[n]).alias(f"v_{n}"))])
    totals = sums.select(*by, *[x for n in names for x in (_metrics("before", whole)[n].alias(f"before_{n}"), _metrics("after", whole)[n].alias(f"after_{n}"))])
    joined = totals.join(spread, by) if by else totals.crossJoin(F.broadcast(spread))
    rows = joined.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"before_{n}").alias("before"), F.col(f"after_{n}").alias("after"), F.col(f"n_{n}").alias("n"), F.col(f"v_{n}").alias("v")) for n in names])).alias("r")).select(*by, "r.*")
    delta = F.col("after") - F.col("before")
    error = F.when(F.col("n") >= 2, F.sqrt((F.col("n") - 1) * F.col("v")))
    return rows.select(*by, "metric", "before", "after", delta.alias("delta"), (delta - Z * error).alias("lower"), (delta + Z * error).alias("upper"))


def slow_units(durations: DataFrame, unit_seconds: float = 10.0, detector_seconds: float = 1.0, most: int = 3) -> DataFrame:
    """(unit, pattern, seconds): of units that took unit_seconds in all, the longest detectors of detector_seconds or more."""
    from .results import slowest

    # rounded, so that the order of a sum doesn't decide
    slow = durations.groupBy("unit").agg(F.round(F.sum("seconds"), 6).alias("total")).where(F.col("total") >= unit_seconds).select("unit")
    return slowest(durations.join(slow, "unit", "left_semi"), ["unit"], "pattern", "seconds", most, detector_seconds)


__all__ = [n for n in dir() if not n.startswith("_")] + ["ratio"]
