"""Graph-pattern algebra as DataFrame operations.

A table of bindings is a DataFrame with a column `unit` and one column for each
variable.  Tables are joined on `unit` and the variables they share, so facts of
one unit never meet those of another, and a fact table partitioned by unit needs
no further exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(*tables: DataFrame) -> DataFrame:
    """Natural join, left to right."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), tables)


def _conditioned(left: DataFrame, right: DataFrame, how: str, where: str | None) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if where is None:
        return left.join(right, shared, how)
    other = right.select(*[F.col(c).alias(f"__{c}" if c in shared else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in shared])
    return left.join(other, same & F.expr(where), how)


def without(left: DataFrame, right: DataFrame, where: str | None = None) -> DataFrame:
    """Rows of left for which no row of right agrees on the shared variables (and the condition): NOT EXISTS."""
    return _conditioned(left, right, "left_anti", where)


def having(left: DataFrame, right: DataFrame, where: str | None = None) -> DataFrame:
    """Rows of left for which some row of right agrees on the shared variables (and the condition): EXISTS."""
    return _conditioned(left, right, "left_semi", where)


def union(*tables: DataFrame) -> DataFrame:
    """Bag union by variable name; a variable that a branch lacks is unbound (null) there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the shared variables."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that agree with no row of right; unlike NOT EXISTS nothing goes if no variable is shared."""
    shared = [c for c in left.columns if c in right.columns and c != "unit"]
    return left.join(right, ["unit", *shared], "left_anti") if shared else left


def pair(table: DataFrame, variable: str, first: str, second: str) -> DataFrame:
    """Unordered pairs of a variable's values with everything else equal, each once: first < second."""
    a, b = table.withColumnRenamed(variable, first), table.withColumnRenamed(variable, second)
    return join(a, b).where(F.col(first) < F.col(second))


def closure(edges: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """Pairs (unit, a, b) with a path of one edge or more: set semantics, safe on cycles.

    Paths double every round, so a chain of n edges takes log2(n) rounds.  Each
    round is written to the checkpoint folder, which cuts the growing plan and
    keeps it where a lost executor can't take it.
    """
    from ..shared import checkpoint

    paths = checkpoint(edges.select("unit", a, b).distinct())
    size = paths.count()
    for _ in range(most_rounds):
        step = paths.select("unit", F.col(a).alias("_m"), F.col(b).alias("_b"))
        longer = paths.withColumnRenamed(b, "_m").join(step, ["unit", "_m"]).select("unit", a, F.col("_b").alias(b))
        paths = checkpoint(paths.union(longer).distinct())
        now = paths.count()
        if now == size:
            return paths
        size = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
