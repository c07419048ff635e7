"""Column functions for names, identities and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import PATTERNS


def letters(x: Column) -> Column:
    """Lower-cased letters of a name; what is left of spelling."""
    return F.lower(F.regexp_replace(x, "[^\\p{L}]", ""))


def pattern_of(x: Column) -> Column:
    """The pattern that a name spells, whatever its case and separators; null if none."""
    table = F.create_map(*[F.lit(v) for p in PATTERNS for v in (p.replace(" ", "").lower(), p)])
    return F.try_element_at(table, letters(x))


def pattern_of_dotted(x: Column) -> Column:
    """The pattern of the first dotted segment that spells one."""
    return F.get(F.filter(F.transform(F.split(x, "[.]"), pattern_of), lambda p: p.isNotNull()), F.lit(0))


def label(fragment: Column) -> Column:
    """What is shown of a node: its fragment behind the last dot."""
    return F.element_at(F.split(fragment, "[.]"), -1)


def sanitised(x: Column) -> Column:
    """A node name: every character but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(x, "[^\\p{L}\\p{Nd}_]", "_")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)
