"""The fact table and its views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.algebra import closure, join
from .shared import by_unit

SCHEMA = "unit string, s string, p string, o string"


class Facts:
    """Views over facts (unit, s, p, o), a set.

    The table is partitioned by unit once and kept (memory, then disk); all
    views, joins and distincts run within those partitions.  Where a unit has
    more than MOST_FACTS facts, one task can't hold it: then the table is
    partitioned by unit and subject, and each join is dealt by all its keys.
    """

    #: Facts of a unit that one task may hold.
    MOST_FACTS = 2_000_000

    def __init__(self, table: DataFrame, partitions: int | None = None, keep: bool = True, spread: bool | None = None):
        spark = self._session = table.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = table.select("unit", "s", "p", "o").where("unit is not null and s is not null and p is not null and o is not null")
        self._keep = keep
        if spread is None:
            largest = table.groupBy("unit").count().agg(F.max("count")).first()[0]
            spread = (largest or 0) > self.MOST_FACTS
        self.spread = spread
        self.settle()
        table = table.repartition(n, "unit", "s") if spread else table.repartition(n, "unit")
        self.table = self._kept(table.dropDuplicates(["unit", "s", "p", "o"]))

    def settle(self) -> None:
        """Sets the session to join these facts: within units, or dealt by all keys."""
        by_unit(self._session, not self.spread)

    def rel(self, predicate: str | tuple[str, ...], a: str, b: str) -> DataFrame:
        """Bindings of a and b over one predicate, or over any of several (an alternative path)."""
        names = (predicate,) if isinstance(predicate, str) else predicate
        rows = self.table.where(F.col("p").isin(*names) if len(names) > 1 else F.col("p") == names[0])
        if a == b:
            return rows.where("s = o").select("unit", F.col("s").alias(a))
        rows = rows.select("unit", F.col("s").alias(a), F.col("o").alias(b))
        return rows.distinct() if len(names) > 1 else rows

    def having(self, predicate: str, a: str, *values: str) -> DataFrame:
        """Nodes a with one of the values."""
        rows = self.table.where((F.col("p") == predicate) & F.col("o").isin(*values)).select("unit", F.col("s").alias(a))
        return rows.distinct() if len(values) > 1 else rows

    def kind(self, n: str, *kinds: str) -> DataFrame:
        return self.having("type", n, *kinds)

    def mod(self, n: str, *modifiers: str) -> DataFrame:
        return self.having("hasModifier", n, *modifiers)

    def ext(self, c: str, b: str) -> DataFrame:
        return self.rel("extends", c, b)

    def meth(self, t: str, m: str) -> DataFrame:
        return self.rel("hasMethod", t, m)

    def fld(self, t: str, m: str) -> DataFrame:
        return self.rel("hasField", t, m)

    def prop(self, t: str, m: str) -> DataFrame:
        return self.rel("hasProperty", t, m)

    def slot(self, t: str, m: str) -> DataFrame:
        return self.rel(("hasField", "hasProperty"), t, m)

    def operation(self, t: str, m: str) -> DataFrame:
        return self.rel(("hasMethod", "hasProperty"), t, m)

    def ctor(self, t: str, m: str) -> DataFrame:
        return self.rel("hasConstructor", t, m)

    def ret(self, m: str, t: str) -> DataFrame:
        return self.rel("returnsType", m, t)

    def par(self, m: str, t: str) -> DataFrame:
        return self.rel("hasParameterType", m, t)

    def targ(self, m: str, t: str) -> DataFrame:
        return self.rel("hasTypeArgument", m, t)

    def inst(self, m: str, t: str) -> DataFrame:
        return self.rel("instantiates", m, t)

    def inv(self, m: str, t: str) -> DataFrame:
        return self.rel("invokes", m, t)

    def calls(self, m: str, n: str) -> DataFrame:
        return self.rel("calls", m, n)

    def dele(self, m: str, f: str) -> DataFrame:
        return self.rel("delegatesTo", m, f)

    def asg(self, m: str, f: str) -> DataFrame:
        return self.rel("assignsField", m, f)

    def method_with(self, t: str, m: str, *modifiers: str) -> DataFrame:
        """Methods m of t with one of the modifiers."""
        return join(self.meth(t, m), self.mod(m, *modifiers))

    # Views that most queries share are kept beside the facts, in the same partitions: a query's plan stays short,
    # and with it the number of sorts that one task must hold at once.

    def _kept(self, view: DataFrame) -> DataFrame:
        return view.persist() if self._keep else view

    @cached_property
    def _abstract(self) -> DataFrame:
        return self._kept(join(self.method_with("t", "m", "Abstract"), self.ret("m", "r")).select("unit", "t", "r").distinct())

    @cached_property
    def _overrides(self) -> DataFrame:
        return self._kept(join(self.method_with("t", "m", "Override"), self.ret("m", "r")).select("unit", "t", "m", "r"))

    @cached_property
    def _conform(self) -> DataFrame:
        pairs = self._overrides.select("unit", F.col("t").alias("i"), "r").distinct()
        return self._kept(join(self.abstract_op("b", "r"), self.ext("i", "b"), pairs).select("unit", "b", "i", "r"))

    def abstract_op(self, t: str, r: str) -> DataFrame:
        """Types t with an abstract method that returns r."""
        return self._abstract.select("unit", F.col("t").alias(t), F.col("r").alias(r))

    def overrides(self, t: str, o: str, r: str) -> DataFrame:
        """Overriding methods o of t, with what they return."""
        return self._overrides.select("unit", F.col("t").alias(t), F.col("m").alias(o), F.col("r").alias(r))

    def overriding(self, t: str, r: str) -> DataFrame:
        """Types t with an overriding method that returns r."""
        return self._overrides.select("unit", F.col("t").alias(t), F.col("r").alias(r)).distinct()

    def conform(self, b: str, i: str, r: str) -> DataFrame:
        """Types i that extend b and override, by return type r, an abstract method of b."""
        return self._conform.select("unit", F.col("b").alias(b), F.col("i").alias(i), F.col("r").alias(r))

    def conforming(self, b: str, i: str) -> DataFrame:
        return self.conform(b, i, "_r").select("unit", b, i).distinct()

    @cached_property
    def _reach(self) -> DataFrame:
        return closure(self.ext("c", "b"), "c", "b")

    def reach(self, c: str, b: str) -> DataFrame:
        """c extends b over one step or more."""
        return self._reach.select("unit", F.col("c").alias(c), F.col("b").alias(b))

    def same_or_ext(self, c: str, b: str) -> DataFrame:
        """c is b, or extends it in one step; over all types that are extended or created."""
        nodes = self.table.where("p in ('extends', 'instantiates')").select("unit", "o").distinct()
        return self.ext(c, b).union(nodes.select("unit", F.col("o").alias(c), F.col("o").alias(b))).distinct()
