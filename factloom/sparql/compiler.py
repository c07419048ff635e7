"""Syntax trees to DataFrames.

A query runs in every unit by itself: bindings carry `unit`, joins are natural
joins on it and the shared variables, and solution modifiers (grouping, order,
limits) work within each unit, as they would on one graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators.algebra import closure
from .parser import NAMESPACES, Query, SparqlError, parse


@dataclass
class Result:
    """form: select, ask, construct or describe; variables: of a select; table: unit and what the form gives.

    ask: (unit, answer), for each unit; construct and describe: (unit, s, p, o).
    """

    form: str
    variables: list[str]
    table: DataFrame


def query(facts: Facts, text: str, namespaces: tuple[str, ...] = ()) -> Result:
    """Compile a query over facts; nothing runs until the table is read.

    namespaces: further ones whose terms name nodes and predicates, for queries written for another vocabulary.
    """
    return Compiler(facts).run(parse(text, (*NAMESPACES, *namespaces)))


def _agree(a: Column, b: Column, loose: bool) -> Column:
    return a.isNull() | b.isNull() | (a == b) if loose else a == b


class Bindings:
    """A table of bindings and which of its variables may be unbound."""

    def __init__(self, table: DataFrame, loose: frozenset = frozenset()):
        self.table, self.loose = table, loose

    @property
    def names(self) -> list[str]:
        return [c for c in self.table.columns if c != "unit"]

    def join(self, other: "Bindings", how: str = "inner") -> "Bindings":
        shared = [c for c in self.names if c in other.names]
        loose = self.loose | other.loose
        if not any(c in loose for c in shared):
            table = self.table.join(other.table, ["unit", *shared], how)
        else:  # an unbound variable agrees with any value
            right = other.table.select(*[F.col(c).alias(f"__{c}" if c in ("unit", *shared) else c) for c in other.table.columns])
            same = reduce(lambda x, y: x & y, [F.col("unit") == F.col("__unit"), *[_agree(F.col(c), F.col(f"__{c}"), c in loose) for c in shared]])
            table = self.table.join(right, same, how)
            if how in ("inner", "left"):
                table = table.withColumns({c: F.coalesce(c, f"__{c}") for c in shared if c in loose}).drop("__unit", *[f"__{c}" for c in shared])
        if how == "left":
            loose = loose | {c for c in other.names if c not in self.names}
        if how in ("left_semi", "left_anti"):
            loose = self.loose
        return Bindings(table, frozenset(loose))


class Compiler:
    def __init__(self, facts: Facts):
        self.facts, self.flags = facts, 0

    def units(self) -> Bindings:
        return Bindings(self.facts.table.select("unit").distinct())

    # forms

    def run(self, q: Query) -> Result:
        if q.form == "select":
            table, names = self.select(q)
            return Result("select", names, table)
        if q.form == "ask":
            found = self.group(q.where, self.units()).table.select("unit").distinct().withColumn("_f", F.lit(True))
            table = self.units().table.join(found, "unit", "left").select("unit", F.coalesce("_f", F.lit(False)).alias("answer"))
            return Result("ask", [], table)
        if q.form == "construct":
            rows = self.group(q.where, self.units())
            parts = [rows.table.select("unit", *[self._built(t, rows).alias(c) for t, c in zip(triple[1:], "spo")]) for triple in q.template]
            if not parts:
                raise SparqlError("CONSTRUCT has no template")
            return Result("construct", [], reduce(DataFrame.union, parts).dropna().distinct())
        rows = self.group(q.where, self.units())
        subjects = []
        for t in q.targets:
            for name in rows.names if t[0] == "all" else [t[1]]:
                column = F.lit(name) if t[0] == "iri" else F.col(name)
                subjects.append(rows.table.select("unit", column.alias("s")))
        found = reduce(DataFrame.union, subjects).dropna().distinct()
        return Result("describe", [], self.facts.table.join(found, ["unit", "s"], "left_semi").select("unit", "s", "p", "o"))

    def _built(self, term: tuple, rows: Bindings) -> Column:
        if term[0] == "pred":
            return F.lit(term[1])
        if term[0] == "var":
            return F.col(term[1]).cast("string") if term[1] in rows.names else F.lit(None).cast("string")
        return F.lit(str(term[1]))

    def select(self, q: Query) -> tuple[DataFrame, list[str]]:
        rows = self.group(q.where, self.units())
        aggregates = q.group_by or any(e is not None and _has_aggregate(e) for _, e in q.items or []) or any(_has_aggregate(e) for e in q.having)
        if aggregates:
            rows, items = self.aggregate(q, rows)
        else:
            names = q.items if q.items is not None else [(n, None) for n in rows.names if not n.startswith("_")]
            extra = {}
            for name, e in names:
                if e is not None:
                    extra[name] = self.expression(e, rows, extra)
                elif name not in rows.names:
                    extra[name] = F.lit(None).cast("string")
            rows = Bindings(rows.table.withColumns(extra), rows.loose) if extra else rows
            items = [n for n, _ in names]
        table = rows.table
        order = []
        for k, (e, up) in enumerate(q.order):
            table = table.withColumn(f"_o{k}", self.expression(e, rows, {}))
            order.append(F.col(f"_o{k}").asc_nulls_first() if up else F.col(f"_o{k}").desc_nulls_last())
        if q.distinct:
            table = table.dropDuplicates(["unit", *items]) if order else table.select("unit", *items).distinct()
        if q.limit is not None or q.offset:
            # ties are ordered by all selected values, so that a limit always takes the same rows
            place = F.row_number().over(Window.partitionBy("unit").orderBy(*order, *[F.col(c) for c in items]))
            table = table.withColumn("_place", place).where(F.col("_place") > q.offset)
            if q.limit is not None:
                table = table.where(F.col("_place") <= q.offset + q.limit)
        if order:
            table = table.orderBy("unit", *order)
        return table.select("unit", *items), items

    def aggregate(self, q: Query, rows: Bindings) -> tuple[Bindings, list[str]]:
        keys, table, names = [], rows.table, []
        for k, (name, e) in enumerate(q.group_by):
            name = name or f"_g{k}"
            if e != ("var", name):
                table = table.withColumn(name, self.expression(e, rows, {}))
            keys.append(name)
        rows = Bindings(table, rows.loose)
        found: dict[tuple, str] = {}

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                key = repr(e)
                found.setdefault((key,), (f"_a{len(found)}", e))
                return ("var", found[(key,)][0])
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            if isinstance(e, list):
                return [lift(x) for x in e]
            return e

        items = [(n, lift(e) if e is not None else None) for n, e in (q.items or [(k, None) for k in keys])]
        having = [lift(e) for e in q.having]
        q.order = [(lift(e), up) for e, up in q.order]
        made = [self._aggregate(e, rows).alias(n) for n, e in found.values()]
        table = rows.table.groupBy("unit", *keys).agg(*made) if made else rows.table.select("unit", *keys).distinct()
        if not keys:  # one group for each unit, also where nothing is bound
            counts = {n: F.coalesce(n, F.lit(0)) for n, e in found.values() if e[1] in ("COUNT", "SUM")}
            table = self.units().table.join(table, "unit", "left").withColumns(counts)
        rows = Bindings(table, frozenset(rows.loose))
        for e in having:
            rows = Bindings(rows.table.where(self.expression(e, rows, {})), rows.loose)
        extra = {n: self.expression(e, rows, {}) for n, e in items if e is not None}
        for n, e in items:
            if e is None and n not in keys:
                raise SparqlError(f"?{n} is neither grouped nor aggregated")
            names.append(n)
        return Bindings(rows.table.withColumns(extra) if extra else rows.table, rows.loose), names

    def _aggregate(self, e: tuple, rows: Bindings) -> Column:
        _, name, distinct, inner, separator = e
        x = F.lit(1) if inner is None else self.expression(inner, rows, {})
        if name == "COUNT":
            return F.count_distinct(*([F.col(c) for c in rows.names] if inner is None else [x])) if distinct else F.count(x)
        if name == "GROUP_CONCAT":
            values = F.collect_set(x.cast("string")) if distinct else F.collect_list(x.cast("string"))
            return F.array_join(F.array_sort(values), separator)
        if name in ("SUM", "AVG"):
            x = x.cast("double")
            return (F.sum_distinct(x) if distinct else F.sum(x)) if name == "SUM" else (F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x))
        return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[name](x)

    # groups

    def group(self, node: tuple, seed: Bindings) -> Bindings:
        rows, filters = seed, []
        for item in node[1]:
            kind = item[0]
            if kind == "triple":
                rows = rows.join(self.triple(*item[1:]))
            elif kind == "filter":
                filters.append(item[1])
            elif kind == "union":
                # branches see only the unit, so that a branch's filters are its own
                branches = [self.group(b, self.units()) for b in item[1]]
                names = list(dict.fromkeys(n for b in branches for n in b.names))
                loose = {n for n in names if any(n not in b.names or n in b.loose for b in branches)}
                table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.table for b in branches])
                rows = rows.join(Bindings(table, frozenset(loose)))
            elif kind == "group":
                rows = rows.join(self.group(item, self.units()))
            elif kind == "optional":
                rows = self.optional(item[1], rows)
            elif kind == "minus":
                other = self.group(item[1], self.units())
                if any(n in other.names for n in rows.names):
                    rows = rows.join(Bindings(other.table.select("unit", *[n for n in other.names if n in rows.names]).distinct(), other.loose), "left_anti")
            elif kind == "bind":
                if item[1] in rows.names:
                    raise SparqlError(f"?{item[1]} is bound already")
                rows = Bindings(rows.table.withColumn(item[1], self.expression(item[2], rows, {})), rows.loose | {item[1]})
            elif kind == "values":
                rows = rows.join(self.values(item[1], item[2]))
            elif kind == "select":
                table, names = self.select(item[1])
                rows = rows.join(Bindings(table))
            else:
                raise SparqlError(f"unsupported: {kind}")
        # a filter holds for its whole group, wherever it stands
        for e in filters:
            rows = self.filter(e, rows)
        return rows

    def optional(self, node: tuple, rows: Bindings) -> Bindings:
        """Left join; filters directly in the optional group may use variables from outside it."""
        filters = [i[1] for i in node[1] if i[0] == "filter"]
        inner = self.group(("group", [i for i in node[1] if i[0] != "filter"]), self.units())
        if not filters:
            return rows.join(inner, "left")
        base = Bindings(rows.table.select("unit", *rows.names).distinct(), rows.loose)
        found = base.join(inner)
        for e in filters:
            found = self.filter(e, found)
        key = [F.col("unit") == F.col("__unit"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in rows.names]]
        right = found.table.select(*[F.col(c).alias(f"__{c}" if c in ("unit", *rows.names) else c) for c in found.table.columns])
        table = rows.table.join(right, reduce(lambda a, b: a & b, key), "left").drop("__unit", *[f"__{c}" for c in rows.names])
        return Bindings(table, rows.loose | {n for n in inner.names if n not in rows.names})

    def values(self, names: list[str], values: list[list]) -> Bindings:
        spark = self.facts.table.sparkSession
        schema = ", ".join(f"`{n}` string" for n in names)
        table = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in values], schema)
        loose = frozenset(n for k, n in enumerate(names) if any(r[k] is None for r in values))
        # constants of the query's text, once for each unit
        return Bindings(self.units().table.crossJoin(F.broadcast(table)), loose)

    def exists(self, node: tuple, rows: Bindings) -> tuple[Bindings, list[str]]:
        """Solutions of an inner group under the outer bindings, as a table of those outer variables it uses."""
        used = [n for n in rows.names if n in _variables(node)]
        seed = Bindings(rows.table.select("unit", *used).distinct(), frozenset(n for n in used if n in rows.loose))
        inner = self.group(node, seed)
        return Bindings(inner.table.select("unit", *used).distinct(), seed.loose), used

    def filter(self, e: tuple, rows: Bindings) -> Bindings:
        if e[0] == "and":
            return self.filter(e[2], self.filter(e[1], rows))
        if e[0] == "exists":
            return self._checked(e[1], rows, "left_semi")
        if e[0] == "not" and e[1][0] == "exists":
            return self._checked(e[1][1], rows, "left_anti")
        marked, e, flags = self._flagged(e, rows)
        return Bindings(marked.table.where(self.expression(e, marked, {})).drop(*flags), rows.loose)

    def _checked(self, node: tuple, rows: Bindings, how: str) -> Bindings:
        found, used = self.exists(node, rows)
        same = [F.col("unit") == F.col("__unit"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in used]]
        right = found.table.select(*[F.col(c).alias(f"__{c}") for c in found.table.columns])
        return Bindings(rows.table.join(right, reduce(lambda a, b: a & b, same), how), rows.loose)

    def _flagged(self, e, rows: Bindings):
        """EXISTS inside a larger condition becomes a column that tells whether it holds."""
        flags: list[str] = []

        def lift(e):
            nonlocal rows
            if isinstance(e, tuple) and e and e[0] == "exists":
                found, used = self.exists(e[1], rows)
                self.flags += 1
                flag = f"_e{self.flags}"
                same = [F.col("unit") == F.col("__unit"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in used]]
                right = found.table.select(*[F.col(c).alias(f"__{c}") for c in found.table.columns], F.lit(True).alias(flag))
                table = rows.table.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"__{c}" for c in found.table.columns])
                rows = Bindings(table.withColumn(flag, F.coalesce(flag, F.lit(False))), rows.loose)
                flags.append(flag)
                return ("flag", flag)
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            if isinstance(e, list):
                return [lift(x) for x in e]
            return e

        return (lambda made: (rows, made, flags))(lift(e))

    # triples and paths

    def triple(self, s: tuple, path: tuple, o: tuple) -> Bindings:
        if path[0] == "var":
            table = self.facts.table.select("unit", F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
            return self._named(table, [(s, "_s"), (path, "_p"), (o, "_o")])
        table = self.path(path).select("unit", F.col("a").alias("_s"), F.col("b").alias("_o"))
        return self._named(table, [(s, "_s"), (o, "_o")])

    def _named(self, table: DataFrame, places: list) -> Bindings:
        names: dict[str, str] = {}
        for term, column in places:
            if term[0] == "var":
                if term[1] in names:
                    table = table.where(F.col(names[term[1]]) == F.col(column))
                else:
                    names[term[1]] = column
            else:
                table = table.where(F.col(column) == str(term[1]))
        return Bindings(table.select("unit", *[F.col(c).alias(n) for n, c in names.items()]) if names else table.select("unit").distinct())

    def path(self, p: tuple) -> DataFrame:
        """(unit, a, b) pairs of a path."""
        kind = p[0]
        if kind == "pred":
            return self.facts.rel(p[1], "a", "b").select("unit", "a", "b")
        if kind == "inverse":
            return self.path(p[1]).select("unit", F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "alt":
            if all(x[0] == "pred" for x in p[1]):  # one scan
                return self.facts.table.where(F.col("p").isin(*[x[1] for x in p[1]])).select("unit", F.col("s").alias("a"), F.col("o").alias("b"))
            return reduce(DataFrame.union, [self.path(x) for x in p[1]])
        if kind == "seq":
            made = self.path(p[1][0])
            for x in p[1][1:]:
                made = made.withColumnRenamed("b", "m").join(self.path(x).withColumnRenamed("a", "m"), ["unit", "m"]).select("unit", "a", "b")
            return made
        if kind == "not":
            return self.facts.table.where(~F.col("p").isin(*p[1])).select("unit", F.col("s").alias("a"), F.col("o").alias("b"))
        inner = self.path(p[1])
        if kind == "plus":
            return closure(inner, "a", "b")
        made = closure(inner, "a", "b") if kind == "star" else inner
        nodes = self.facts.table.select("unit", F.col("s").alias("a")).union(self.facts.table.select("unit", F.col("o").alias("a"))).distinct()
        return made.union(nodes.select("unit", "a", F.col("a").alias("b"))).distinct()

    # expressions

    def expression(self, e: tuple, rows: Bindings, extra: dict) -> Column:
        x = lambda y: self.expression(y, rows, extra)
        kind = e[0]
        if kind == "flag":
            return F.col(e[1])
        if kind == "var":
            if e[1] in extra:
                return extra[e[1]]
            return F.col(e[1]) if e[1] in rows.table.columns else F.lit(None).cast("string")
        if kind in ("iri", "lit"):
            return F.lit(e[1])
        if kind == "or":
            return x(e[1]) | x(e[2])
        if kind == "and":
            return x(e[1]) & x(e[2])
        if kind == "not":
            return ~x(e[1])
        if kind == "in":
            return reduce(lambda a, b: a | b, [x(e[1]) == x(o) for o in e[2]], F.lit(False))
        if kind == "cmp":
            a, b = x(e[2]), x(e[3])
            return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]
        if kind == "math":
            a, b = x(e[2]).cast("double"), x(e[3]).cast("double")
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e[1]]()
        if kind == "call":
            return self.call(e[1], [x(a) for a in e[2]], e[2], rows)
        raise SparqlError(f"not an expression here: {kind}")

    def call(self, name: str, a: list[Column], raw: list, rows: Bindings) -> Column:
        text = [c.cast("string") for c in a]
        if name == "STR":
            return text[0]
        if name == "BOUND":
            return a[0].isNotNull()
        if name == "REGEX":
            flags = raw[2][1] if len(raw) > 2 else ""
            pattern = F.concat(F.lit(f"(?{flags})" if flags else ""), text[1])
            return F.regexp(text[0], pattern)
        if name == "REPLACE":
            return F.regexp_replace(text[0], text[1], text[2])
        if name == "CONTAINS":
            return F.contains(text[0], text[1])
        if name == "STRSTARTS":
            return F.startswith(text[0], text[1])
        if name == "STRENDS":
            return F.endswith(text[0], text[1])
        if name == "STRLEN":
            return F.length(text[0])
        if name == "SUBSTR":
            return F.substr(text[0], a[1].cast("int"), *([a[2].cast("int")] if len(a) > 2 else []))
        if name == "STRBEFORE":
            at = F.instr(text[0], raw[1][1])
            return F.when(at > 0, F.substr(text[0], F.lit(1), at - 1)).otherwise(F.lit(""))
        if name == "STRAFTER":
            at = F.instr(text[0], raw[1][1])
            return F.when(at > 0, F.substr(text[0], at + F.lit(len(raw[1][1])))).otherwise(F.lit(""))
        if name == "IF":
            return F.when(a[0], a[1]).otherwise(a[2])
        if name == "COALESCE":
            return F.coalesce(*a)
        if name == "CONCAT":
            return F.concat(*text)
        if name == "SAMETERM":
            return a[0] == a[1]
        if name in ("ISIRI", "ISURI"):  # all nodes of a fact table are IRIs
            return a[0].isNotNull() if raw[0][0] == "var" else F.lit(raw[0][0] == "iri")
        if name == "ISLITERAL":
            return F.lit(raw[0][0] == "lit")
        if name == "ISBLANK":
            return F.lit(False)
        simple = {"UCASE": F.upper, "LCASE": F.lower}
        if name in simple:
            return simple[name](text[0])
        return {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[name](a[0].cast("double"))


def _has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return True
    return isinstance(e, tuple | list) and any(_has_aggregate(x) for x in e)


def _variables(node) -> set[str]:
    """Names of variables anywhere in a part of the tree."""
    if isinstance(node, Query):
        return {n for n, _ in node.items or []} | _variables(node.where)
    if isinstance(node, tuple) and len(node) == 2 and node[0] == "var":
        return {node[1]}
    if isinstance(node, tuple | list):
        return set().union(*[_variables(x) for x in node]) if node else set()
    return set()
