"""Fact graphs as Turtle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import DET, FDP, RDF, SCAN, SRC, TYPE_KINDS, MEMBER_KINDS, MODIFIERS

PREFIXES = {"src": SRC, "scan": SCAN, "rdf": RDF, "det": DET, "fdp": FDP}
_TERMS = (*TYPE_KINDS, *MEMBER_KINDS, *MODIFIERS)


def _iri(x: Column, space: str = SCAN) -> Column:
    """A node's name in its namespace; what is an IRI already stays one."""
    return F.when(F.regexp(x, F.lit("^[a-z][a-z0-9+.-]*:")), F.concat(F.lit("<"), x, F.lit(">"))).otherwise(F.concat(F.lit(f"<{space}"), x, F.lit(">")))


def subjects(facts: DataFrame) -> DataFrame:
    """(unit, s, turtle): one statement block for each subject, its objects in order."""
    term = F.col("p").isin("type", "hasModifier") & F.col("o").isin(*_TERMS)
    verb = F.when(F.col("p") == "type", F.lit("a")).when(F.contains("p", F.lit(":")), _iri(F.col("p"))).otherwise(F.concat(F.lit("src:"), F.col("p")))
    thing = F.when(term, F.concat(F.lit("src:"), F.col("o"))).otherwise(_iri(F.col("o")))
    rows = facts.select("unit", "s", F.concat(verb, F.lit(" "), thing).alias("line")).groupBy("unit", "s").agg(F.array_join(F.array_sort(F.collect_set("line")), " ;\n    ").alias("lines"))
    return rows.select("unit", "s", F.concat(_iri(F.col("s")), F.lit(" "), "lines", F.lit(" .")).alias("turtle"))


def write(facts: DataFrame, path: str) -> None:
    """Write text files under path, a part for each partition; every part begins with the prefixes of no other."""
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in PREFIXES.items()) + "\n"
    blocks = subjects(facts).select(F.concat(F.lit(head), "turtle").alias("value"))
    blocks.write.mode("overwrite").text(path)


_STATEMENT = re.compile(r"<([^>]*)>|(\w+):([\w.-]+)|(\ba\b)|([;.,])")


def triples(text: str) -> set[tuple[str, str, str]]:
    """The facts of Turtle that this module writes."""
    prefixes = dict(re.findall(r"@prefix (\w+): <([^>]*)> \.", text))
    body = re.sub(r"@prefix [^\n]*\n?", "", text)
    out, now = set(), []
    for iri, prefix, local, a, mark in _STATEMENT.findall(body):
        if mark:
            out.add(tuple(now))
            now = now[:1] if mark == ";" else now[:2] if mark == "," else []
        else:
            name = "type" if a else iri if iri else prefixes[prefix] + local
            now.append(name.rsplit("#", 1)[-1])
    return {t for t in out if len(t) == 3}
