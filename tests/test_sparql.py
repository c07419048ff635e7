import pytest

from factloom.facts import Facts
from factloom.sparql import SparqlError, parse, query
from factloom.sinks.reports import query_text

TRIPLES = [("A", "extends", "B"), ("B", "extends", "C"), ("A", "hasMethod", "m"), ("m", "returnsType", "C"), ("A", "hasField", "f"), ("f", "returnsType", "int"), ("B", "hasMethod", "n")]
P = "PREFIX s: <urn:factloom:source#> "


@pytest.fixture(scope="module")
def facts(spark):
    return Facts(spark.createDataFrame([("u", *t) for t in TRIPLES] + [("v", "A", "extends", "Z")], "unit string, s string, p string, o string"))


def select(facts, text, unit="u"):
    r = query(facts, P + text)
    return sorted(tuple(x[v] for v in r.variables) for x in r.table.where(f"unit = '{unit}'").collect())


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT ?x WHERE { ?x s:extends s:B }", [("A",)]),
        ("SELECT ?x ?y { ?x s:extends+ ?y }", [("A", "B"), ("A", "C"), ("B", "C")]),
        ("SELECT ?y { s:A s:extends* ?y }", [("A",), ("B",), ("C",)]),
        ("SELECT ?y { s:A s:extends? ?y }", [("A",), ("B",)]),
        ("SELECT ?t { s:A s:hasMethod/s:returnsType|s:hasField/s:returnsType ?t }", [("C",), ("int",)]),
        ("SELECT ?x { s:C ^s:extends ?x }", [("B",)]),
        ("SELECT ?o { s:A !(s:extends|s:hasMethod) ?o }", [("f",)]),
        ("SELECT ?x { ?x s:extends ?y FILTER NOT EXISTS { ?x s:hasField ?f } }", [("B",)]),
        ("SELECT ?x ?f { ?x s:extends ?y OPTIONAL { ?x s:hasField ?f } }", [("A", "f"), ("B", None)]),
        ("SELECT ?x { ?x s:extends ?y OPTIONAL { ?x s:hasField ?f } FILTER(!BOUND(?f)) }", [("B",)]),
        ("SELECT ?x { ?x s:hasMethod ?m MINUS { ?x s:hasField ?f } }", [("B",)]),
        ("SELECT ?x { ?x s:hasMethod ?m MINUS { ?q s:hasField ?r } }", [("A",), ("B",)]),
        ("SELECT (COUNT(*) AS ?n) { ?x s:extends ?y }", [(2,)]),
        ("SELECT ?t (COUNT(DISTINCT ?x) AS ?n) { ?x s:returnsType ?t } GROUP BY ?t HAVING(COUNT(?x) > 0) ORDER BY ?t", [("C", 1), ("int", 1)]),
        ("SELECT ?x { { ?x s:hasField ?f } UNION { ?x s:hasMethod ?f } } ORDER BY ?x LIMIT 2", [("A",), ("A",)]),
        ("SELECT ?x ?l { VALUES ?x { s:A s:B } BIND(STRLEN(STR(?x)) + 1 AS ?l) }", [("A", 2.0), ("B", 2.0)]),
        ("SELECT DISTINCT ?p { s:A ?p ?o }", [("extends",), ("hasField",), ("hasMethod",)]),
        ("SELECT ?x { ?x a s:Nothing }", []),
        ("SELECT ?x { ?x s:extends ?y FILTER(?y IN (s:C, s:Q) && REGEX(STR(?x), '^b', 'i')) }", [("B",)]),
        ("SELECT ?x { ?x s:hasMethod ?m ; s:hasField ?f . }", [("A",)]),
        ("SELECT ?t { s:A s:hasMethod [ s:returnsType ?t ] }", [("C",)]),
        ("SELECT ?x { ?x s:extends ?y FILTER(EXISTS { ?x s:hasField ?f } || ?y = s:C) }", [("A",), ("B",)]),
    ],
)
def test_select(facts, text, want):
    assert select(facts, text) == sorted(want, key=str)


def test_other_forms(facts):
    assert {r.unit: r.answer for r in query(facts, P + "ASK { ?x s:extends s:Z }").table.collect()} == {"u": False, "v": True}
    made = query(facts, P + "CONSTRUCT { ?y s:below ?x } WHERE { ?x s:extends ?y }").table.where("unit = 'u'").collect()
    assert {(r.s, r.p, r.o) for r in made} == {("B", "below", "A"), ("C", "below", "B")}
    other = query(facts, P + "CONSTRUCT { ?y <urn:x#below> ?x } WHERE { ?x s:extends ?y }").table.where("unit = 'u'")
    assert {r.p for r in other.collect()} == {"urn:x#below"} and "<urn:x#below> <" in query_text(query(facts, P + "CONSTRUCT { ?y <urn:x#below> ?x } WHERE { ?x s:extends ?y }"))
    assert query(facts, P + "DESCRIBE s:B").table.where("unit = 'u'").count() == 2


def test_rendering(facts):
    one = Facts(facts.table.where("unit = 'u'"))
    assert query_text(query(one, P + "SELECT ?x { ?x s:extends s:B }")) == "x = A\n1 row(s)."
    assert query_text(query(one, P + "SELECT ?x { ?x s:extends s:Q }")) == "0 row(s)."
    assert query_text(query(one, P + "ASK { s:A s:extends s:B }")) == "true"


@pytest.mark.parametrize("text", ["", "SELECT WHERE { ?x ?y ?z }", "SELECT ?x { ?x s:p ", "INSERT DATA { s:a s:b s:c }", "SELECT ?x { GRAPH s:g { ?x s:p ?y } }", "ASK { ?x s:p ?y } nonsense"])
def test_errors(text):
    with pytest.raises(SparqlError):
        parse(P + text)


def test_only_declared_namespaces_name_terms(facts):
    text = "PREFIX o: <urn:anything#> SELECT ?x { ?x o:extends ?y }"
    assert query(facts, text).table.count() == 0
    assert query(facts, text, ("urn:anything#",)).table.where("unit = 'u'").count() == 2
    with pytest.raises(SparqlError):
        parse("SELECT ?x { ?x none:extends ?y }")
