import pytest
from pyspark.sql import functions as F

from factloom import vocab
from factloom.engine import complete, scan
from factloom.facts import Facts
from factloom.operators import results
from factloom.operators.algebra import closure
from factloom.operators.detectors import DETECTORS, matches
from factloom.plans import motifs
from factloom.sinks import reports


@pytest.fixture(scope="module")
def table(spark):
    names = F.create_map(*[F.lit(x) for i, n in enumerate(motifs.NAMES) for x in (i, n)])
    return motifs.motif_table(spark).select(names[F.col("mid")].alias("unit"), "s", "p", "o")


@pytest.fixture(scope="module")
def found(table):
    return {(r.unit, r.pattern) for r in scan(Facts(table), timeout=300).matches.collect()}


def test_every_pattern_has_a_query():
    assert sorted(DETECTORS) == list(vocab.PATTERNS) and len(DETECTORS) == 23


@pytest.mark.parametrize("name", [n for n in motifs.NAMES if motifs.MOTIFS[n][0]])
def test_motif_is_found(found, name):
    assert (name, motifs.MOTIFS[name][0]) in found


@pytest.mark.parametrize("name", [n for n in motifs.NAMES if "_neg" in n])
def test_near_miss_is_not(found, name):
    own = {"chain": "Chain of Responsibility", "template": "Template Method", "factory": "Factory Method", "abstract": "Abstract Factory"}.get(name.split("_")[0], name.split("_")[0].capitalize())
    assert (name, own) not in found


def test_exact_roles(table):
    (r,) = DETECTORS["Composite"](Facts(table.where("unit = 'composite_pos'"))).collect()
    assert (r.component, r.composite, r.leaf) == ("Graphic", "Compound", "Dot")
    rows = DETECTORS["Facade"](Facts(table.where("unit = 'facade_pos'"))).collect()
    assert [(r.facade, r.subsystemA, r.subsystemB) for r in rows] == [("F", "A", "B")]


def test_units_do_not_meet(table):
    """Facts of one unit spread over two units are no match; an unrelated unit changes nothing."""
    one = table.where("unit = 'proxy_pos'")
    torn = one.withColumn("unit", F.when(F.col("s") == "Px", "x").otherwise("y"))
    assert matches(Facts(torn), "Proxy").count() == 0
    both = matches(Facts(one.union(table.where("unit = 'cycle'"))), "Proxy").collect()
    assert both == matches(Facts(one), "Proxy").collect()


def test_repeated_and_null_facts(table):
    one = table.where("unit = 'singleton_pos'")
    noisy = one.union(one).union(one.limit(1).withColumn("o", F.lit(None).cast("string")))
    assert matches(Facts(noisy), "Singleton").count() == 1


def test_closure_on_a_cycle(table):
    edges = table.where("unit = 'cycle'").select("unit", F.col("s").alias("c"), F.col("o").alias("b"))
    assert closure(edges, "c", "b").count() == 12
    assert closure(edges.limit(0), "c", "b").count() == 0


def test_failing_query_costs_no_other(table, monkeypatch):
    def broken(facts):
        raise RuntimeError("no such thing")

    monkeypatch.setitem(DETECTORS, "Proxy", broken)
    done = scan(Facts(table.where("unit = 'singleton_pos'")), ["Proxy", "Singleton"], timeout=300)
    assert done.errors == {"Proxy": "RuntimeError: no such thing"} and [r.pattern for r in done.matches.collect()] == ["Singleton"]
    assert {p for p, _ in done.slowest()} == {"Proxy", "Singleton"}


def test_incomplete_scans_are_told(table, monkeypatch):
    def broken(facts):
        raise RuntimeError("broken")

    monkeypatch.setitem(DETECTORS, "Proxy", broken)
    with pytest.raises(RuntimeError, match="Proxy"):
        complete(Facts(table))
    report = reports.scan_report(reports.match_json(results.reported(matches(Facts(table), "Command"))), 1, {"Proxy": "stopped after 50 s"})
    assert report["errors"] == ["Proxy: stopped after 50 s"] and "failed: Proxy: stopped after 50 s" in reports.console(report)


def test_joins_keep_the_partitioning_by_unit(table, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = Facts(table)
        facts.table.count()
        plan = matches(facts, "Proxy")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.split("InMemoryTableScan")[0]
    assert "Exchange hashpartitioning" not in above


def test_vocabulary_is_complete():
    used = {p for n in motifs.NAMES for _, p, _ in motifs.triples(n)}
    assert used <= set(vocab.PREDICATES)
    assert sum(bool(i) for r in vocab.ROLES.values() for i in r.values()) == 68
    assert vocab.pattern_iri("Interpreter") is None and vocab.pattern_iri("Chain of Responsibility").endswith("#ChainOfResponsibility")
