import pytest

from factloom.functions import names
from factloom.operators import evaluation as ev
from pyspark.sql import functions as F

OUT = "corpus string, unit string, labeled array<string>, structural array<string>, detected array<string>"


def jack(spark, rows):
    table = spark.createDataFrame([("c", str(i), *r) for i, r in enumerate(rows)], OUT)
    return {r.metric: r for r in ev.jackknife(ev.unit_counts(table), ["corpus"]).collect()}


def test_micro(spark):
    counts = spark.createDataFrame([("c", "Observer", 1, 1, 0), ("c", "Strategy", 1, 0, 1)], "corpus string, pattern string, tp long, fp long, fn long")
    (r,) = ev.micro(counts, ["corpus"]).collect()
    assert (r.precision, r.recall, r.f1) == pytest.approx((2 / 3,) * 3)


def test_undefined_precision_is_left_out(spark):
    counts = spark.createDataFrame([("c", "Strategy", 0, 0, 1), ("c", "Observer", 1, 0, 0)], "corpus string, pattern string, tp long, fp long, fn long")
    (r,) = ev.macro(counts, ["corpus"]).collect()
    assert (r.precision, r.recall) == (1.0, 0.5)


def test_published_figures(spark):
    counts = spark.createDataFrame([("before", 37, 31, 6), ("after", 36, 8, 7)], "stage string, tp long, fp long, fn long")
    got = {r.stage: tuple(round(r[m], 3) for m in ("precision", "recall", "f1")) for r in ev.rated(counts).collect()}
    assert got == {"before": (0.544, 0.860, 0.667), "after": (0.818, 0.837, 0.828)}


def test_confusion_has_all_patterns(spark):
    e = spark.createDataFrame([("c", "u", "Proxy")], "corpus string, unit string, pattern string")
    d = spark.createDataFrame([("c", "u", "Proxy", 3), ("c", "u", "Facade", 1)], "corpus string, unit string, pattern string, match_rows long")
    got = {r.pattern: (r.tp, r.fp, r.fn, r.match_rows) for r in ev.confusion(e, d, e.select("corpus")).collect()}
    assert len(got) == 23 and got["Proxy"] == (1, 0, 0, 3) and got["Facade"] == (0, 1, 0, 1) and got["Visitor"] == (0, 0, 0, 0)


def test_pool_is_no_mean_of_macros(spark):
    counts = spark.createDataFrame([("a", "Proxy", 1, 0, 0, 1), ("b", "Facade", 0, 1, 0, 1)], "corpus string, pattern string, tp long, fp long, fn long, match_rows long")
    pool = ev.pooled(counts).where("corpus is null")
    assert ev.micro(pool.withColumn("corpus", F.lit("all")), ["corpus"]).first().precision == 0.5


def test_dropped_false_positives(spark):
    r = jack(spark, [(["S"], ["S", "O"], ["S"]), (["S"], ["S", "P"], ["S"])])
    assert r["precision"].delta == 0.5 and r["recall"].delta == 0


def test_equal_units_have_no_width(spark):
    r = jack(spark, [(["S"], ["S", "P"], ["S"])] * 8)["precision"]
    assert (r.lower, r.upper) == pytest.approx((0.5, 0.5))


def test_one_unit_has_no_bounds(spark):
    r = jack(spark, [(["S"], ["S", "P"], ["S"])])["precision"]
    assert r.delta == 0.5 and r.lower is None


def test_undefined_pseudo_value(spark):
    r = jack(spark, [(["S"], ["S", "P"], ["S"]), ([], [], [])])["precision"]
    assert r.delta == 0.5 and r.lower is None


def test_order_does_not_matter(spark):
    rows = [(["S"], ["S", "O"], ["S"]), (["P"], ["P"], []), (["S"], ["O"], ["O"])]
    a, b = jack(spark, rows)["f1"], jack(spark, rows[::-1])["f1"]
    assert (a.lower, a.upper) == pytest.approx((b.lower, b.upper), abs=1e-12)


def test_gate():
    assert ev.passes_gate(0.5, 0.5) and ev.passes_gate(0.5 - 1e-10, 0.5) and not ev.passes_gate(0.4, 0.5) and ev.passes_gate(None, None) and not ev.passes_gate(None, 0.1)


@pytest.mark.parametrize("name,want", [("ChainOfResponsibility", "Chain of Responsibility"), ("factory_method", "Factory Method"), ("Utilities", None), ("123", None), ("", None)])
def test_normalised_names(spark, name, want):
    from factloom.sources.corpora import normalise

    assert normalise(name) == want
    assert spark.createDataFrame([(name,)], "n string").select(names.pattern_of(F.col("n"))).first()[0] == want


def test_dotted_names(spark):
    row = spark.createDataFrame([("A.B.TemplateMethod.Conceptual",)], "n string").select(names.pattern_of_dotted(F.col("n")), names.label(F.col("n"))).first()
    assert tuple(row) == ("Template Method", "Conceptual")


def test_slow_units(spark):
    rows = spark.createDataFrame([("a", p, s) for p, s in (("P", 6.0), ("Q", 5.0), ("R", 2.0), ("S", 1.5), ("T", 0.2))] + [("b", "P", 3.0)], "unit string, pattern string, seconds double")
    assert [(r.unit, r.pattern) for r in ev.slow_units(rows).orderBy("place").collect()] == [("a", "P"), ("a", "Q"), ("a", "R")]
