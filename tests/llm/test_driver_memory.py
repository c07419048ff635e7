"""What the driver is spared: fits run in a task, and settled components take no round."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import components, queries, toxicity


def test_chain_is_fitted_by_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "vile words here" if i % 3 == 0 else "kind words there") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))

    def refuse(*_):
        raise AssertionError("fitted on the driver")

    # tasks import the module anew
    monkeypatch.setattr(toxicity, "fit_linear", refuse)
    chain = toxicity.fit(docs, labels, queries.CATEGORIES)
    scores = {r.doc_id: r.probs[1] for r in toxicity.score(docs, chain).collect()}
    assert all((scores[i] > 0.5) == (i % 3 == 0) for i in scores)


@pytest.mark.parametrize(
    ("links", "rounds"),
    [([], 0), ([(1, k) for k in range(2, 40)] + [(50, 51)], 0), ([(1, 3), (2, 3)], 1), ([(1, 2), (2, 3)], 1)],
)
def test_rounds_run_only_where_links_are_no_stars(spark, monkeypatch, links, rounds):
    made, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: made.append(label) or write(df, label))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert made.count("stars") == rounds
    least = {}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    assert got == least
