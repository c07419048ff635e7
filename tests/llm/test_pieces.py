"""Passages that begin and end within sentences."""

import random

from factloom.llm import queries, unit_dedup


def test_a_passage_within_a_sentence_goes(spark, tmp_path):
    rnd = random.Random(3)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passages = [some(80) for _ in range(20)]
    rows = [(2 * i + k, f"{some(30)} {p} {some(30)}.") for i, p in enumerate(passages) for k in range(2)] + [(100, some(200)), (101, ""), (102, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_unit_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and not any(got[d].n_removed for d in (*range(0, 40, 2), 100, 101, 102))
    caught = [i for i in range(20) if got[2 * i + 1].n_removed]
    assert len(caught) >= 18
    for i in caught:
        text = rows[2 * i + 1][1]
        assert all(text[s.begin : s.end] in passages[i] for s in got[2 * i + 1].spans)


def test_pieces_do_not_depend_on_the_texts_beside():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randrange(60))) for _ in range(40)] + [None, ""]
    together = unit_dedup.text_units(texts, "all", 5, 4)
    for i, t in enumerate(texts):
        alone = unit_dedup.text_units([t], "all", 5, 4)
        mine = together[0] == i
        assert all(sorted(x[mine].tolist()) == sorted(y.tolist()) for x, y in zip(together[2:], alone[2:]))


def test_one_word_over_and_over_goes(spark, tmp_path):
    """Runs of one word of different lengths, also as sentences of one word; runs that no other document holds stay."""
    rnd = random.Random(6)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    run = lambda w, n: " ".join([w] * n)
    texts = [f"{some(20)} {run('heat', 61)} {some(20)}", f"{some(9)} {run('Heat', 53)} {some(30)}", run("own", 90), f"{some(5)} {run('end.', 70)} {some(5)}", f"{run('end.', 55)}\n{some(8)} {run('heat', 15)}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_unit_dedup(spark, str(tmp_path)).collect()}
    assert [got[d].n_removed > 0 for d in range(5)] == [False, True, False, False, True]
    for d, word in ((1, "heat"), (4, "end.")):
        cut = " ".join(texts[d][s.begin : s.end] for s in got[d].spans).lower().split()
        assert set(cut) == {word} and len(cut) >= 50
