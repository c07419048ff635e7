"""Queries in their registered settings against brute force or SQL, and inputs at the edge of what is defined."""

import glob
import math
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id, license_scan, licenses, line_dedup, minmax_dedup, norm_buckets, queries, shared, toxicity, unit_dedup
from factloom.llm import wordbytes as wb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert normal(queries.queries()[name](spark, SF).toPandas()) == normal(c.sql(queries.oracle_sql()[name]).df())


def test_batches_between_spark_and_python_are_bounded(spark):
    table = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).coalesce(1)

    def run(batches):
        for b in batches:
            yield b.slice(0, 1).select([]).append_column("n", __import__("pyarrow").array([b.nbytes]))

    assert max(r.n for r in shared.in_arrow(table, run, "n long").collect()) < 12 << 20


# 2


def brute_licenses(text, index, threshold=0.8):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = set()
    for name, template in licenses.TEMPLATES.items():
        t = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), template))
        k = min(5, len(t))
        held = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        stride = max(1, len(t) // 4)
        for a in range(0, max(len(words) - k + 1, 0), stride):
            w = words[a : a + len(t) + stride]
            if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} & held) >= threshold * len(held):
                found.add(name)
                break
    return found


def test_licenses_against_brute_force(spark, docs):
    extra = [(10_000 + k, "before it " + t.strip() + " and after") for k, t in enumerate(licenses.TEXTS.values())]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: {m.name for m in r.licenses} for r in license_scan.scan(table).collect()}
    assert got == {r.doc_id: brute_licenses(r.text, None) for r in table.collect()}
    assert all(len(got[10_000 + k]) >= t.count("\n\n") for k, t in enumerate(licenses.TEXTS.values()))


def test_bands_alone_find_windows_at_the_threshold():
    random.seed(1)
    index = license_scan.Index(licenses.TEMPLATES, 5, 32, 2)
    tried = found = 0
    for n, spec in index.by_length.items():
        for t in spec["templates"]:
            m, width = len(index.sets[t]), n + spec["stride"] - spec["k"] + 1
            for _ in range(100):
                held = random.sample(index.sets[t].tolist(), math.ceil(0.8 * m))
                row = np.array(held + [random.getrandbits(64) for _ in range(width - len(held))], np.uint64)
                tried += 1
                found += any(t in spec["table"].get(key, ()) for key in index.band_keys(row[None, :])[0].tolist())
    assert tried > 3000 and found / tried > 0.998


# 3


def test_a_null_label_teaches_its_own_category_nothing(spark):
    rows = [(i, "good text here" if i % 2 else "awful text here", 1 if i % 3 else None, 1 - i % 2) for i in range(60)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(0, None, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, queries.CATEGORIES)
    probs = {r.doc_id: r.probs[1] for r in toxicity.score(docs, chain).collect()}
    assert all((probs[i] > 0.5) == (i % 2 == 0) for i in range(60))
    none = toxicity.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int")), queries.CATEGORIES)
    assert all(r.probs[1] < 0.5 for r in toxicity.score(docs, none).collect())


def test_features_are_chosen_without_the_fold():
    # feature 0 tells the category in the first half of the rows only
    owner, token = np.array([0, 1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3]), np.array([1] * 8 + [0] * 4)
    y = np.array([[1.0], [1], [1], [1], [0], [0], [0], [0]])
    rows = np.array([False] * 4 + [True] * 4)
    assert 0 in toxicity.best_features(owner, token, 2, y, ~rows | rows, 1) and toxicity.best_features(owner, token, 2, y, rows, 1).tolist() == [0]
    x = toxicity.presence(owner, token, 8, np.array([0]))
    assert x[:, 0].tolist() == [1] * 4 + [0] * 4 and toxicity.presence(owner, token, 8, np.empty(0, int)).shape == (8, 0)


# 4


def brute_top(rows, k=5):
    limit = (1 << 63) - 1
    clean = [(i, [max(min(math.floor(256.0 * x), limit), -limit - 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in clean if i % 50 == 0}):
        mine = next(v for i, v in clean if i == q)
        scored = sorted((-max(min(sum(a * b for a, b in zip(mine, v)), limit), -limit - 1), i) for i, v in clean if i != q and len(v) == len(mine))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_repeats_and_huge_components(spark):
    random.seed(2)
    rows = [(i, [random.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(3)]) for i in range(300)]
    rows += [rows[7], rows[7], (50, rows[50][1]), (301, [1e18, 0.0, -1e18]), (302, [1e300, 1.0, 0.0]), (303, [float("nan"), 1.0, 1.0]), (304, [None, 1.0, 1.0]), (305, None), (None, [1.0, 1.0, 1.0]), (350, [1e18, 1e18, 0.0]), (400, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "norm", "bucket", "dim")})
    vectors = norm_buckets.integer_vectors(table, "vec_id", "embedding")
    for sizes in ({}, {"bucket_size": 16, "block_size": 2}):
        got = norm_buckets.top_k(vectors, vectors.where("id % 50 = 0"), 5, **sizes)
        assert sorted(map(tuple, got.collect())) == brute_top(rows)


# 5


def test_letters():
    assert not any(map(language_id.has_letter, ("", "²  ½", "Ⅷ ①", "12 !?"))) and all(map(language_id.has_letter, ("1a", "é", "日", "ß")))


def test_slices_come_from_all_of_a_text():
    text = " ".join(f"w{i}" for i in range(5000))
    cut = language_id.spread_slices(text, 400)
    places = [int(w[1:]) for w in cut.split()]
    assert len(cut) <= 400 and min(places) < 20 and max(places) > 4900 and any(1000 < p < 4000 for p in places)
    assert language_id.spread_slices("short text", 400) == "short text" and language_id._shares([5, 100, 100], 105) == [5, 50, 50]


def test_a_language_at_the_end_of_long_texts_is_learned(spark):
    """Nothing but what stands behind the first 3,000 characters tells the languages apart."""
    filler = "0 1 2 3 4 5 6 7 8 9 " * 150
    random.seed(5)
    words = {x: ["".join(random.choices(letters, k=random.randrange(4, 10))) for _ in range(100)] for x, letters in (("aa", "abcdefghij"), ("bb", "efghijklmn"))}
    made = [(k, filler + " ".join(random.choices(words[x], k=200)), x) for k, x in enumerate(["aa", "bb"] * 30)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(k, " ".join(random.choices(words[x], k=80)), x) for k, x in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    got = language_id.predict(new, language_id.learn(table), keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred for r in got)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(table, most_languages=1)


# 6


def test_runs_of_short_units(spark):
    short, long = "a line of just six words", " ".join(f"w{i}" for i in range(20))
    passage = "\n".join(f"line number {i} of the passage here" for i in range(6))
    table = spark.createDataFrame([(1, f"{short}\n{long}\n{passage}"), (2, f"x {short}\n{short}\nother one"), (3, long), (4, f"new start here\n{passage}\nnew end")], "doc_id long, text string")
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in unit_dedup.removed_spans(table, **queries.REPEATS).collect()}
    assert set(spans) == {3, 4} and len(spans[4]) == 6 and spans[3] == [(0, len(long))]


def test_production_spans_against_brute_force(spark, docs):
    """Every unit of 15 words that repeats is in the spans; every span is a repeat of 15 words or in a run of 40."""
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in unit_dedup.removed_spans(docs, **queries.REPEATS).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    cuts = {"paragraph": r"(?:[ \t\r\f\x0b]*\n){2,}", "line": r"\n", "sentence": r"\n|(?<=[.!?])(?=[\x20\x09-\x0d])"}
    seen = defaultdict(list)
    for d, t in sorted(texts.items()):
        for kind, cut in cuts.items():
            at = 0
            for part in re.split(cut, t):
                place = t.index(part, at)
                at = place + len(part)
                w = words(part)
                if len(w) >= 5:
                    seen[tuple(w)].append((d, place + len(part) - len(part.lstrip()), place + len(part.rstrip())))
    repeated = defaultdict(set)
    for w, places in seen.items():
        first = min((d, a) for d, a, _ in places)
        for d, a, b in places:
            if (d, a) != first:
                repeated[d].add((a, b, len(w)))
    for d, units in repeated.items():
        for a, b, n in units:
            if n >= 15:
                assert any(x <= a and b <= y for x, y in spans.get(d, ())), (d, a, b)
    for d, mine in spans.items():
        assert all((a, b) in {(x, y) for x, y, _ in repeated[d]} for a, b in mine)
        for a, b in mine:
            run = [(x, y) for x, y in mine if len(words(texts[d][min(a, x) : max(b, y)])) >= 15]
            assert run or len(words(texts[d][a:b])) >= 15


# 9


def test_line_counts_columns(spark, docs):
    from tests.llm.test_llm import distance

    table = docs.select("doc_id", "text")
    got = {r.doc_id: r for r in line_dedup.line_counts(table).collect()}
    places = sorted(((r.doc_id, i), tuple(w for w in re.split("[ \t\r\f\x0b]+", x.lower()) if w)) for r in table.collect() for i, x in enumerate((r.text or "").split("\n")))
    places = [(at, w) for at, w in places if w]
    first, solid = {}, {}
    for at, w in places:
        first.setdefault(w, at)
        solid.setdefault("".join(w), at)
    near = {w for w in first if solid["".join(w)] < first[w]}
    long = sorted((w for w in first if len(w) >= 5), key=len)
    for w in long:
        for v in long:
            k = max(1, max(len(v), len(w)) // 10)
            if first[v] < first[w] and abs(len(v) - len(w)) <= k and len(set(w) - set(v)) <= k and distance(v, w) <= k:
                near.add(w)
                break
    n, gone, kinds = defaultdict(int), defaultdict(list), defaultdict(int)
    for at, w in places:
        n[at[0]] += 1
        if w in near or first[w] != at:
            gone[at[0]].append(at[1])
        kinds[at[0]] += w in near and first[w] == at
    assert {d: (r.n_lines, r.n_removed, r.n_near, list(r.removed)) for d, r in got.items()} == {d: (n[d], len(gone[d]), kinds[d], gone[d]) for d in got}


def test_lines_of_one_doc_id(spark):
    """Different rows of one doc_id, a row many times, and a document of many close lines."""
    base = "one two three four five six seven eight"
    table = spark.createDataFrame([(1, base), (1, base), (1, base + " nine"), (2, base + "\n" + base), (3, "\n".join(f"{base} {i}" for i in range(400)))], "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.removals(table).collect()}
    assert {(2, 0), (2, 1)} <= got and {(3, i) for i in range(400)} <= got


# 10


def test_candidates_lose_no_link(spark, docs):
    """Of all links between different texts, the share that the registered settings put in one component."""
    for percent in (80, 85):
        got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(docs, percent=percent).collect()}
        rows = docs.select("doc_id", "text").collect()
        sets = dict(zip((r.doc_id for r in rows), minmax_dedup.shingle_sets([r.text for r in rows], 5)))
        links = [(a, b) for a in sets for b in sets if a < b and len(sets[a]) and len(sets[b]) and 100 * (n := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) >= percent * (len(sets[a]) + len(sets[b]) - n)]
        assert links and all(got[a] == got[b] for a, b in links)


def test_a_hub_that_not_all_reach(spark):
    """A chain in which each text is near the next only, and a star whose center comes last."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 60, 4)]
    table = spark.createDataFrame(list(enumerate([*reversed(chain), " ".join(f"v{i}" for i in range(50)), *chain])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(table, percent=80, group_docs=4).collect()}
    assert {got[i] for i in got if i != len(chain)} == {0} and got[len(chain)] == len(chain)


def test_rows_of_one_doc_id_keep_different_texts(spark):
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    table = spark.createDataFrame([(3, t), (5, t), (5, u), (7, u), (8, None), (8, None)], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in minmax_dedup.one_of_each(table).collect()), key=str)
    assert kept == sorted([(3, t), (5, u), (8, None)], key=str)
    assert wb.split([t], "space").count.tolist() == [30]
