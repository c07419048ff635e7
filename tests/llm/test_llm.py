"""Operators against brute force, exact round trips or held-out accuracy, and the awkward inputs of each."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import components, decontaminate, language_id, license_scan, line_dedup, minmax_dedup, mixing, norm_buckets, queries, token_planes, toxicity, unit_dedup

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, blank and very long texts, repeated rows, null ids and columns.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7),
    (None, "one two three four five six", "de", "b", 9), (6, "Wörter über Flüße é日本 " * 30000, "de", "c", 9), (7, "a b c d e f g h i j k l m n.\n\na b c d e f g h i j k l m n.", "fr", None, 1), (8, "!!! ... 123", "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names operators might use themselves
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("x") for c in ("_row", "_hit", "_n", "bands", "h1", "size", "copies", "spans", "unit", "_text", "id")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1


def expected_tokens(table):
    tokenizer = token_planes.Encoder(queries.vocabulary()).tokenizer
    out, start = [], 0
    for r in sorted(table, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_tokens_round_trip(spark, docs, tmp_path, kind):
    token_planes.write(docs, str(tmp_path / "t"), queries.vocabulary(), kind=kind, block_ids=1000)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_planes.read(spark, str(tmp_path / "t")).collect())
    assert got == sorted(expected_tokens(docs.collect()))
    chunks = token_planes.tokens(spark, str(tmp_path / "t")).orderBy("shard", "chunk").collect()
    assert sum(len(c.ids) for c in chunks) == sum(g[2] for g in got)


def test_tokens_of_odd_rows(spark, odd, none, tmp_path):
    token_planes.write(odd, str(tmp_path / "t"), queries.vocabulary())
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_planes.read(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=str) == sorted(expected_tokens(odd.collect()), key=str)
    token_planes.write(none, str(tmp_path / "e"), queries.vocabulary())
    assert token_planes.read(spark, str(tmp_path / "e")).count() == 0


def test_pieces_encode_as_whole_texts():
    e = token_planes.Encoder(queries.vocabulary(), most_pieces=50)
    random.seed(3)
    parts = ["a", " ", "\n", "\t", "'s", "1", "!", "é", " ", "\x1c", "<|endoftext|>", "​", "日本", "word", "  "]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(4000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for k in range(0, len(texts), 100) for x in e.encode(texts[k : k + 100])] == want


def test_crc_of_parts():
    a, b = b"some bytes", b"and more of them"
    assert token_planes.crc_followed(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


# 2


def test_license_scan(spark, docs, odd, none):
    got = {r.doc_id: {m.name for m in r.licenses} for r in license_scan.scan(docs).collect()}
    for name in ("MIT-statement", "Apache-2.0-statement", "GPL-3.0-statement", "CC-BY-NC-4.0-statement"):
        text = license_scan.TEMPLATES[name]
        held = {r.doc_id for r in docs.collect() if text in (r.text or "")}
        assert {d for d, names in got.items() if name in names} >= held
    clean = {r.doc_id for r in docs.collect() if not re.search("licen[cs]e", r.text or "", re.I)}
    assert not any(got[d] for d in clean)
    assert license_scan.scan(odd).where("size(licenses) > 0").count() == 0 and license_scan.scan(none).count() == 0


def test_license_spans_and_near_texts(spark):
    whole = license_scan.TEMPLATES["MIT"]
    words = whole.split(" ")
    words[40] = "changed"
    text = "é before\n" + " ".join(words) + " after"
    (r,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [m.name for m in r.licenses] == ["MIT"] and 0.8 <= r.licenses[0].score < 1
    raw = text.encode()[r.licenses[0].begin : r.licenses[0].end].decode()
    assert raw.startswith("Permission is hereby") and raw.endswith("following conditions")


# 3


def test_toxicity_chain(spark, odd, none):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    # even documents teach, odd ones are held out
    chain = toxicity.fit(docs.where("doc_id % 2 = 0"), labels, queries.CATEGORIES)
    held = toxicity.score(docs.where("doc_id % 2 = 1"), chain).join(labels, "doc_id").collect()
    right = sum((r.probs[1] >= 0.5) == (r.toxic == 1) for r in held)
    assert right / len(held) > 0.85
    assert toxicity.score(odd, chain).count() == len(ODD) and toxicity.score(none, chain).count() == 0
    nothing = toxicity.fit(none, labels, queries.CATEGORIES)
    assert all(r.probs[1] < 0.5 for r in toxicity.score(docs.where("doc_id < 20"), nothing).collect())


def test_linear_model_separates():
    x = np.random.default_rng(1).integers(0, 2, (400, 6)).astype(float)
    y = x[:, 2]
    w = toxicity.fit_linear(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).all()


# 4


def brute_top(vectors, k, step):
    out = []
    for q, a in vectors:
        if q % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), p) for p, b in vectors if p != q and len(a) == len(b))
        out += [(q, i + 1, p, -s) for i, (s, p) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_norm_buckets(spark, spread):
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.05 * g.normal(size=8)) * np.exp(spread * g.random())) for i in range(600)]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors] + [(600, None), (601, []), (602, [float("nan")] * 8), (603, [None] * 8), (None, [1.0] * 8), (50, [float(x) for x in vectors[50][1]])], "vec_id long, embedding array<float>")
    parsed = norm_buckets.integer_vectors(table, "vec_id", "embedding")
    want = brute_top([(r.id, list(r.v)) for r in parsed.dropDuplicates(["id"]).collect()], 5, 50)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in norm_buckets.top_k(parsed.dropDuplicates(["id"]), parsed.where("id % 50 = 0"), 5, bucket_size=40, block_size=5).collect())
    assert got == want


def test_norm_buckets_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    parsed = norm_buckets.integer_vectors(table, "vec_id", "embedding")
    assert norm_buckets.top_k(parsed, parsed).count() == 0


# 5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_compression_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs, odd, none):
    learned = language_id.learn(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, learned).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= got
    assert {r.lang_pred for r in language_id.predict(odd, language_id.learn(none)).collect()} == {"und"}
    assert language_id.predict(none, learned).count() == 0


# 6


def test_units_against_brute_force(spark, docs):
    table = docs.collect()
    seen, want = {}, defaultdict(list)
    for r in sorted(table, key=lambda r: r.doc_id):
        for m in re.finditer(r"[^\n]+", r.text or ""):
            key = " ".join(re.sub("[A-Z]", lambda x: x[0].lower(), m[0]).split())
            if len(key.split()) < 5:
                continue
            if key in seen and seen[key] != (r.doc_id, m.start()):
                body = m[0]
                a = m.start() + len(body) - len(body.lstrip())
                want[r.doc_id].append((a, m.start() + len(body.rstrip())))
            seen.setdefault(key, (r.doc_id, m.start()))
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in unit_dedup.removed_spans(docs, unit="line").collect()}
    assert got == dict(want)


def test_pasted_passage_is_removed_once(spark, odd, none):
    passage = "Every word of this passage is pasted whole. It has é more than one sentence in it. The last sentence ends it all."
    table = spark.createDataFrame([(1, f"first text\n{passage} tail one"), (2, f"other beginning here {passage} and an end")], "doc_id long, text string")
    got = {r.doc_id: r for r in unit_dedup.deduplicated(table).collect()}
    assert got[1].removed_spans is None and passage in got[1].text
    assert "It has é more" not in got[2].text and "The last sentence" not in got[2].text and got[2].text.endswith("and an end")
    assert unit_dedup.deduplicated(odd).count() >= len(ODD) and unit_dedup.repeats(none).count() == 0
    with pytest.raises(Exception):
        unit_dedup.text_units(["a b"], "page", 1)


def test_repeated_lines_of_short_sentences_go_whole(spark, docs):
    line = "Stop! No. 3 of the list, p. 4. Go on."
    table = spark.createDataFrame([(1, f"head\n{line}\nmid"), (2, f"other\n{line}\nend")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in unit_dedup.deduplicated(table).collect()} == {1: f"head\n{line}\nmid", 2: "other\n\nend"}
    # the production unit: every repeated line and paragraph lies in the removed spans, which lie apart
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in unit_dedup.removed_spans(docs).collect()}
    assert all(x[1] <= y[0] for v in spans.values() for x, y in zip(v, v[1:]))
    for unit in ("line", "paragraph", "sentence"):
        for r in unit_dedup.repeats(docs, unit=unit).collect():
            assert any(a <= r.begin and r.end <= b for a, b in spans[r.doc_id])


# 7


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixture(spark):
    random.seed(2)
    table = [(i, " ".join(["w"] * random.randrange(1, 80)), random.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(3000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in table:
        sizes[s] += len(t.split())
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(table) and all(abs(taken[s] - targets[s]) <= 80 for s in targets)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mixture(docs.repartition(7)).collect())


def test_mixture_of_odd_rows(spark, odd, none):
    got = mixing.mixture(odd).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd).count() == sum(r.copies for r in got)
    assert mixing.mixture(none).count() == 0


def test_mixture_runs_no_python(spark, docs):
    plan = mixing.mixture(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 8


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination(spark, odd, block):
    long = " ".join(f"w{i % 17}" for i in range(60))
    items = [(1, long), (2, "One two"), (10, "a b c d e f g h i j k"), (11, None), (12, ""), (13, "ÜBER flüße"), (None, "g h i j k l m n a b"), (2, "One two")]
    more = [(20, "x " + long.upper() + " y"), (21, long[:25] + " one TWO"), (22, "one"), (23, "a b c d e f g h i j")]
    table = spark.createDataFrame([(*r, None, None, 0) for r in more], DOC)
    whole = odd.select("doc_id", "text").where("length(text) < 1000 or text is null").union(table.select("doc_id", "text"))
    got = decontaminate.contamination(whole, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()) for r in got.collect()), key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in whole.collect()], items)


def test_contamination_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_contaminated(odd, empty).count() == len(ODD) and decontaminate.without_contaminated(odd, empty).columns == odd.columns
    assert decontaminate.contamination(none, empty).count() == 0


# 9


def brute_lines(table, least=5):
    places = sorted(((r.doc_id, i), tuple(w for w in re.split("[ \t\r\f\x0b]+", x.lower()) if w)) for r in table if r.doc_id is not None for i, x in enumerate((r.text or "").split("\n")))
    places = [(at, w) for at, w in places if w]
    first = {}
    for at, w in places:
        first.setdefault(w, at)
    long, near = [w for w in first if len(w) >= least], set()
    for w in long:
        for v in long:
            if first[v] < first[w] and (len(v) == len(w) and sum(x != y for x, y in zip(v, w)) == 1 or len(v) == len(w) - 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w))) or len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))):
                near.add(w)
                break
    return {at for at, w in places if w in near or first[w] != at}


def test_lines_against_brute_force(spark):
    random.seed(4)
    base = [" ".join(random.choices("alpha beta Gamma dé e f of ft".split(), k=random.randrange(3, 12))) for _ in range(60)]
    lines_ = []
    for _ in range(400):
        w = random.choice(base).split()
        k = random.randrange(len(w))
        lines_.append(" ".join(random.choice([w, w, w[:k] + ["new"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + ["in"] + w[k:]])))
    table = spark.createDataFrame([(i, "\n".join(lines_[8 * i : 8 * i + 8])) for i in range(50)], "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.removals(table).collect()}
    assert got == brute_lines(table.collect())


def distance(v, w):
    row = list(range(len(w) + 1))
    for i, x in enumerate(v, 1):
        row, old = [i], row
        for j, y in enumerate(w, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("buckets", [1 << 16, 4])
def test_long_lines_against_levenshtein(spark, monkeypatch, buckets):
    monkeypatch.setattr(line_dedup, "_BUCKETS", buckets)
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    base = [random.choices(vocabulary, k=random.choice([16, 17, 18, 19, 20, 21, 29, 30, 31, 45, 130])) for _ in range(25)]
    made = []
    for _ in range(250):
        w = list(random.choice(base))
        for _ in range(random.randrange(0, len(w) // 10 + 2)):
            k = random.randrange(len(w))
            w[k : k + random.randrange(2)] = random.choice([[], ["new"], [random.choice(vocabulary)]])
        made.append(w)
    first = {}
    for i, w in enumerate(made):
        first.setdefault(tuple(w), i)
    near = {w for w in first if any(i < first[w] and abs(len(v) - len(w)) <= (k := max(1, max(len(v), len(w)) // 10)) and distance(v, w) <= k for v, i in first.items())}
    assert sum(min(distance(v, w) for v, i in first.items() if i < first[w]) > 1 for w in near) > 20
    table = spark.createDataFrame([(i, "\n".join(" ".join(w) for w in made[5 * i : 5 * i + 5])) for i in range(50)], "doc_id long, text string")
    got = {5 * r.doc_id + r.line for r in line_dedup.removals(table).collect()}
    assert got == {i for i, w in enumerate(made) if tuple(w) in near or first[tuple(w)] != i}


def test_lines_that_differ_in_spaces(spark):
    table = spark.createDataFrame([(1, "a data base\nfoo , bar"), (2, "a database\nfoo, bar\nfoo bar"), (3, "A  DATA BASE")], "doc_id long, text string")
    got = {(r.doc_id, r.line): r.near for r in line_dedup.removals(table).collect()}
    assert got == {(2, 0): True, (2, 1): True, (3, 0): False}


def test_lines_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in line_dedup.line_counts(odd).collect()}
    assert got[7].n_lines == 2 and list(got[7].removed) == [2] and got[1].n_lines == 0
    assert line_dedup.deduplicated(odd).count() >= len(ODD) and line_dedup.line_counts(none).count() == 0
    plan = line_dedup.removals(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10


def brute_near(table, percent, size=5):
    sets = {}
    for r in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


@pytest.mark.parametrize("percent,limits", [(85, {}), (85, {"group_words": 600, "group_docs": 6}), (80, {})])
def test_near_duplicates(spark, docs, percent, limits):
    random.seed(8)
    made = []
    base = [f"w{random.randrange(500)}" for _ in range(100)]
    for i in range(60):  # one large group of near copies, around the threshold
        w = list(base)
        for _ in range(random.randrange(5)):
            w[random.randrange(100)] = f"x{i}"
        made.append((10_000 + i, " ".join(w)))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(table, percent=percent, **limits).collect())
    assert got == brute_near(table.collect(), percent)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 2, None, True)} <= got
    one = minmax_dedup.one_of_each(odd)
    assert one.columns == odd.columns and one.where("doc_id in (4, 5)").count() == 1 and one.where("doc_id is null").count() == 1
    assert minmax_dedup.near_duplicates(none).count() == 0 and minmax_dedup.one_of_each(none).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    read = spark.read.parquet(f"{SF}/documents.parquet")
    names, docs = [n for n, _ in corpus_pipeline.STAGES], read
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == read.columns
        docs = spark.createDataFrame(out.collect(), read.schema)
        assert name == "mixing" or docs.count() <= before
        before = docs.count()
    tokens = corpus_pipeline.write_tokens(spark, docs, SF)
    assert tokens.count() == before == corpus_pipeline.run(spark, SF).count()


def test_pipeline_of_odd_rows(spark, odd, none):
    import corpus_pipeline

    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
