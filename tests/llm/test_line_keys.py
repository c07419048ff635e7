"""What lines share keys: all near ones, and few others."""

import random
from collections import defaultdict

from factloom.llm import line_dedup


def keys_of(spark, made):
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = defaultdict(set)
    for r in line_dedup._keyed(table, line_dedup.lines(table).select("doc_id", "line", "t", "n")).collect():
        got[r.doc_id].add(r.key)
    return got


def test_near_long_lines_share_a_key(spark):
    """As many words changed, added and left out as the bound allows, for lengths at the borders of all bounds."""
    random.seed(11)
    made = []
    for n in (18, 19, 20, 21, 27, 29, 30, 36, 39, 40, 41, 44, 45, 46, 49, 50, 51, 54, 55, 59, 60, 99, 130):
        for kind in range(12):
            w = [f"w{random.randrange(10**7)}" for _ in range(n)]
            v, k = list(w), max(1, n // 10)
            at = random.sample(range(n), k) if kind % 2 else [i * n // k + random.randrange(n // k) for i in range(k)]
            for i in sorted(at, reverse=True):
                v[i : i + random.choice([0, 1, 1]) if kind % 3 else i + 1] = random.choice([[], ["new"]]) if kind % 4 else ["new"]
            made += [" ".join(w), " ".join(v)]
    got = keys_of(spark, made)
    near = [i for i in range(0, len(made), 2) if made[i] != made[i + 1] and len(made[i + 1].split()) >= 18]
    assert len(near) > 200 and not [(made[i], made[i + 1]) for i in near if not got[i] & got[i + 1]]


def test_lines_that_share_a_phrase_share_no_key(spark):
    random.seed(12)
    some = lambda n: [f"w{random.randrange(10**7)}" for _ in range(n)]
    made = []
    for _ in range(30):
        phrase = some(4)
        made += [" ".join(some(k) + phrase + some(36 - k)) for k in (3, 11, 22)]
    got = keys_of(spark, made)
    assert len(got) == 90 and sum(map(len, got.values())) == len(set().union(*got.values()))
