"""Near-duplicate lines in DataFrame functions only.

Lines are compared as sequences of lower-cased words.  Two are near if their
word edit distance is at most a tenth of the longer one's words (and 1 where
that is less), or if they differ in white space alone (`data base`, `database`).

1. Texts are cut once.  Equal lines are grouped by hash, with map-side minima,
   to their earliest place (doc_id, line number); so are lines that are equal
   without spaces.  From here on only the first of equal lines is compared.
2. Lines of up to _LONG words have a bound of 1.  If two of them are near, their
   first halves or their second halves are equal.  Each line gives the keys of
   its halves, for its own length and for one word less; lines that share no key
   with another line are near none and go no further.  The others emit their
   deletion variants: the line without each of its words, as a hash.  A changed
   word gives both lines the same variant at the same place; an added word gives
   the longer line a variant equal to the shorter.  Variants are grouped, not
   paired: all lines that share a variant at a place differ in that word alone,
   so each is joined to the earliest of its group.
3. Lines of _LONG words and more have a bound k that grows, and n over k deletion
   variants are too many (a line of 40 words has 91,390).  Of k + 1 segments of
   the longer line one is whole in the other, moved by few words: up to _MANY
   words both lines give the words at all places where that can be.  Longer lines
   would give too many; their shingles are put in one order for the whole corpus,
   and each gives the first ones, as many as hold k + 1 that share no word
   (prefix filter).  The order puts shingles that are frequent in a sample of
   lines last; any order is lossless, a good one keeps groups small.  Each line
   is compared with the earliest that has its key; only lines that still stay
   meet the others, a few at first and then more at a time, behind a parity
   sketch of their words (k edits change 2 k of its bits at most), and not again
   where the key before is the same.
4. Joined lines are compared word by word; of two near lines the later goes.

So a line is removed if an equal line, or a near line, stands earlier in the
corpus.  Lines of fewer than ``min_words`` words are compared for equality and
white space only: a tenth of their words is none, and with one word nearly all
would be near.

Defined results: null and empty texts have no lines; blank lines are never
removed; rows with a null doc_id are left alone and have no lines counted; rows
of one doc_id count as one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, only_wanted, unwanted


#: A place in the corpus as one number, ordered by document, then line: fits a hash aggregate, as a struct would not.
_AT = "cast(doc_id as decimal(20, 0)) * 4294967296 + line"

#: Half keys of a line of n words, for the lengths n and n - 1 of the shorter of two near lines: its first
#: s div 2 words and its last s - s div 2 words.  For one of the ends both lengths give the same words.
_HALVES = """
array_distinct(array(
  xxhash64(0, substring_index(t, ' ', n div 2)),
  xxhash64(0, substring_index(t, ' ', (n - 1) div 2)),
  xxhash64(1, substring_index(t, ' ', -(n - n div 2))),
  xxhash64(1, substring_index(t, ' ', -(n - 1 - (n - 1) div 2)))
))
"""

#: Lines of more words are long. Two near lines are both at most, or both at least, as long: a line of 19 words has a bound of 1.
_LONG = 18
#: Shingles are frequent if the bucket of their hash is among the _FREQUENT largest, of _BUCKETS, in one of _SAMPLE documents.
_BUCKETS, _FREQUENT, _SAMPLE = 1 << 16, 2048, 16
_BOUND = "greatest(1, {} div 10)"
#: A line that is near no first line of its keys meets the others by their place among the lines of a key, from these places on in turn.
_ROUNDS = (2, 4, 16)
#: A line of n words is near to none of more than n + n div 9, so no pair of lines that it belongs to has a greater bound.
_MOST = "n div 9"
#: Lines of fewer words, if both are, are compared by segments; of two near lines with one of _MANY words or more, the other has _FEWER or more.
_MANY, _FEWER = 50, 45
#: Words of a shingle. Longer ones are rarer, but k edits touch more of them.
_SHINGLE = 3
#: The last bits of a shingle are its place in the line; all places beyond count as one.
_PLACES = (1 << 16) - 1
#: The shingles of a line as sums of its words' hashes, below 15 less the bytes of the first word (15 at most): long words are rare.
_HASHES = f"transform(words, w -> xxhash64(w) & {(1 << 54) - 1 - _PLACES})"
_SHINGLES = f"transform(slice(words, 1, size(words) - {_SHINGLE - 1}), (w, i) -> shiftleft(15L - least(octet_length(w), 15), 56) + {' + '.join(f'hashes[i + {d}]' for d in range(_SHINGLE))} + least(i, {_PLACES}))"
#: Ordered shingles of which one surely survives k edits, and the tries for fewer: those that hold k + 1 that share no word.
_ENOUGH = f"{_SHINGLE} * ({_MOST}) + 1"
_TRIES = [f"{_MOST} + ({_MOST}) div {x} + 2" for x in (4, 2, 1)]


def _apart(m: str) -> str:
    """How many of the first m ordered shingles share no word, at most: places from the left, each behind the one taken before."""
    places = f"array_sort(transform(slice(ordered, 1, cast({m} as int)), x -> x & {_PLACES}))"
    return f"shiftright(aggregate({places}, 0L, (s, p) -> if(p >= (s & 1048575), shiftleft(shiftright(s, 20) + 1, 20) + p + {_SHINGLE}, s)), 20)"


_PREFIX = f"case {' '.join(f'when {_apart(m)} > {_MOST} then {m}' for m in _TRIES)} else {_ENOUGH} end"


def _segments(k: int) -> tuple[int, list]:
    """Pairs of long lines with the bound k, the longer of 10 k words or more: words of the shorter at least, and the keys of either line."""
    least = max(_LONG, 10 * k)
    size, keys = least // (k + 1), []
    for i in range(k + 1):
        # k + 1 segments of the longer line. Before the first whole one that has i edits before it stand i, so it is moved by i
        # words at most from the start, and by k - i at most from the end
        start, most = (F.lit(i * size + 1), i) if i <= k // 2 else (F.col("n") - (k + 1 - i) * size + 1, k - i)
        keys += [F.xxhash64(F.lit(100 * k + i), F.slice("hashes", start + d, F.lit(size))) for d in range(-most, most + 1)]
    return max(_LONG, least - k), keys


def lines(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row for each line that has words: doc_id, line (from 0), t (its words, single spaces between), n, a and b (128 bits
    of hash of t), solid (t without spaces); with wanted (doc_id, line), little more than those lines."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if wanted is not None:
        rows = only_wanted(rows, wanted, "doc_id")
    # white space is put in order in whole texts: translate() takes a string for each character, and what filters ask of lines is made again after them
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\r\f\x0b", F.lower("text"))
    rows = rows.select("doc_id", spaced.alias("text"))
    rows = rows.select("doc_id", F.when(F.contains("text", F.lit("  ")), F.regexp_replace("text", " +", " ")).otherwise(F.col("text")).alias("text"))
    trimmed = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("\n")), (" \n", "\n "), F.col("text"))
    rows = rows.select("doc_id", F.posexplode(F.split(F.trim(trimmed), "\n")).alias("line", "t"))
    if wanted is not None:
        rows = only_wanted(rows, wanted, "doc_id", "line")
    rows = rows.where("t <> ''").withColumn("solid", F.replace("t", F.lit(" "), F.lit("")))
    n = F.octet_length("t") - F.octet_length("solid") + 1
    return rows.select("doc_id", "line", "t", n.alias("n"), F.xxhash64("t").alias("a"), F.xxhash64(F.lit(7), "t").alias("b"), "solid")


def _lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """at, doc_id, line, t, n, a, b of the lines at wanted places (doc_id, line), each once."""
    rows = lines(docs, wanted).join(wanted, ["doc_id", "line"], "left_semi")
    # repeated rows of a doc_id have their lines at one place; texts stay where the join has dealt them
    return rows.dropDuplicates(["doc_id", "line", "a", "b"]).select(F.expr(_AT).alias("at"), "doc_id", "line", "t", "n", "a", "b")


def _firsts(docs: DataFrame, made: DataFrame, kinds: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line, t, n of the first line of each kind (a, b, first, times, n) of min_words words or more.

    A line whose hash no repeated line has is the only one of its kind, which a Bloom filter tells without a shuffle.
    """
    enough = F.col("n") >= min_words
    again = kinds.where(enough & (F.col("times") > 1)).select("a", "b", F.expr("cast((first - pmod(first, 4294967296)) div 4294967296 as bigint)").alias("doc_id"), F.expr("cast(pmod(first, 4294967296) as int)").alias("line"))
    single = unwanted(lines(docs).where(enough), again, "a")
    # lines that the filter takes for repeated ones
    taken = only_wanted(made.where(enough), again, "a").join(again, ["a", "b"], "left_anti")
    places = materialise(again.select("doc_id", "line", "a", "b").unionByName(taken.select("doc_id", "line", "a", "b")), "places")
    rest = _lines_at(docs, places.select("doc_id", "line")).join(places, ["doc_id", "line", "a", "b"], "left_semi")
    return single.select("doc_id", "line", "t", "n").unionByName(rest.select("doc_id", "line", "t", "n"))


def _bucket(x):
    """The bucket of a shingle: the bits above those that its place takes."""
    return F.shiftright(x, 16).bitwiseAND(F.lit(_BUCKETS - 1))


def _frequent(docs: DataFrame) -> list[int]:
    """The buckets of shingles that are frequent in the long lines of a sample of documents: _FREQUENT numbers at most, whatever the corpus."""
    some = lines(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(_SAMPLE)) == 0)).where(F.col("n") >= _FEWER)
    some = some.select(F.split("t", " ").alias("words")).withColumn("hashes", F.expr(_HASHES))
    counts = some.select(F.explode(F.expr(_SHINGLES)).alias("x")).groupBy(_bucket(F.col("x")).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return [r.k for r in counts.orderBy(F.desc("m"), "k").limit(_FREQUENT).collect()]


def _keyed(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """key, doc_id, line: the keys of each first line, of its halves where it is short, of segments or shingles where it is long."""
    often = _frequent(docs)

    def late(x):
        """Frequent shingles come after the others, which stand in the order of their bits."""
        return x + F.when(_bucket(x).isin(often), F.lit(1 << 62)).otherwise(F.lit(0)) if often else x

    ordered = F.slice(F.sort_array(F.transform(F.expr(_SHINGLES), late)), F.lit(1), F.expr(f"cast({_ENOUGH} as int)"))
    rows = firsts.select("doc_id", "line", "t", "n", F.split("t", " ").alias("words"))
    none = F.array().cast("array<bigint>")
    keys = [F.when(F.col("n") <= _LONG, F.expr(_HALVES)).otherwise(none)]
    for k in range(1, _MANY // 10):
        least, segments = _segments(k)
        keys.append(F.when(F.col("n").between(least, 10 * k + 9), F.array(*segments)).otherwise(none))
    rows = rows.withColumn("hashes", F.when(F.col("n") >= _LONG, F.expr(_HASHES)))
    rows = rows.withColumn("ordered", F.when(F.col("n") >= _FEWER, ordered))
    keys.append(F.coalesce(F.expr(f"transform(slice(ordered, 1, cast({_PREFIX} as int)), x -> shiftright(x, 16))"), none))
    return rows.select(F.explode(F.array_distinct(F.concat(*keys))).alias("key"), "doc_id", "line")


def _short_later(known: DataFrame) -> DataFrame:
    """a, b of the lines (at, a, b, t) that have a line one word away earlier."""
    known = known.select("at", "a", "b", F.split("t", " ").alias("words"))
    hashed = known.select("at", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    without = F.expr("transform(h, (x, i) -> xxhash64(concat(slice(h, 1, i), slice(h, i + 2, size(h)))))")
    variants = materialise(hashed.select("at", F.posexplode(without).alias("i", "v")), "variants")
    # a word changed: the earliest line of each variant and place, and its other lines
    hubs = variants.groupBy("v", "i").agg(F.min("at").alias("other"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v", "i", "other")
    changed = variants.join(hubs, ["v", "i"]).select("at", "other").where("at <> other")
    # a word added: a variant that is a line
    added = variants.select("v", "at").join(hashed.select(F.xxhash64("h").alias("v"), F.col("at").alias("other")), "v").select("at", "other")
    pairs = changed.unionByName(added).distinct()

    # confirm by the words themselves
    one = known.select("at", "a", "b", F.col("words").alias("w1"))
    two = known.select(F.col("at").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("w2"))
    both = pairs.join(one, "at").join(two, "other")
    differ = "filter(sequence(0, least(size(w1), size(w2)) - 1), k -> w1[k] <> w2[k])"
    first = f"coalesce(array_min({differ}), least(size(w1), size(w2)))"
    near = F.expr(f"""case
        when size(w1) = size(w2) then size({differ}) = 1
        when size(w1) = size(w2) + 1 then concat(slice(w1, 1, {first}), slice(w1, {first} + 2, size(w1))) = w2
        else false end""")
    mine = F.col("at") > F.col("other")
    return both.where(near).select(F.when(mine, F.col("a")).otherwise(F.col("a2")).alias("a"), F.when(mine, F.col("b")).otherwise(F.col("b2")).alias("b"))


def _long_later(known: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b of the lines (at, a, b, n, t) that have a near line earlier, among lines that share a key (key, at, hub, place in its order)."""
    # each word as one character, by each of two hashes: equal hashes can only make lines nearer, so the greater distance counts
    text = lambda seed: F.expr(f"decode(unhex(array_join(transform(words, w -> lpad(hex(65536 + pmod(xxhash64({seed}, w), 1048576)), 8, '0')), '')), 'UTF-32')")
    parity = lambda half: F.expr(f"aggregate(hashes, 0L, (s, h) -> if((h & 64) = {64 * half}, s ^ shiftleft(1L, cast(h & 63 as int)), s))")
    made = known.select("at", "n", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    sketch = materialise(made.select("at", "n", parity(0).alias("s1"), parity(1).alias("s2")), "sketch")

    def bound(x: str, y: str) -> str:
        return _BOUND.format(f"greatest({x}n, {y}n)")

    def close(x: str, y: str):
        k = bound(x, y)
        return F.expr(f"abs({x}n - {y}n) <= {k} and bit_count({x}s1 ^ {y}s1) + bit_count({x}s2 ^ {y}s2) <= 2 * {k}")

    def near(pairs: DataFrame, label: str) -> DataFrame:
        """at, a, b of the pairs (at, other), written, whose lines are near. Only lines of pairs are coded."""
        ends = pairs.select("at").unionByName(pairs.select(F.col("other").alias("at")))
        words = only_wanted(known, ends, "at").select("at", "a", "b", "n", F.split("t", " ").alias("words"))
        coded = materialise(words.select("at", "a", "b", "n", text(1).alias("t"), text(2).alias("u")), "coded")
        both = pairs.alias("p").join(coded.alias("x"), F.col("p.at") == F.col("x.at")).join(coded.alias("y"), F.col("p.other") == F.col("y.at"))
        k = bound("x.", "y.")
        # beyond the bound levenshtein is -1
        return materialise(both.where(f"levenshtein(x.t, y.t, {k}) >= 0 and levenshtein(x.u, y.u, {k}) >= 0").select("x.at", "x.a", "x.b").distinct(), label)

    hubs = shared.where("at <> hub").select("at", "hub").distinct().alias("p")
    hubs = hubs.join(sketch.alias("x"), F.col("p.at") == F.col("x.at")).join(sketch.alias("y"), F.col("p.hub") == F.col("y.at")).where(close("x.", "y."))
    gone = near(materialise(hubs.select("x.at", F.col("y.at").alias("other")), "hubs"), "hubbed")
    # two lines that share the key before too meet there, or there one is the hub of the other: no need to meet again
    before = shared.withColumn("before", F.lag("key").over(Window.partitionBy("at").orderBy("key")))
    others = materialise(before.where("at <> hub").select("key", "at", "place", "before").join(sketch, "at"), "others")
    # among many close lines one soon meets a near one; only those that don't meet the rest of their key, more at a time
    for first, last in zip(_ROUNDS, (*_ROUNDS[1:], None)):
        left = others.where(F.col("place") > first).join(gone.select("at"), "at", "left_anti").alias("x")
        some = others.where((F.col("place") >= first) if last is None else F.col("place").between(first, last - 1)).alias("y")
        pairs = left.join(some, (F.col("x.key") == F.col("y.key")) & (F.col("x.place") > F.col("y.place")) & (F.col("x.at") != F.col("y.at")) & F.expr("not x.before <=> y.before or x.before is null") & close("x.", "y."))
        more = near(materialise(pairs.select("x.at", F.col("y.at").alias("other")).distinct(), "pairs"), "more")
        gone = gone.unionByName(more)
    return gone.select("a", "b")


def _removals(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and line of the lines of docs, written, and the removals among them."""
    made = materialise(lines(docs).select("doc_id", "line", "n", "a", "b", F.xxhash64("solid").alias("c"), F.xxhash64(F.lit(7), "solid").alias("d")), "lines")
    kinds = materialise(made.groupBy("a", "b", "c", "d").agg(F.min(F.expr(_AT)).alias("first"), F.count(F.lit(1)).alias("times"), F.min("n").alias("n")), "kinds")

    # lines that share a key, with the earliest that has it
    order = Window.partitionBy("key").orderBy("doc_id", "line")
    hub = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keyed = _keyed(docs, _firsts(docs, made, kinds, min_words))
    marked = keyed.select("key", "doc_id", "line", hub("doc_id").alias("hub_doc"), hub("line").alias("hub_line"), F.lead("line").over(order).alias("next"), F.row_number().over(order).alias("place"))
    alone = F.col("next").isNull() & (F.col("doc_id") == F.col("hub_doc")) & (F.col("line") == F.col("hub_line"))
    hub_at = _AT.replace("doc_id", "hub_doc").replace("line", "hub_line")
    shared = materialise(marked.where(~alone).select("key", "doc_id", "line", F.expr(_AT).alias("at"), F.expr(hub_at).alias("hub"), "place"), "shared")
    known = materialise(_lines_at(docs, shared.select("doc_id", "line").distinct()), "known")
    later = _short_later(known.where(F.col("n") <= _LONG)).unionByName(_long_later(known.where(F.col("n") >= _LONG), shared.select("key", "at", "hub", "place")))

    # equal without spaces
    solid = kinds.groupBy("c", "d").agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    spaced = kinds.join(solid, ["c", "d"]).where("first <> earliest").select("a", "b")
    near = materialise(later.unionByName(spaced).distinct().withColumn("near", F.lit(True)), "near")
    gone = kinds.join(near, ["a", "b"], "left").where("near or times > 1").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    out = only_wanted(made, gone, "a").select("a", "b", "doc_id", "line", F.expr(_AT).alias("at")).join(gone, ["a", "b"]).where("near or at <> first")
    return made, out.select("doc_id", "line", (F.col("near") & (F.col("at") == F.col("first"))).alias("near")).distinct()


def removals(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """doc_id, line of each line to remove, and near: whether it is the first of its kind, and a near line stands earlier."""
    return _removals(docs, min_words)[1]


def line_counts(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (that have words), n_removed, n_near, removed array<int> (line numbers)."""
    made, gone = _removals(docs, min_words)
    gone = gone.groupBy("doc_id").agg(F.count_if("near").alias("n_near"), F.array_sort(F.collect_set("line")).alias("removed"))
    counts = made.select("doc_id", "line").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(counts, "doc_id", "left").join(gone, "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", none("n_lines"), F.size(removed).cast("long").alias("n_removed"), none("n_near"), removed.alias("removed"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with text lacking the removed lines; other columns as they are."""
    gone = removals(docs, **options).groupBy("doc_id").agg(F.collect_set("line").alias("_lines")).withColumnRenamed("doc_id", "_d")
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("_d"), "left")
    kept = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_lines"), i)))
    return joined.withColumn("text", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept)).drop("_d", "_lines")
