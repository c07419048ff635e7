"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values per document, its minimum and
its maximum over the document's shingle set, so a signature of 2k values takes
k hash evaluations per shingle.  Bands of values propose candidates, full
shingle sets confirm them, and links are joined to components.

Spark stages:

1. one pass over the texts (Arrow) gives set size, a 128-bit fingerprint of the
   shingle set and the band keys;
2. documents of equal sets form a class (map-side minima, so thousands of
   copies cost one row per task); only class representatives go on;
3. representatives that share a band key form a bucket, and the smallest of
   them is its hub.  Every member is compared with the hubs of its buckets on
   full sets, each (hub, member) once for all their buckets; components over the
   confirmed links settle all buckets whose members are then connected;
4. in the other buckets, members that their hub doesn't reach are compared with
   all the rest (see open_links), again on full sets: a group returns a spanning
   forest, since links between connected documents change nothing;
5. those links join the components of step 3 to larger ones.

Texts move only where they are compared: a Bloom filter of fixed size keeps the
others from being shuffled.

Defined results: null or empty text, or no words, gives size 0 and no links; a
text of fewer words than a shingle is one shingle; rows with a null doc_id take
no part, and keep size and a null component; repeated rows are members of one
class.  Other columns are not read.  Sets of equal 128-bit fingerprints count as
equal without being compared: among 10**11 sets the chance of one mistake is
under 10**-16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .components import components
from .shared import in_arrow, materialise, only_wanted

U64 = np.uint64


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    words = wb.split(texts, "space")
    hashes = wb.shingle_hashes(words.hashes, size)
    for first, count in zip(words.first.tolist(), words.count.tolist()):
        if count >= size:
            out.append(np.unique(hashes[first : first + count - size + 1]))
        elif count:
            # the whole sequence as one shingle; another seed keeps it apart from full shingles
            with np.errstate(over="ignore"):
                short = wb.shingle_hashes(words.hashes[first : first + count], count)[:1] ^ U64(0xA5A5 + count)
            out.append(short)
        else:
            out.append(np.empty(0, U64))
    return out


def band_keys(sets: list[np.ndarray], bands: int, perms: int) -> np.ndarray:
    """Band keys, one row per non-empty set: each band hashes the minima and maxima of `perms` hash functions."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    factors = wb.constants(bands * perms, 0x3141) | U64(1)
    out = np.empty((len(sets), bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sets), b + 1, U64)
            for k in range(b * perms, (b + 1) * perms):
                h = flat * factors[k]
                for end in (np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)):
                    key = wb.mix(key * U64(0x100000001B3) + end)
            out[:, b] = key.view(np.int64)
    return out


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([(wb.mix(s + U64(0x1111)).sum(dtype=U64), wb.mix(s ^ U64(0x7777777777777777)).sum(dtype=U64)) for s in sets], U64).reshape(-1, 2).view(np.int64)


def features(docs: DataFrame, size: int, bands: int, perms: int) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, fp1, fp2 and bands (null where the set is empty) of each row."""

    def run(batches):
        for batch in batches:
            ids, ties, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in wb.slices(texts):
                sets = shingle_sets(texts[a:b], size)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, bands, perms).tolist()) if full else iter(())
                prints = _fingerprints(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        ties.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints[:, 0]),
                        pa.array(prints[:, 1]),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tie", "n_shingles", "fp1", "fp2", "bands"],
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text")), run, "doc_id long, tie long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def confirmed(sets: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links with 100 * intersection >= percent * union among the sets.

    Sets of one label are connected already.  Rows of intersections are computed
    from postings for sets outside the largest component, those that share most
    first: every link between different components has such an end.
    """
    n = len(sets)
    label = np.arange(n) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if label[0] != label[1] and 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) else []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cuts = np.flatnonzero(np.diff(flat)) + 1
    begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(flat)]))
    tokens = flat[begin]
    shared = np.bincount(owner, weights=np.repeat(end - begin, end - begin), minlength=n) / np.maximum(sizes, 1)
    done, forest = np.zeros(n, bool), []
    while True:
        largest = np.argmax(np.bincount(label, minlength=n))
        left = np.flatnonzero(~done & (label != largest))
        if not len(left):
            return forest
        i = int(left[np.argmax(shared[left])])
        done[i] = True
        at = np.searchsorted(tokens, sets[i])
        common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]), minlength=n)
        for j in np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i])).tolist():
            if label[j] != label[i]:
                forest.append((i, j))
                label[label == label[j]] = label[i]


def _with_texts(docs: DataFrame, reps: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt (g, doc_id, part), by group and part, with fp1 and the text of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = only_wanted(texts, dealt.select("doc_id").distinct(), "doc_id")
    # another row may have the same doc_id and another text, or another class the same representative
    named = dealt.join(reps.select("doc_id", "fp1"), "doc_id")
    return named.join(texts, "doc_id").select("g", "part", "doc_id", "fp1", "text").repartition("g").sortWithinPartitions("g", "part")


def _groups(batches, size: int):
    """(group, part, doc_id, shingle set) of the rows of _with_texts, in order."""
    for batch in batches:
        groups, parts, ids, prints, texts = (batch.column(k).to_pylist() for k in range(5))
        for a, b in wb.slices(texts):
            made = shingle_sets(texts[a:b], size)
            marks = _fingerprints(made)[:, 0].tolist()
            for i in range(a, b):
                if marks[i - a] == prints[i]:
                    yield groups[i], parts[i], ids[i], made[i - a]


def _linked(links: list[tuple[int, int]]):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def hub_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int, spoke: int = 512) -> DataFrame:
    """The pairs (hub, doc_id) that are links, as (a, b).

    A hub's documents are dealt to groups of about `spoke`, with the hub in each; a group is read one document at a
    time, so a hub of any number of documents is neither one task nor held in memory.
    """
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    salted = pairs.join(counts, "hub").select("hub", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.ceil(F.col("m") / spoke)).alias("salt"))
    group = F.xxhash64("hub", "salt").alias("g")
    dealt = salted.select(group, "doc_id", F.lit(1).alias("part")).unionByName(salted.select(group, F.col("hub").alias("doc_id"), F.lit(0).alias("part")).distinct())
    rows = _with_texts(docs, reps, materialise(dealt, "spokes"))

    def run(batches):
        group, hubs, out = None, [], []
        for g, part, doc, now in _groups(batches, size):
            if g != group:
                group, hubs = g, []
            if not part:
                hubs.append((doc, now))
                continue
            for hub, s in hubs:
                if 100 * min(len(s), len(now)) >= percent * max(len(s), len(now)):
                    common = len(np.intersect1d(s, now, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(now) - common):
                        out.append((hub, doc))
            if len(out) >= 10_000:
                yield _linked(out)
                out = []
        if out:
            yield _linked(out)

    return in_arrow(rows, run, "a long, b long")


def open_links(docs: DataFrame, reps: DataFrame, members: DataFrame, size: int, percent: int, group_words: int, group_docs: int) -> DataFrame:
    """Links (a, b) in buckets whose documents are not all connected: members (key, doc_id, n_shingles, component, side).

    side tells that a document is not in the component of its bucket's hub.  Those are compared with all of the
    bucket, the others are not compared among themselves: both kinds are cut into blocks, and each pair of blocks
    with a side one is a group, no larger than `group_words` or `group_docs`.  Buckets of equal members count once.
    """
    who = F.xxhash64("doc_id", "n_shingles")
    limits = lambda side: F.ceil(F.greatest(F.sum(F.when(side, F.col("n_shingles")).otherwise(F.lit(0))) / (group_words // 2), F.count_if(side) / (group_docs // 2))).cast("int")
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum(who.cast("decimal(38,0)")).alias("who"), F.bit_xor(F.xxhash64("n_shingles", "doc_id")).alias("who2"),
        limits(~F.col("side")).alias("mains"), limits(F.col("side")).alias("sides"),
    )
    buckets = buckets.groupBy("m", "who", "who2", "mains", "sides").agg(F.min("key").alias("key")).select("key", "mains", "sides")
    rows = members.join(buckets, "key")
    # main blocks are 0 .. mains - 1, side blocks follow
    own = F.when(F.col("side"), F.col("mains") + F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("sides"))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("mains"))).cast("int")
    rows = rows.withColumn("own", own)
    last = F.col("mains") + F.col("sides") - 1
    rows = rows.withColumn("other", F.explode(F.when(F.col("side"), F.sequence(F.lit(0), last)).otherwise(F.sequence(F.col("mains"), last))))
    # a block is compared within itself beside any other block; alone only where there is no other
    rows = rows.where((F.col("own") != F.col("other")) | ((F.col("mains") == 0) & (F.col("sides") == 1)))
    dealt = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "doc_id", F.col("component").alias("part"))
    texts = _with_texts(docs, reps, materialise(dealt, "open"))

    def run(batches):
        def flush(ids, sets, labels):
            links = confirmed(sets, percent, labels) if len(sets) > 1 else []
            if links:
                yield _linked([(ids[i], ids[j]) for i, j in links])

        group, ids, sets, labels = None, [], [], []
        for g, part, doc, now in _groups(batches, size):
            if g != group:
                yield from flush(ids, sets, labels)
                group, ids, sets, labels = g, [], [], []
            ids.append(doc)
            sets.append(now)
            labels.append(part)
        yield from flush(ids, sets, labels)

    return in_arrow(texts, run, "a long, b long")


def near_components(docs: DataFrame, reps: DataFrame, size: int, percent: int, group_words: int, group_docs: int) -> DataFrame:
    """(node, component) of the links between representatives (doc_id, n_shingles, fp1, bands)."""
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialise(rows.join(buckets, "key"), "shared")
    pairs = materialise(shared.where("doc_id <> hub").select("hub", "doc_id").distinct(), "pairs")
    near = materialise(hub_links(docs, reps, pairs, size, percent), "hub-links")
    found = materialise(components(near, "a", "b"), "hub-components")

    # buckets of three and more with a document that its hub doesn't reach
    failed = pairs.join(near.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")), ["hub", "doc_id"], "left_anti")
    failed = failed.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").join(found.select(F.col("node").alias("hub"), F.col("component").alias("h")), "hub", "left")
    failed = failed.where(F.coalesce("c", "doc_id") != F.coalesce("h", "hub")).select("hub", "doc_id")
    open_ = shared.where("m > 2").join(failed, ["hub", "doc_id"], "left_semi").select("key").distinct()
    component = F.coalesce("component", "doc_id")
    members = shared.join(open_, "key", "left_semi").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "hub", component.alias("component"))
    hubs = found.select(F.col("node").alias("hub"), F.col("component").alias("h"))
    members = members.join(hubs, "hub", "left").join(reps.select("doc_id", "n_shingles"), "doc_id")
    members = materialise(members.select("key", "doc_id", "n_shingles", "component", (F.col("component") != F.coalesce("h", "hub")).alias("side")), "open-buckets")
    more = materialise(open_links(docs, reps, members, size, percent, group_words, group_docs), "open-links")
    if more.isEmpty():
        return found
    # a link says the same of the components that its ends are in, so the links settled above take no second part
    inside = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    outer = more.join(inside("a"), "a", "left").join(inside("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    over = components(outer, "a", "b")
    top = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    joined = found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return joined.unionByName(over.join(found, "node", "left_anti").select("node", "component"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 24, perms: int = 2, group_words: int = 2_000_000, group_docs: int = 4_000, ties: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id); with ties, a hash of the text as tie.

    A pair at similarity s is proposed with probability 1 - (1 - s**(2 * perms)) ** bands:
    by default 1 - 3e-6 at 0.80 and 1 - 2e-8 at 0.85.
    """
    made = materialise(features(docs, size, bands, perms), "features")
    linkable = made.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(linkable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    # representatives of classes can share a doc_id where doc_id is repeated: they are one node
    found = near_components(docs, classes.withColumnRenamed("rep", "doc_id"), size, percent, group_words, group_docs)
    member = classes.select("fp1", "fp2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    joined = made.select("doc_id", "tie", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp1")).alias("fp1"), F.when(F.col("n_shingles") > 0, F.col("fp2")).alias("fp2")).join(member, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["tie"] if ties else []))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest doc_id.

    Rows with a null doc_id stay; of equal texts that share the kept doc_id one row stays, different ones all stay.
    """
    marks = materialise(near_duplicates(docs, ties=True, **options), "marks")
    rows = docs.withColumn("_tie", F.xxhash64("text"))
    gone = marks.where("not kept").select("doc_id", F.col("tie").alias("_tie")).distinct()
    left = rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["_tie"] == gone["_tie"]), "left_anti")
    twice = marks.where("kept and doc_id is not null").groupBy("doc_id", "tie").count().where("count > 1")
    if not twice.isEmpty():
        left = left.where("doc_id is not null").dropDuplicates(["doc_id", "_tie"]).unionByName(left.where("doc_id is null"))
    return left.drop("_tie")
