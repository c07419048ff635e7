"""Substring deduplication by hashing lines or paragraphs.

Texts are cut into units: paragraphs (cut at blank lines), lines, or sentences
(lines cut again behind words that end in . ! or ?, for passages pasted into
the middle of a line); by default all three, as a line of short sentences has
no sentence long enough.  A unit is normalised to its lower-case (A-Z) words
with single spaces between and hashed to 128 bits.  Of equal units of
``min_words`` words or more, of whatever kind and anywhere in the corpus, the
earliest by (doc_id, first character) stays; the others are removed, and their
places in the original text are kept, those inside others left out.

A passage pasted into the middle of sentences may hold none of them whole.  With
``pieces``, the finest units are cut again before words where the hash of a word
pair is the least of that many words on both sides; such words are the same
wherever the passage stands, so what lies between two of them is a unit too.
One word over and over has no such places, and two texts hold it at different
lengths: it is cut into blocks of that many words.  A block stays if the first
like it stands in the same document, as each follows one like it.

Digests are grouped with map-side minima, so a line that a third of all
documents hold is a row for each task; only digests seen twice are joined back
to the units, in a join whose large keys Spark can split.

Defined results: null and empty texts have no units; rows with a null doc_id
are left alone; rows of one doc_id count as one document, and what they share
at the same place stays in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbytes as wb
from .shared import in_arrow, materialise

U64 = np.uint64
_BASE = wb.constants(2, 0x0DD5) | U64(1)
#: From the finest; each cuts where the next does.
KINDS = ("sentence", "line", "paragraph")
_BACK = [U64(pow(int(b), -1, 1 << 64)) for b in _BASE]


def _cuts(words: wb.Words, unit: str) -> np.ndarray:
    """For each word but the first: whether a unit begins there (texts' borders apart)."""
    data, ends, starts = words.data, words.ends[:-1], words.starts[1:]
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    feeds = lines[starts] - lines[ends]
    if unit == "paragraph":
        return feeds >= 2
    if unit == "line":
        return feeds >= 1
    if unit == "sentence":
        return (feeds >= 1) | np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    raise ValueError(f"unit is paragraph, line, sentence or all, not {unit}")


def _anchors(words: wb.Words, owner: np.ndarray, reach: int) -> np.ndarray:
    """For each word but the first: whether the hash of it and the word before is the least of `reach` words on both sides."""
    most = U64(2**64 - 1)
    with np.errstate(over="ignore"):
        pairs = wb.mix(words.hashes[1:] * _BASE[1] + words.hashes[:-1])
    # a text's first word has no word before; other texts of the batch don't count
    value = np.concatenate((np.array([most], U64), np.where(np.diff(owner) > 0, most, pairs)))
    least = np.ones(len(value), bool)
    for k in range(1, min(reach, len(value) - 1) + 1):
        other = owner[k:] != owner[:-k]
        least[k:] &= (value[k:] < value[:-k]) | other
        least[:-k] &= (value[:-k] <= value[k:]) | other
    return least[1:]


def _blocks(words: wb.Words, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: whether it stands in one line after line-mates equal to it, 2 size words or more, and whether a block begins at it."""
    equal = (words.hashes[1:] == words.hashes[:-1]) & (np.diff(owner) == 0) & ~_cuts(words, "line")
    first = np.flatnonzero(np.concatenate(([True], ~equal)))
    count = np.diff(np.append(first, len(owner)))
    # a word that ends a sentence ends the one before the run too: so blocks and sentences lie apart or one in the other
    skip = np.isin(words.data[words.ends[first] - 1], np.frombuffer(b".!?", np.uint8)).astype(np.int64)
    place = np.arange(len(owner)) - np.repeat(first + skip, count)
    inside = np.repeat(count >= 2 * size, count) & (place >= 0)
    return inside, inside & (place % size == 0)


def text_units(texts: list[str | None], unit: str, min_words: int, pieces: int = 0):
    """(text number, unit number, first character, end, words, two digests) of the units of min_words words or more; blocks of one word have the number -1."""
    words = wb.split(texts, "space")
    n = len(words.hashes)
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    owner = np.repeat(np.arange(len(texts)), words.count)
    begins, ends_, numbers = [], [], []
    finer = np.zeros(0, np.int64)
    kinds = KINDS if unit == "all" else (unit,)
    for kind in ("piece", *kinds) if pieces else kinds:
        if kind == "piece":
            inside, block = _blocks(words, owner, pieces)
            cuts = np.where(inside[1:], block[1:], _cuts(words, kinds[0]) | _anchors(words, owner, pieces) | inside[:-1])
        else:
            cuts = _cuts(words, kind)
        begin = np.flatnonzero(np.concatenate(([True], cuts | (np.diff(owner) > 0))))
        end = np.append(begin[1:], n)
        text = owner[begin]
        number = np.arange(len(begin)) - np.searchsorted(text, text)
        if kind == "piece":
            number[inside[begin]] = -1
        # what is one finer unit is there already
        new = ~np.isin(begin * (n + 1) + end, finer)
        finer = begin * (n + 1) + end
        begins, ends_, numbers = [*begins, begin[new]], [*ends_, end[new]], [*numbers, number[new]]
    begin, end, number = (np.concatenate(x) for x in (begins, ends_, numbers))
    digests = []
    with np.errstate(over="ignore"):
        for base, back in zip(_BASE, _BACK):
            up, down = np.full(n + 1, base, U64), np.full(n + 1, back, U64)
            up[0] = down[0] = U64(1)
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(words.hashes * up[:n], dtype=U64)))
            digests.append(wb.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64)).view(np.int64))
    text = owner[begin]
    # characters: every byte but the continuation bytes of UTF-8 begins one
    chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    lengths = np.cumsum([0] + [len(t) + 1 if t else 1 for t in texts])
    a, b = chars[words.starts[begin]] - lengths[text], chars[words.ends[end - 1]] - lengths[text]
    enough = end - begin >= min_words
    return tuple(x[enough] for x in (text, number, a, b, end - begin, digests[0], digests[1]))


def units(docs: DataFrame, unit: str = "line", min_words: int = 5, pieces: int = 0) -> DataFrame:
    """One row for each unit: doc_id, unit, begin, end (characters of the text), words, h1, h2."""

    def run(batches):
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for a, b in wb.slices(texts):
                text, number, begin, end, count, h1, h2 = text_units(texts[a:b], unit, min_words, pieces)
                for k in range(0, len(text), 20_000):
                    cut = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text[cut]], pa.int64()), *[pa.array(x[cut].astype(np.int32)) for x in (number, begin, end, count)], pa.array(h1[cut]), pa.array(h2[cut])], names=["doc_id", "unit", "begin", "end", "words", "h1", "h2"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, unit int, begin int, end int, words int, h1 long, h2 long")


def repeats(docs: DataFrame, *, unit: str = "all", min_words: int = 5, pieces: int = 0) -> DataFrame:
    """The units to remove: doc_id, unit, begin, end (characters of the original text), words, first_doc_id, first_begin."""
    # a place as one number, ordered by document, then character: fits a hash aggregate, as a struct would not
    made = materialise(units(docs, unit, min_words, pieces), "units").withColumn("at", F.expr("cast(doc_id as decimal(20, 0)) * 2147483648 + begin"))
    firsts = made.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    found = made.join(firsts, ["h1", "h2"]).where("at <> first")
    first_begin = F.expr("cast(pmod(first, 2147483648) as int)")
    found = found.select("doc_id", "unit", "begin", "end", "words", F.expr("cast((first - pmod(first, 2147483648)) div 2147483648 as bigint)").alias("first_doc_id"), first_begin.alias("first_begin"))
    return found.where("unit >= 0 or doc_id <> first_doc_id")


def removed_spans(docs: DataFrame, *, unit: str = "all", min_words: int = 5, alone_words: int = 0, run_words: int = 0, pieces: int = 0) -> DataFrame:
    """One row for each doc_id that loses units: doc_id, spans array<struct<begin,end>> in order.

    With alone_words, a repeated unit of fewer words goes only as part of a run: repeated units that follow each other
    without a word between them, of run_words words or more together.  So what many documents say in one short line
    stays, and a passage of short sentences goes.
    """
    # units lie apart or one in the other
    order = Window.partitionBy("doc_id").orderBy("begin", F.desc("end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    outer = repeats(docs, unit=unit, min_words=min_words, pieces=pieces).withColumn("reach", F.max("end").over(before)).where("reach is null or reach <= begin")
    if alone_words:
        # two characters hold no word and the space on both its sides
        outer = outer.withColumn("run", F.sum(F.when(F.col("begin") - F.col("reach") <= 2, 0).otherwise(1)).over(order))
        together = F.sum("words").over(Window.partitionBy("doc_id", "run"))
        outer = outer.withColumn("together", together).where((F.col("words") >= alone_words) | (F.col("together") >= run_words))
    return outer.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with text lacking the repeated units, and removed_spans of the original text; other columns as they are."""
    spans = removed_spans(docs, **options).select(F.col("doc_id").alias("_d"), F.col("spans").alias("removed_spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("_d"), "left").drop("_d")
    gaps = F.expr("""
        transform(sequence(0, size(removed_spans)), i -> substring(text,
            if(i = 0, 1, removed_spans[greatest(i - 1, 0)].end + 1),
            if(i = size(removed_spans), length(text), removed_spans[least(i, size(removed_spans) - 1)].begin) - if(i = 0, 0, removed_spans[greatest(i - 1, 0)].end)))
    """)
    return joined.withColumn("text", F.when(F.col("removed_spans").isNull(), F.col("text")).otherwise(F.concat_ws("", gaps)))
