"""Benchmark decontamination as a prefix-filtered set join with positions.

A window is `window` consecutive words of an item, as a sequence of shingles.
For exact containment (similarity 1) the necessary prefix of a window is one
shingle, its rarest in the corpus, at a known offset.  So a document is
compared with a window only where that shingle occurs, and only if the window
laid at that place lies inside the document (positional and length bounds);
then all words of the place are compared with the window's.

Stages: (1) one pass over all texts counts how often each benchmark shingle
occurs in the corpus; (2) windows choose their rarest shingle; (3) one pass
over all texts looks up prefix shingles and confirms windows word by word.
Nothing but the windows is sent to the executors, and only ``block_windows`` of
them at once: a larger benchmark is joined block after block, with the hits so
far written to the shared folder in between.

Defined results: a null text has no words; an item of fewer words than the
window is one window if it has any; items with null text give none; items with
a null item_id mark words as hit but are not listed; repeated items count once.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .shared import in_arrow, materialise

U64 = np.uint64
KIND = "alnum"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(words binary, n int, items array<string>): the distinct windows of all items."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in wb.slices(texts):
                words = wb.split(texts[a:b], KIND)
                out = []
                for k in range(b - a):
                    first, count = int(words.first[k]), int(words.count[k])
                    if count:
                        n = min(window, count)
                        out += [(words.joined(first + i, first + i + n), n, ids[a + k]) for i in range(count - n + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["words", "n", "item_id"])

    rows = in_arrow(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), run, "words binary, n int, item_id string")
    return rows.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _window_shingles(words: bytes, n: int, size: int) -> np.ndarray:
    """Hashes of a window's shingles, in order; a window shorter than a shingle is one of its own length."""
    split = wb.split([words.decode("utf-8", "surrogatepass")], KIND)
    k = min(size, n)
    return wb.shingle_hashes(split.hashes, k)[: n - k + 1]


def shingle_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences in all documents of each given shingle (hashes by length in words)."""

    def run(batches):
        total = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in wb.slices(texts):
                words = wb.split(texts[a:b], KIND)
                for k, keys in shingles.items():
                    at, found = wb.lookup(wb.shingle_hashes(words.hashes, k), keys)
                    # shingles across the end of a text are not in it
                    text = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + k <= words.first[text] + words.count[text]
                    total[k] += np.bincount(found[inside], minlength=len(keys))
        for k, keys in shingles.items():
            seen = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(total[k][seen])], names=["shingle", "n"])

    rows = in_arrow(docs.select(F.col("text").cast("string").alias("text")).where("text is not null"), run, "shingle long, n long")
    # at most one row for each shingle of one block of windows comes back
    return {r.shingle & 0xFFFFFFFFFFFFFFFF: r.n for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def prefix_index(windows: list, counts: dict[int, int], size: int) -> dict:
    """Windows by their rarest shingle: for each shingle length the sorted hashes and (offset, window) entries."""
    by: dict[int, dict[int, list]] = {}
    for w, row in enumerate(windows):
        hashes = _window_shingles(bytes(row.words), row.n, size).tolist()
        offset = min(range(len(hashes)), key=lambda i: (counts.get(hashes[i], 0), hashes[i], i))
        by.setdefault(min(size, row.n), {}).setdefault(hashes[offset], []).append((offset, w))
    out = {}
    for k, entries in by.items():
        keys = np.array(sorted(entries), U64)
        out[k] = (keys, [entries[int(h)] for h in keys])
    return {"index": out, "windows": [(bytes(r.words), r.n, tuple(r.items)) for r in windows]}


def _hits(words: wb.Words, index: dict) -> tuple[np.ndarray, dict[int, set]]:
    """Which words of a slice are hit, and by text number the windows that occur."""
    windows = index["windows"]
    marks = np.zeros(len(words.hashes) + 1, np.int32)
    found: dict[int, set] = {}
    for k, (keys, entries) in index["index"].items():
        at, which = wb.lookup(wb.shingle_hashes(words.hashes, k), keys)
        text = np.searchsorted(words.first, at, side="right") - 1
        begin, end = words.first[text], words.first[text] + words.count[text]
        for p, e, t, lo, hi in zip(at.tolist(), which.tolist(), text.tolist(), begin.tolist(), end.tolist()):
            for offset, w in entries[e]:
                start, n = p - offset, windows[w][1]
                if start >= lo and start + n <= hi and words.joined(start, start + n) == windows[w][0]:
                    marks[start] += 1
                    marks[start + n] -= 1
                    found.setdefault(t, set()).add(w)
    return np.cumsum(marks[:-1]) > 0, found


def _scan(docs: DataFrame, index: dict) -> DataFrame:
    """Adds the hits of one block of windows to _hit (a bit for each word) and _items."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def run(batches):
        table = pickle.loads(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in wb.slices(texts):
                part = batch.slice(a, b - a)
                words = wb.split(texts[a:b], KIND)
                hit, found = _hits(words, table)
                bits, items = part.column("_hit").to_pylist(), part.column("_items").to_pylist()
                for i in sorted(found):
                    first, count = int(words.first[i]), int(words.count[i])
                    mine = np.packbits(hit[first : first + count])
                    bits[i] = (mine if bits[i] is None else mine | np.frombuffer(bits[i], np.uint8)).tobytes()
                    items[i] = sorted({*(items[i] or ()), *(x for w in found[i] for x in table["windows"][w][2])})
                columns = {f.name: part.column(f.name) for f in part.schema} | {"_n": pa.array(words.count.astype(np.int64)), "_hit": pa.array(bits, pa.binary()), "_items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return in_arrow(docs, run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, size: int = 5, block_windows: int = 200_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, with n_words, n_hit, hit_bits, item_ids (sorted).

    hit_bits has a bit for each word, most significant first; null where no word is hit.
    """
    plain = [F.col(c) for c in keep if c != "text"]
    rows = docs.select(*plain, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("_n"), F.lit(None).cast("binary").alias("_hit"), F.lit(None).cast("array<string>").alias("_items"))
    windows = materialise(item_windows(benchmark, window), "windows")
    blocks = -(-max(windows.count(), 1) // block_windows)
    for i in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i)
        if i:
            rows = materialise(rows, "hits")
        held = block.collect()
        shingles: dict[int, set] = {}
        for w in held:
            shingles.setdefault(min(size, w.n), set()).update(_window_shingles(bytes(w.words), w.n, size).tolist())
        counts = shingle_counts(docs, {k: np.array(sorted(v), U64) for k, v in shingles.items()}) if shingles else {}
        rows = _scan(rows, prefix_index(held, counts, size))
    # each hex digit of the bits becomes as many ones as it has
    ones = F.hex("_hit")
    for digit in range(16):
        ones = F.replace(ones, F.lit("%X" % digit), F.lit("." * bin(digit).count("1")))
    n_hit = F.coalesce(F.length(ones), F.lit(0)).cast("long")
    return rows.select(*[c for c in keep], F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.col("_hit").alias("hit_bits"), F.coalesce("_items", F.array().cast("array<string>")).alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs; all columns of docs."""
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.select(F.struct(*rest).alias("_row"), F.col("text"))
    found = contamination(whole, benchmark, keep=("_row", "text"), **options)
    fields = [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return found.where("n_hit = 0").select(*fields)
