"""Token ids in bit-plane files.

Texts are encoded with a public tokenizer, an end id follows each document, and
the stream of ids, in ascending doc_id order, is cut into blocks of a fixed
number of ids.  A block is transposed into planes (one for each byte, or each
bit, of an id) and every plane is compressed with zstandard.

A dataset is a folder with

* ``chunks``: Parquet, one row for each block: shard, chunk, first_token (its
  place in the shard), n_ids, planes (array of compressed planes), and the
  block's documents: ``doc_ids``, ``lengths`` (ids of each in this block),
  ``skipped`` (ids of the first one in earlier blocks), ``totals`` (ids of each
  whole document), first_ordinal;
* ``index``: Parquet, the same rows without the planes, and the bytes of each,
  so that a reader finds the chunk of any token or document;
* ``shards``: Parquet, first token and ids of each shard in the whole stream.

Range partitioning by doc_id makes shards that follow each other; Spark's
output commit makes a retried task's files count once.  A reader decodes each
chunk alone, so documents longer than a block and shards of any length need no
more memory than a block.

Defined results: a null or empty text is the end id alone; rows with a null
doc_id come first; repeated doc_ids are ordered by a hash of their text and
each keeps its own row.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import in_arrow


CHUNK_FIELDS = "shard int, chunk int, first_token long, n_ids int, kind string, planes array<binary>, first_ordinal long, skipped long, doc_ids array<long>, lengths array<int>, totals array<long>"


class Encoder:
    """Whole-text ids from the tokenizers library, with a memory of pieces.

    Between a character that is not white space and a following space the
    byte-level pre-tokenizer always cuts, and what it does with a piece depends
    on nothing outside it.  So texts are cut there, Arrow finds the distinct
    pieces, each new one is encoded by the library once, and all ids are gathered
    from the memory at once.  Texts with white space other than single spaces and
    line feeds inside pieces, and tokenizers of another kind, are encoded whole.
    """

    #: Characters that some library's rules count as white space.
    ODD_SPACE = (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

    def __init__(self, path: str, most_pieces: int = 300_000):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.pieces = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        special = "".join(f"|{re.escape(t['content'])}" for t in spec.get("added_tokens", []))
        # texts that must be encoded whole: a space first, beside another or behind a line feed, odd white space, special tokens
        self.whole = "^ |  |\n |[" + "".join(f"\\x{{{c:x}}}" for c in self.ODD_SPACE) + "]" + special
        if self.pieces:
            # a byte-level token has one character for each of its bytes
            self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.width[i] = len(token)
        self.most = most_pieces
        self._empty()

    def _forget(self):
        """Keeps the pieces that more than one slice of texts had since the last time."""
        often = np.flatnonzero(self.uses[: len(self.known)] > 1)
        pieces, counts = list(self.known), self.counts[often]
        flat = [self.held[a : a + n] for a, n in zip(self.starts[often].tolist(), counts.tolist())]
        self._empty()
        if len(often) <= self.most // 2:
            self._add([pieces[i] for i in often.tolist()], np.concatenate((self.held[:0], *flat)), counts)

    def _empty(self):
        # of piece number i, ids are held[starts[i] : starts[i] + counts[i]]
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.uses, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.used = 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has, of pieces that begin with a space: many go through the library as one text."""
        groups = [pieces[i : i + group] for i in range(0, len(pieces), group)]
        flat, counts = [], []
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            sizes = np.fromiter(map(len, map(str.encode, some)), np.int64, len(some))
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
            flat.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def _add(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray):
        first, n = len(self.known), len(pieces)
        self.known.update(zip(pieces, range(first, first + n)))
        for name, size in (("starts", first + n), ("counts", first + n), ("uses", first + n), ("held", self.used + len(flat))):
            old = getattr(self, name)
            if size > len(old):
                new = np.zeros(2 * size, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.held[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, without the space before them, of which new ones are encoded."""
        out = np.fromiter(map(self.known.get, pieces, _UNKNOWN), np.int64, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(out < 0).tolist()]
        if new:
            # only pieces that end in a visible character may stand before another one
            simple = [p for p in new if p[-1:] not in ("", "\n")]
            other = [p for p in new if p[-1:] in ("", "\n")]
            if simple:
                self._add(simple, *self._apart([" " + p for p in simple]))
            if other:
                ids = self._plain([" " + p for p in other])
                self._add(other, np.concatenate(ids), np.array([len(x) for x in ids]))
            out[out < 0] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.uses[out] += 1
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that can be cut, and how many each has."""
        if len(self.known) > self.most:
            self._forget()
        words = pc.split_pattern(texts, " ")
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        first = np.concatenate(([0], ends[:-1]))
        flat = words.flatten()
        seen = flat.dictionary_encode()
        numbers = self._numbers(seen.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(seen.indices)]
        # the first word of a text has no space before it: numbers and ids of its own, behind the known ones
        heads = self._plain(flat.take(pa.array(first)).to_pylist())
        n, sizes = len(self.known), np.array([len(h) for h in heads])
        numbers[first] = n + np.arange(len(heads))
        starts = np.concatenate((self.starts[:n], self.used + np.cumsum(sizes) - sizes))
        counts = np.concatenate((self.counts[:n], sizes))[numbers]
        held = np.concatenate((self.held[: self.used], *heads))
        done = np.cumsum(counts)
        where = starts[numbers]
        where -= done
        where += counts
        place = np.repeat(where, counts)
        place += np.arange(len(place))
        return held[place], np.diff(done[ends - 1], prepend=0)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; a null has none."""
        counts = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        filled = np.asarray(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
        whole = filled & (np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), self.whole)) if self.pieces else True)
        for mask, encode in ((filled & ~whole, self._cut), (whole, self._together)):
            at = np.flatnonzero(mask)
            if len(at):
                ids, counts[at] = encode(texts.take(pa.array(at)))
                parts.append((at, ids))
        if len(parts) == 1:
            return parts[0][1], counts
        out = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for at, ids in parts:
            n = counts[at]
            out[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, counts

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(texts.to_pylist())
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        ids, counts = self.encode_all(pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]


_UNKNOWN = repeat(-1)
#: Bytes of text encoded at once; what it takes besides is about 15 times as much.
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, most_bytes: int = SLICE_BYTES):
    """Ranges of consecutive texts of about `most_bytes`; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield begin, end
        begin = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file: later tasks of a worker find its pieces known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """Compressed planes of a block of ids, lowest first; planes above the block's highest id are left out."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    if kind == "byte":
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]
    elif kind == "bit":
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)) for k in range(bits)]
    else:
        raise ValueError(f"planes are byte or bit, not {kind}")
    return [press(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The block of n ids again, exactly."""
    import zstandard

    release = zstandard.ZstdDecompressor().decompress
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(release(plane), np.uint8)
        if kind == "byte":
            out |= raw.astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(k)
    return out


_CRC = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            p ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return p


def crc_followed(crc: int, n: int) -> int:
    """What a CRC-32 contributes to that of a longer string in which n more bytes follow (combine by xor)."""
    power, factor = 1 << 31, 1 << 23  # 1 and x**8
    while n:
        if n & 1:
            power = _times(factor, power)
        factor = _times(factor, factor)
        n >>= 1
    return _times(power, crc)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, block_ids: int = 1 << 16, kind: str = "byte", level: int = 3) -> None:
    """Encode docs (doc_id, text) and write the dataset at path, a folder that executors share."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").drop("tie")

    def run(batches):
        from pyspark import TaskContext

        shard, chunk, first_token, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        encode = encoder(tokenizer).encode_all
        room, parts = block_ids, []  # parts: (doc_id, ordinal, skipped, ids, total)

        def block():
            nonlocal chunk, first_token, room, parts
            ids = np.concatenate([p[3] for p in parts])
            row = {"shard": shard, "chunk": chunk, "first_token": first_token, "n_ids": len(ids), "kind": kind, "planes": to_planes(ids, kind, level), "first_ordinal": parts[0][1], "skipped": parts[0][2], "doc_ids": [p[0] for p in parts], "lengths": [len(p[3]) for p in parts], "totals": [p[4] for p in parts]}
            chunk, first_token, room, parts = chunk + 1, first_token + len(ids), block_ids, []
            return pa.RecordBatch.from_pylist([row], schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in CHUNK_FIELDS.split(", "))])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts):
                flat, counts = encode(texts.slice(a, b - a))
                flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                place = 0
                for doc, total in zip(ids[a:b], (counts + 1).tolist()):
                    at = 0
                    while at < total:
                        n = min(room, total - at)
                        parts.append((doc, ordinal, at, flat[place + at : place + at + n], total))
                        at, room = at + n, room - n
                        if not room:
                            yield block()
                    place += total
                    ordinal += 1
        if parts:
            yield block()

    in_arrow(rows, run, CHUNK_FIELDS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.drop("planes").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    # a row for each writing task, summed before; ordered on one task
    sums = index.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n_ids"), F.count(F.lit(1)).alias("chunks"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the dataset, decoded from the planes: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"], row["kind"]).astype("<u4")
                out, at = [], 0
                for k, (doc, n, total) in enumerate(zip(row["doc_ids"], row["lengths"], row["totals"])):
                    skipped = 0 if k else row["skipped"]
                    crc = zlib.crc32(ids[at : at + n].tobytes())
                    after = 4 * (total - skipped - n)
                    out.append((row["shard"], row["first_ordinal"] + k, doc, row["first_token"] + at, n, crc_followed(crc, after) if after else crc))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "ordinal", "doc_id", "place", "n", "crc"])

    columns = ["shard", "first_token", "n_ids", "kind", "planes", "first_ordinal", "skipped", "doc_ids", "lengths", "totals"]
    pieces = in_arrow(spark.read.parquet(f"{path}/chunks").select(*columns), run, "shard int, ordinal long, doc_id long, place long, n long, crc long")
    # the end part of a document's bytes contributes its CRC, earlier parts theirs moved to the left: the xor is the CRC of all
    whole = pieces.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    return whole.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk, decoded: shard, chunk, first_token, ids array<long>."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], row["kind"])
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["chunk"]], pa.int32()), pa.array([row["first_token"]], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["shard", "chunk", "first_token", "ids"])

    return in_arrow(spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "first_token", "n_ids", "kind", "planes"), run, "shard int, chunk int, first_token long, ids array<long>")
