"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets, queries into blocks.  A
query has a lower bound of its k-th score, from the bucket of the longest
vectors; in another bucket only vectors whose cosine with the query reaches
bound / (|query| * longest) can matter, its local threshold.  Buckets whose
threshold is over 1 are left out before any vector is moved; inside a bucket
each query is answered by

* coordinate pruning, where the threshold is high: from the query's largest
  coordinates follow intervals of the candidates' coordinates, looked up in
  sorted columns;
* length pruning, where only the longest of the bucket can reach the bound;
* products with the whole bucket else.

What is left is verified by exact integer products.  Each pair of a query
block and a bucket is a task's row, and returns at most k rows a query.

Defined results: vectors that are null, empty or hold null, NaN or infinite
components take no part, nor do rows with a null id; only vectors of equal
dimension are compared; all zero vectors score 0; repeated rows with the
query's id are its own; other repeated rows each take a rank.  Components and
scores saturate at the limits of 64 bits: with finite components of 2**30 and
more many scores can be the same largest number, and smaller ids come first.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_arrow, materialise

BUCKET = "bucket long, n int, dim int, longest double, shortest double, ids binary, data binary"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v array<long>, norm): floor(scale * x) of each component as double."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    whole = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    whole = whole.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    # floor gives longs, and the nearest one beyond their limits
    v = F.transform("x", lambda c: F.floor(F.least(F.greatest(c * F.lit(scale), F.lit(-(2.0**63))), F.lit(2.0**63))))
    return whole.select("id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, norm), longest first, in buckets of up to `size` vectors of one dimension."""

    def run(batches):
        from pyspark import TaskContext

        place, number, held = TaskContext.get().partitionId(), 0, {}

        def pack(dim, part):
            nonlocal number
            norms = [p[2] for p in part]
            row = [(place << 32) + number, len(part), dim, max(norms), min(norms), np.array([p[0] for p in part], "<i8").tobytes(), np.array([p[1] for p in part], "<i8").tobytes()]
            number += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["bucket", "n", "dim", "longest", "shortest", "ids", "data"])

        for batch in batches:
            for i, v, norm in zip(*(batch.column(k).to_pylist() for k in range(3))):
                part = held.setdefault(len(v), [])
                part.append((i, v, norm))
                if len(part) == size:
                    yield pack(len(v), held.pop(len(v)))
        for dim, part in held.items():
            yield pack(dim, part)

    ordered = rows.repartitionByRange(F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc(), "id")
    return in_arrow(ordered.select("id", "v", "norm"), run, BUCKET)


def _products(q: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products; `most` bounds their size."""
    if most < 2.0**52:
        return np.rint(q.astype(float) @ p.astype(float).T).astype(np.int64)
    # sums of Python's integers, saturated
    whole = [[sum(map(operator.mul, x, y)) for y in p.tolist()] for x in q.tolist()]
    return np.array([[min(max(v, -(1 << 63)), (1 << 63) - 1) for v in row] for row in whole], np.int64).reshape(len(q), len(p))


def search_bucket(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int, coordinates: int = 4, high: float = 0.8) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of a bucket for each query, those that reach the query's bound (-inf: none yet)."""
    qf, pf = q.astype(float), p.astype(float)
    q_norm, p_norm = np.linalg.norm(qf, axis=1), np.linalg.norm(pf, axis=1)
    order = np.lexsort((ids, -p_norm))
    ids, p, pf, p_norm = ids[order], p[order], pf[order], p_norm[order]
    longest = p_norm[0]
    slack = 1e-9
    out: list[tuple[int, int, int]] = []

    def best(i, rows, scores):
        keep = (ids[rows] != q_ids[i]) & (scores >= bounds[i])
        rows, scores = rows[keep], scores[keep]
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        for j in np.lexsort((ids[rows], -scores))[:k].tolist():
            out.append((int(q_ids[i]), int(ids[rows[j]]), int(scores[j])))

    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_norm > 0) & (longest > 0), bounds / (q_norm * longest), np.where(bounds > 0, np.inf, -np.inf))
    local = np.nan_to_num(local, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    columns: dict[int, tuple] = {}
    unit = pf / np.maximum(p_norm, 1e-300)[:, None]
    whole = []
    for i in range(len(q)):
        t = local[i]
        if t > 1 + slack:
            continue
        if t >= high and np.all(p_norm > 0):
            t = min(t, 1.0)
            focus = np.argsort(-np.abs(qf[i]))[:coordinates]
            left = None
            for f in focus.tolist():
                c = qf[i, f] / q_norm[i]
                half = np.arccos(t)
                angle = np.arccos(np.clip(c, -1, 1))
                low, top = np.cos(min(np.pi, angle + half)) - slack, np.cos(max(0.0, angle - half)) + slack
                if f not in columns:
                    o = np.argsort(unit[:, f], kind="stable")
                    columns[f] = (o, unit[o, f])
                o, values = columns[f]
                a, b = np.searchsorted(values, low), np.searchsorted(values, top, side="right")
                rows = o[a:b]
                left = rows if left is None else left[np.isin(left, rows, assume_unique=True)]
                if not len(left):
                    break
            if len(left):
                best(i, left, _products(q[i : i + 1], p[left], q_norm[i] * longest)[0])
        elif t > 0:
            n = int(np.searchsorted(-p_norm, -(bounds[i] / q_norm[i]) * (1 - slack), side="right"))
            if 2 * n < len(p):
                best(i, np.arange(n), _products(q[i : i + 1], p[:n], q_norm[i] * longest)[0])
            else:
                whole.append(i)
        else:
            whole.append(i)
    for a in range(0, len(whole), 256):
        some = whole[a : a + 256]
        scores = _products(q[some], p, float(q_norm[some].max() * longest))
        for i, row in zip(some, scores):
            best(i, np.arange(len(p)), row)
    return out


def _answers(pairs: DataFrame, k: int) -> DataFrame:
    """Best k of each (query block, bucket) row: query_id, vec_id, score."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q = np.frombuffer(r["q_data"], "<i8").reshape(-1, r["dim"])
                p = np.frombuffer(r["data"], "<i8").reshape(-1, r["dim"])
                bounds = np.frombuffer(r["bounds"], "<f8") if r["bounds"] is not None else np.full(len(q), -np.inf)
                got = search_bucket(np.frombuffer(r["q_ids"], "<i8"), q, bounds, np.frombuffer(r["ids"], "<i8"), p, k)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["query_id", "vec_id", "score"])

    return in_arrow(pairs.select("dim", "q_ids", "q_data", "bounds", "ids", "data"), run, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, *, bucket_size: int = 2048, block_size: int = 4096) -> DataFrame:
    """The k best candidates of each query, from (id, v, norm) tables: query_id, rank, vec_id, score."""
    buckets = materialise(_packed(candidates, bucket_size), "buckets")
    blocks = _packed(queries.dropDuplicates(["id"]), block_size)
    blocks = blocks.select(F.col("bucket").alias("block"), F.col("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    blocks = materialise(blocks, "blocks")
    # every query meets the bucket of the longest vectors of its dimension
    heads = buckets.groupBy("dim").agg(F.max_by("bucket", F.struct("longest", "bucket")).alias("bucket"))
    head = buckets.join(heads, ["dim", "bucket"])
    first = materialise(_answers(blocks.join(head, "dim").withColumn("bounds", F.lit(None).cast("binary")).repartition("block"), k), "first")
    reach = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)

    # bounds of each block, in the order of its queries; a block is no larger than block_size
    def unpack(batches):
        for batch in batches:
            for block, dim, ids, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
                q = np.frombuffer(ids, "<i8")
                norms = np.linalg.norm(np.frombuffer(data, "<i8").reshape(-1, dim).astype(float), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q), pa.array(norms)], names=["block", "place", "query_id", "norm"])

    places = in_arrow(blocks.select("block", "dim", "q_ids", "q_data"), unpack, "block long, place int, query_id long, norm double")
    least = F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    # the shortest vector that may reach a query's bound; any may where the bound is not positive
    needs = F.when(least > 0, least / F.col("norm")).otherwise(F.lit(float("-inf")))
    gathered = places.join(reach, "query_id", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", least.alias("t")))).alias("t"), F.min(needs).alias("needs"))

    def pack(batches):
        for batch in batches:
            ts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array([x["t"] for x in t], "<f8").tobytes() for t in ts], pa.binary()), batch.column(2)], names=["block", "bounds", "needs"])

    bounds = in_arrow(gathered, pack, "block long, bounds binary, needs double")
    bounded = materialise(blocks.join(bounds, "block"), "bounded")
    # a pair is left out if no vector of the bucket can reach the bound of any query of the block
    pairs = bounded.select("block", "dim", "needs").join(buckets.select("bucket", "dim", "longest"), "dim").join(heads.withColumnRenamed("bucket", "head"), "dim")
    pairs = pairs.where("bucket <> head and longest * (1 + 1e-9) >= needs").select("block", "bucket")
    rest = _answers(pairs.join(buckets, "bucket").join(bounded.select("block", "q_ids", "q_data", "bounds"), "block").repartition("block", "bucket"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
