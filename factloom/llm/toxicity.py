"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; the model of a category sees the words of a
text and the probabilities of all earlier categories.  In training those are
out-of-fold predictions, so a later model sees what it will see of new texts.

Features are the presence of words and of word beginnings, by 64-bit hash.  The
chain is fitted by one task from at most ``most_labelled`` labelled documents
(in hash order of doc_id).  It gets of each at most ``most_distinct`` hashes,
those smallest by hash, which is every one of a text of a thousand words; so
what it holds is bounded, however long the texts are.  The driver gets only the
chain, a few kilobytes: beside its JVM there is little room.  Models
use the ``most_features`` features of the largest chi-square; out-of-fold
predictions come from features and weights that know nothing of their fold.  The
chain is applied to whole texts in one pass.

Defined results: texts that are null or have no words have no features, and get
the models' intercepts; labels that contradict each other by doc_id count as the
larger one; a category's null labels teach that category nothing, and all others
what they say; without labelled rows all probabilities are 0; rows with a null
doc_id are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .shared import in_arrow

U64 = np.uint64
BEGINNINGS = (4, 5, 6)


def _features(texts: list[str | None]):
    """(text number, feature hash) of all words and word beginnings, with repeats."""
    words = wb.split(texts, "alnum", BEGINNINGS)
    owner = np.repeat(np.arange(len(texts)), words.count)
    owners, hashes = [owner], [words.hashes]
    for at, made in words.beginnings:
        owners.append(owner[at])
        hashes.append(made)
    return np.concatenate(owners), np.concatenate(hashes)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of a regularised logistic regression (Newton steps, halved where they don't help)."""
    n, d = x.shape
    x1 = np.concatenate((x, np.ones((n, 1), x.dtype)), axis=1).astype(float)
    ridge = np.full(d + 1, l2)
    ridge[d] = 1e-6
    w = np.zeros(d + 1)
    base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[d] = np.log(base / (1 - base))
    if y.min() == y.max():
        return w

    def loss(w):
        z = x1 @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum()

    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        grad = x1.T @ (p - y) + ridge * w
        bend = (x1.T * np.maximum(p * (1 - p), 1e-6)) @ x1 + np.diag(ridge)
        step = np.linalg.solve(bend, grad)
        for size in (1.0, 0.5, 0.25, 0.1):
            if (then := loss(w - size * step)) < now:
                break
        else:
            break
        w, gain, now = w - size * step, now - then, then
        if gain < 1e-6 * max(now, 1.0):
            break
    return w


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # of each category: features, earlier categories, intercept

    def predict(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n, categories) from distinct (text, feature number) pairs."""
        out = np.zeros((n, len(self.categories)))
        d = len(self.features)
        for c, w in enumerate(self.weights):
            z = np.bincount(owner, weights=w[feature], minlength=n) + w[-1]
            if c:
                z = z + out[:, :c] @ w[d : d + c]
            out[:, c] = _sigmoid(z)
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, most_labelled: int = 8000, most_features: int = 320, most_distinct: int = 4_000, folds: int = 5) -> Chain:
    """Fit a chain; categories: name -> SQL condition over a row of labels, in chain order."""
    names = list(categories)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(F.expr(f"cast({categories[c]} as int)")).alias(f"_{i}") for i, c in enumerate(names)])
    known = known.where(F.coalesce(*[F.col(f"_{i}") for i in range(len(names))]).isNotNull()).orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    # at most most_labelled rows of a few numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_id")
    rows = rows.select("_id", F.array(*[F.col(f"_{i}") for i in range(len(names))]).alias("y"), "text")

    def run(batches):
        for batch in batches:
            ids, ys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in wb.slices(texts):
                owner, hashes = _features(texts[a:b])
                out = [np.unique(hashes[owner == i])[:most_distinct].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), ys.slice(a, b - a), pa.array(out, pa.binary())], names=["id", "y", "seen"])

    def learn(batches):
        got = []
        for batch in batches:
            got += zip(*(batch.column(k).to_pylist() for k in range(3)))
            # repeated rows of a doc_id may be more than that
            if len(got) > 2 * most_labelled:
                got = sorted(got, key=lambda r: (r[0], r[2]))[:most_labelled]
        if got:
            features, weights = _learned(sorted(got, key=lambda r: (r[0], r[2]))[:most_labelled], len(names), most_features, folds)
            yield pa.RecordBatch.from_arrays([pa.array([features.tobytes()]), pa.array([[w.tobytes() for w in weights]])], names=["features", "weights"])

    seen = in_arrow(rows, run, "id long, y array<int>, seen binary")
    row = in_arrow(seen.repartition(1), learn, "features binary, weights array<binary>").first()
    if row is None:
        return Chain(names, np.empty(0, U64), [np.full(c + 1, -40.0) for c in range(len(names))])
    return Chain(names, np.frombuffer(bytes(row.features), U64), [np.frombuffer(bytes(w)) for w in row.weights])


def _learned(got: list[tuple[int, list[int | None], bytes]], categories: int, most_features: int, folds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features and weights of a chain from (doc_id, labels, feature hashes) of each document."""
    y = np.array([[np.nan if v is None else v for v in r[1]] for r in got], float)
    fold = np.array([hash_fold(r[0], folds) for r in got])
    sets = [np.frombuffer(r[2], U64) for r in got]
    n, owner, flat = len(got), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets]), np.concatenate(sets)
    del sets
    tokens = np.unique(flat)
    token = np.empty(len(flat), np.int32)
    for k in range(0, len(flat), 1 << 20):
        token[k : k + (1 << 20)] = np.searchsorted(tokens, flat[k : k + (1 << 20)])
    del flat
    everything = np.ones(n, bool)
    chosen = best_features(owner, token, len(tokens), y, everything, most_features)
    probs, weights = np.zeros((n, categories)), []
    # features of each fold, chosen without it
    without = {f: best_features(owner, token, len(tokens), y, fold != f, most_features) for f in range(folds)}
    for c in range(categories):
        rows = ~np.isnan(y[:, c])
        x = np.concatenate((presence(owner, token, n, chosen), probs[:, :c]), axis=1)
        weights.append(fit_linear(x[rows], y[rows, c]) if rows.any() else np.append(np.zeros(x.shape[1]), -40.0))
        # out-of-fold predictions, for the categories that follow
        for f in range(folds if c + 1 < categories else 0):
            held, kept = fold == f, rows & (fold != f)
            if held.any() and kept.any():
                x = np.concatenate((presence(owner, token, n, without[f]), probs[:, :c]), axis=1)
                w = fit_linear(x[kept], y[kept, c])
                probs[held, c] = _sigmoid(x[held] @ w[:-1] + w[-1])
    return tokens[chosen], weights


def best_features(owner: np.ndarray, token: np.ndarray, n_tokens: int, y: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the features with the largest chi-square of presence against any category, over the given rows."""
    best = np.zeros(n_tokens)
    for c in range(y.shape[1]):
        known = rows & ~np.isnan(y[:, c])
        n = known.sum()
        if not n:
            continue
        total, pos = np.zeros(n_tokens), np.zeros(n_tokens)
        for k in range(0, len(token), 1 << 20):
            some, rows_ = token[k : k + (1 << 20)], owner[k : k + (1 << 20)]
            at = known[rows_]
            total += np.bincount(some[at], minlength=n_tokens)
            pos += np.bincount(some[at], weights=y[rows_[at], c], minlength=n_tokens)
        base = y[known, c].mean()
        spread = np.maximum(total * (1 - total / n) * base * (1 - base), 1e-9)
        best = np.maximum(best, np.where(total >= 3, (pos - total * base) ** 2 / spread, 0))
    return np.sort(np.argsort(-best, kind="stable")[:most])


def presence(owner: np.ndarray, token: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """(n, features) of zeros and ones."""
    out = np.zeros((n, len(chosen)), np.float32)
    for k in range(0, len(token) if len(chosen) else 0, 1 << 20):
        some = token[k : k + (1 << 20)]
        place = np.minimum(np.searchsorted(chosen, some), len(chosen) - 1)
        at = chosen[place] == some
        out[owner[k : k + (1 << 20)][at], place[at]] = 1
    return out


def hash_fold(doc_id: int, folds: int) -> int:
    return int(wb.mix(np.array([doc_id & 0xFFFFFFFFFFFFFFFF], U64))[0] % U64(folds))


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with probs array<double>, in the order of the chain."""
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", probs array<double>"

    def run(batches):
        features = chain.features
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in wb.slices(texts):
                part = batch.slice(a, b - a)
                owner, hashes = _features(texts[a:b])
                at, which = wb.lookup(hashes, features)
                pairs = np.unique(owner[at] * max(len(features), 1) + which)
                probs = chain.predict(pairs // max(len(features), 1), pairs % max(len(features), 1), b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(list(probs), pa.list_(pa.float64()))], names=[*keep, "probs"])

    return in_arrow(rows, run, schema)
