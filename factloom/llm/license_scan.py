"""License scan: min-hash bands over overlapping windows, then exact containment.

Templates are texts of licenses and license statements.  A document is scanned
in overlapping windows for each template length L: a window begins every
stride s = max(1, L // 4) words and has L + s words, so any occurrence lies
whole in one window.  Templates are retrieved by bands of min-hashes of windows,
and confirmed by exact containment: the share of the template's distinct
shingles that the window holds.

What the bands promise: a template of m = L - 4 shingles and a window of
w = L + s - 4 that holds a share c of them have a similarity of
c m / (w + m - c m) at least, which at the threshold of 0.8 is 0.495 or more for
every length; bands of ``rows`` values out of ``bands`` then find it with
probability 1 - (1 - 0.495 ** rows) ** bands, by default 1 - 1.4e-4.
``tests/llm`` measures it on windows of that containment.

Only windows that hold some template shingle are hashed, which loses none: others
have an empty intersection, and no band of theirs could match but by a hash
collision.  The templates are a table of the call (by default public license
texts by sections, and statements; see licenses.py), so what is sent out doesn't
grow with the corpus; one pass, no shuffle.

Defined results: null and empty texts hold nothing; a template of fewer words
than a shingle is one shingle of its own length; of overlapping windows that
hold one template the best is reported, the earlier if equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .licenses import TEMPLATES
from .shared import in_arrow

U64 = np.uint64

class Index:
    """Templates by band key, for each template length."""

    def __init__(self, templates: dict[str, str], size: int, bands: int, rows: int):
        self.size, self.bands, self.rows = size, bands, rows
        self.factors = wb.constants(bands * rows, 0x11CE) | U64(1)
        self.names = sorted(templates)
        self.sets, self.by_length = [], {}
        for t, name in enumerate(self.names):
            words = wb.split([templates[name]], "alnum")
            n = len(words.hashes)
            k = min(size, n)
            shingles = np.unique(wb.shingle_hashes(words.hashes, k)[: n - k + 1]) if n else np.empty(0, U64)
            self.sets.append(shingles)
            if n:
                self.by_length.setdefault(n, {"k": k, "stride": max(1, n // 4), "templates": [], "table": {}})["templates"].append(t)
        for spec in self.by_length.values():
            spec["keys"] = np.unique(np.concatenate([self.sets[t] for t in spec["templates"]]))
            for t in spec["templates"]:
                for key in self.band_keys(self.sets[t][None, :])[0].tolist():
                    spec["table"].setdefault(key, set()).add(t)

    def band_keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, bands) keys of a (windows, shingles) table of hashes; repeats in a row don't matter."""
        out = np.empty((len(windows), self.bands), U64)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                key = np.full(len(windows), b + 1, U64)
                for r in range(self.rows):
                    key = wb.mix(key * U64(0x100000001B3) + (windows * self.factors[b * self.rows + r]).min(axis=1))
                out[:, b] = key
        return out

    def scan(self, words: wb.Words, text: int, threshold: float) -> list[tuple[str, float, int, int]]:
        """(name, score, first byte, end) of what one text holds; bytes of the slice's data."""
        first, count = int(words.first[text]), int(words.count[text])
        hashes = words.hashes[first : first + count]
        best: dict[int, list[tuple[float, int, int]]] = {}
        for n, spec in self.by_length.items():
            k, stride = spec["k"], spec["stride"]
            if count < k:
                continue
            shingles = wb.shingle_hashes(hashes, k)[: count - k + 1]
            at, _ = wb.lookup(shingles, spec["keys"])
            if not len(at):
                continue
            wide = n + stride - k + 1  # shingles of a window
            starts = set()
            for i in np.unique(at // stride).tolist():
                starts.update(range(max(0, i - (wide + stride - 1) // stride), i + 1))
            starts = np.array(sorted(starts)) * stride
            # a window that reaches beyond the text ends with its last shingle again
            rows = shingles[np.minimum(starts[:, None] + np.arange(wide)[None, :], len(shingles) - 1)]
            for start, row, keys in zip(starts.tolist(), rows, self.band_keys(rows).tolist()):
                for t in set().union(*(spec["table"].get(key, ()) for key in keys)):
                    inside = np.isin(row, self.sets[t])
                    score = len(np.unique(row[inside])) / len(self.sets[t])
                    if score >= threshold:
                        held = np.flatnonzero(inside)
                        a, b = first + start + int(held[0]), min(first + start + int(held[-1]) + k, first + count)
                        best.setdefault(t, []).append((score, int(words.starts[a]), int(words.ends[b - 1])))
        out = []
        for t, found in best.items():
            taken: list[tuple[int, int]] = []
            for score, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    out.append((self.names[t], score, a, b))
        return sorted(out, key=lambda x: (x[2], x[0], x[3]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, size: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with licenses array<struct<name, score, begin, end>>, in order; begin and end are UTF-8 bytes of the text."""
    index = Index(TEMPLATES if templates is None else templates, size, bands, rows)
    table = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "_text")
    kind = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))
    everything = np.unique(np.concatenate([s for s in index.sets if len(s)] or [np.empty(0, U64)]))

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in wb.slices(texts):
                words = wb.split(texts[a:b], "alnum")
                seen: set[int] = set()
                for k in {s["k"] for s in index.by_length.values()}:
                    at, _ = wb.lookup(wb.shingle_hashes(words.hashes, k), everything)
                    seen.update(np.unique(np.searchsorted(words.first, at, side="right") - 1).tolist())
                offsets = np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 if t else 1 for t in texts[a:b]])))
                out = [[{"name": n, "score": s, "begin": x - int(offsets[i]), "end": y - int(offsets[i])} for n, s, x, y in index.scan(words, i, threshold)] if i in seen else [] for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(keep))], pa.array(out, kind)], names=[*keep, "licenses"])

    return in_arrow(table, run, kept + ", licenses array<struct<name:string,score:double,begin:bigint,end:bigint>>")
