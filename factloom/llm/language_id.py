"""Language identification by compression.

For each language a raw-content dictionary is made of slices of labelled texts.
A text goes to the language whose dictionary lets zstandard write it smallest;
where the margin over the second is narrow the prediction can be rejected.

Learning is bounded in rows and bytes: at most ``per_language`` labelled texts a
language, by hash of doc_id and so from all over the corpus, share the
``dictionary_bytes`` of a language equally.  Of a text longer than its share,
slices are taken at even distances from all of it, each beginning and ending
between words; what short texts leave unused goes to the others.  Languages are
learned up to ``most_languages``, more are an error.  Whole texts are predicted:
a long text is compressed in blocks, so that the dictionary counts throughout.

Defined results: a text that is null or has no letter (no character for which
str.isalpha() holds; digits, fractions and Roman numerals are none) is ``und``
with score 0; so is every text if no language could be learned; of equal sizes
the first language by code point wins; rows with null lang, text or doc_id teach
nothing; a row with a null doc_id is predicted like any other, and its held_out
in the query is null, as no remainder of its id exists.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_arrow

UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _shares(sizes: list[int], whole: int) -> list[int]:
    """How many bytes each text may give of `whole`: all alike, but no more than it has."""
    out, left, order = [0] * len(sizes), whole, sorted(range(len(sizes)), key=lambda i: sizes[i])
    for k, i in enumerate(order):
        out[i] = min(sizes[i], left // (len(order) - k))
        left -= out[i]
    return out


def spread_slices(text: str, share: int, slices: int = 4) -> str:
    """About `share` bytes of a text: all of it, or pieces at even distances over its whole length, cut between words."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= share:
        return text
    one, parts = max(share // slices, 1), []
    for k in range(slices):
        begin = (len(raw) - one) * k // max(slices - 1, 1)
        piece = raw[begin : begin + one].decode("utf-8", "ignore")
        inner = piece.split(" ")[1:-1]
        parts.append(" ".join(inner) if inner else piece)
    return "\n".join(parts)


def learn(docs: DataFrame, *, per_language: int = 400, dictionary_bytes: int = 64_000, most_languages: int = 200) -> dict[str, bytes]:
    """Dictionaries by language from docs (doc_id, text, lang), all of which may be used."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = [r.lang for r in known.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"over {most_languages} languages: raise most_languages, with so many dictionaries in every task")
    # ids first, so that no text is sorted or moved; the limit of each group also holds before the shuffle
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"))
    # at most per_language * most_languages rows of two values
    same = (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l"))
    rows = known.join(F.broadcast(chosen), same).select("doc_id", "lang", "text")

    # only what may enter a dictionary comes to the driver: no text gives more than the whole of it
    def cut(batches):
        for batch in batches:
            parts = [spread_slices(t.lower(), dictionary_bytes // 8, 16) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.string())], names=["doc_id", "lang", "part"])

    taught: dict[str, dict[str, int]] = {}
    for r in in_arrow(rows, cut, "doc_id long, lang string, part string").toLocalIterator():
        parts = taught.setdefault(r.lang, {})
        parts[r.part] = min(r.doc_id, parts.get(r.part, r.doc_id))
    out = {}
    for lang, seen in sorted(taught.items()):
        # zstandard reaches the end of a dictionary best: texts stand there in an order that depends on no place in the corpus
        parts = sorted(seen, key=lambda p: (zlib.crc32(p.encode("utf-8", "surrogatepass")), p))
        sizes = [len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts]
        out[lang] = "\n".join(spread_slices(p, n - 1) for p, n in zip(parts, _shares(sizes, dictionary_bytes)) if n > 1).encode("utf-8", "surrogatepass")
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *, min_margin: float = 0.0, block_bytes: int = 8192, level: int = 6, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score (0 to 1) and rejected.

    score is the margin: how much smaller the best is than the second, as a
    share of the second.  rejected tells that it is below min_margin.
    """
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", lang_pred string, score double, rejected boolean"
    names = sorted(dictionaries)

    def run(batches):
        import zstandard

        press = []
        for name in names:
            made = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            press.append(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

        def one(text):
            if not text or not names or not has_letter(text):
                return UNDETERMINED, 0.0
            raw = text.lower().encode("utf-8", "surrogatepass")
            blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
            sizes = [sum(len(p(b)) for b in blocks) for p in press]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for i, s in enumerate(sizes) if i != best), default=None)
            return names[best], 1.0 if second is None else (second - sizes[best]) / second

        for batch in batches:
            texts = batch.column("_text").to_pylist()
            got = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(keep))], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] < min_margin for g in got], pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"],
            )

    return in_arrow(rows, run, schema)
