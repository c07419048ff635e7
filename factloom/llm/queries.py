"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, line_dedup, minmax_dedup, mixing, norm_buckets, token_planes, toxicity, unit_dedup
from .shared import table, workspace

#: Categories of the toxicity chain, in order, as conditions on a row of labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
TOXIC_FROM = 0.5
#: Repeated units go from 15 words on, shorter ones in runs of 40: notices of a line or two stay.
REPEATS = {"min_words": 5, "alone_words": 15, "run_words": 40}
#: Sentences are cut again at the least of 10 words on both sides, for passages that begin and end within sentences.
PIECES = 10


def vocabulary() -> str:
    """Path of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "tokens")
    token_planes.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_planes.read(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))).alias("names"), "licenses")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", (F.col("probs")[1] >= TOXIC_FROM).alias("toxic"), *[F.round(F.col("probs")[i], 6).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)])


def op4_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = norm_buckets.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return norm_buckets.top_k(rows, rows.where("id % 50 = 0"), 5)


def op5_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    dictionaries = language_id.learn(docs.where(~held))
    return language_id.predict(docs.withColumn("held_out", held), dictionaries, min_margin=0.01, keep=("doc_id", "held_out"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = unit_dedup.removed_spans(docs, pieces=PIECES, **REPEATS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(spans, "doc_id", "left")
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["begin"]), F.lit(0))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"), removed.cast("long").alias("chars_removed"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_token_planes, op2_license_scan, op3_toxicity_chain, op4_norm_buckets, op5_compression_language, op6_unit_dedup, op7_pivotal_mixing, op8_decontamination, op9_line_dedup, op10_minmax_dedup, pipeline]
    return {f.__name__: f for f in own}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE = {
    "op4_norm_buckets": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scores as (
            select q.vec_id as query_id, p.vec_id, list_inner_product(q.c, p.c)::bigint as score
            from v q join v p on q.vec_id % 50 = 0 and q.vec_id <> p.vec_id and len(q.c) = len(p.c)
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from scores qualify rank <= 5
    """,
    "op8_decontamination": f"""
        with item_words as (
            select item_id::varchar as item_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) as w from benchmark where text is not null
        ), windows as (
            select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
            from item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) where len(w) > 0
        ), lengths as (
            select distinct n from windows
        ), docs as (
            select row_number() over () as r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_ALNUM}), []) as w from documents
        ), found as (
            select r, i, x.n, windows.item_id
            from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as win from docs, lengths, unnest(range(1, len(w) - n + 2)) t(i)) x
            join windows on windows.n = x.n and windows.win = x.win
        ), hits as (
            select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r
        ), items as (
            select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from found group by r
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join hits using (r) left join items using (r)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
