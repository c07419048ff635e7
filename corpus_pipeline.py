"""A training-data pipeline of five stages; each is written as Parquet and read again as the next one's documents.

toxicity -> near duplicates -> benchmark decontamination -> mixing -> token files.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, minmax_dedup, mixing, token_planes, toxicity
from factloom.llm.queries import CATEGORIES, TOXIC_FROM, vocabulary
from factloom.llm.shared import table, workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    names = docs.columns
    rest = [c for c in names if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_row"), "text")
    scored = toxicity.score(rows, chain, keep=("_row", "text"))
    kept = scored.where(F.col("probs")[list(CATEGORIES).index("toxic")] < TOXIC_FROM)
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minmax_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files, read back: doc_id, start, n_tokens, ids_crc32."""
    path = workspace(spark, "tokens")
    token_planes.write(docs, path, vocabulary())
    return token_planes.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Learned scores, hashed draws and a tokenizer: SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = workspace(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
