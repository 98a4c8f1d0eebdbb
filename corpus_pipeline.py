"""A training corpus from raw documents, in five stages; each takes all its predecessor kept.

1. quality: the factorisation machine of isthmus.llm.quality; what it rejects goes.
2. line_dedup: later copies of line runs are cut out of the texts; a document of which
   nothing is left goes.
3. near_duplicates: SimHash over five-word shingles at a similarity of 0.8; the least
   doc_id of each group stays.
4. decontamination: documents with a benchmark phrase go.
5. packing: the rest becomes sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isthmus.llm import decontaminate, linedup, packing, quality, simhash
from isthmus.llm.common import discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a removed line pass unchanged, a null or empty text too; n_chars follows the text. Of the others what is left stays, so that every line removed keeps its first place."""
    found = linedup.deduplicated(docs.select(*COLUMNS))
    left = F.octet_length(F.coalesce("kept", F.lit("")))
    own = found.where((F.col("n_removed") == 0) | (left > 0))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return own.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id."""
    return simhash.representatives(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark phrase go as a whole. Rows are told apart by id and text, so that of rows of one id only those with a phrase go; equal rows fare alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.contaminated_spans(docs.select(row.alias("doc_id"), "text"), benchmark)
    # Written, so that Spark knows its size when it decides how to join.
    hit = written(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit")).distinct(), "hits")
    return docs.select(*COLUMNS).join(hit, row == hit["hit"], "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_copied_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


#: The classifier is a fitted model, which SQL cannot express.
ORACLE_SQL = None
