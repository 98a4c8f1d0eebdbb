"""Sample tables: row_id BIGINT, ord BIGINT, features ARRAY<DOUBLE>, and label STRING, labels ARRAY<STRING> or target ARRAY<DOUBLE>.

Every reader selects the few columns it needs, so that they are all that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(df: DataFrame, row_id: str, features: list[str] | str, label: str | None = None, target: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Samples from the columns of any table; features: one array column, or several numeric ones."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    cols = [F.col(row_id).cast("long").alias("row_id"), F.col(order or row_id).cast("long").alias("ord"), x.alias("features")]
    if label is not None:
        cols.append(F.col(label).cast("string").alias("label"))
    if target is not None:
        cols.append(F.array(*(F.col(c).cast("double") for c in target)).alias("target"))
    return df.select(*cols)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def parts(spark: SparkSession, sf_dir: str, target: tuple[str, ...] = ("p_retailprice",)) -> DataFrame:
    return samples(read(spark, sf_dir, "part"), "p_partkey", ["p_size"], "p_brand", list(target))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01")))
    return samples(df, "o_orderkey", ["o_totalprice", "day"], "o_orderstatus", ["o_totalprice"])


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: features are lengths, labels the flags that are set (none: the label "none")."""
    flags = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"), F.length(F.regexp_replace("text", "[^\n]", "")).cast("double").alias("lines"))
    named = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.concat(F.lit("lang_"), F.col("lang"))), lambda v: v.isNotNull())
    x = F.array(F.round(F.ln(F.col("n") + 1), 9), F.round(F.ln(F.col("lines") + 1), 9))
    return docs.join(flags, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("ord"), x.alias("features"), named.alias("labels"))


def event_stream_schema() -> str:
    return "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def whitespace_text(spark: SparkSession, path: str) -> DataFrame:
    """A UCI-style file: a name, numbers and a label to a line, by white space; the name is left out."""
    words = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).where(F.trim("value") != "").withColumn("w", words)
    x = F.slice("w", F.lit(2), F.size("w") - 2).cast("array<double>")
    order = F.monotonically_increasing_id()
    return df.select(order.alias("row_id"), order.alias("ord"), x.alias("features"), F.element_at("w", -1).alias("label"))
