"""Label sets as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .validation import is_multilabel


def from_indicator(samples: DataFrame, column: str = "indicator") -> DataFrame:
    """labels: the positions of the ones of a 0/1 array; any other value raises."""
    bad = F.exists(column, lambda v: v.isNull() | ~v.isin(0, 1))
    index = F.transform(column, lambda v, i: F.when(v == 1, i.cast("string")))
    found = F.filter(index, lambda v: v.isNotNull())
    return samples.withColumn("labels", F.when(bad, F.raise_error("indicator entries must be 0 or 1").cast("array<string>")).otherwise(found))


def normalized(samples: DataFrame, column: str = "labels") -> DataFrame:
    """labels as distinct strings, from an array or a single label; a row without any raises."""
    labels = F.col(column).cast("array<string>") if is_multilabel(samples, column) else F.array(F.col(column).cast("string"))
    labels = F.array_distinct(F.filter(labels, lambda v: v.isNotNull()))
    empty = labels.isNull() | (F.size(labels) == 0)
    return samples.withColumn("labels", F.when(empty, F.raise_error("every row needs a label").cast("array<string>")).otherwise(labels))


def exploded(samples: DataFrame) -> DataFrame:
    """A row for each label of each sample: what prototypes of several labels are fitted on."""
    return samples.withColumn("label", F.explode("labels")).drop("labels")


def dimension(samples: DataFrame) -> DataFrame:
    """label, idx: labels by their first row. The window runs over the distinct labels only."""
    first = exploded(samples.select("row_id", "ord", "labels")).groupBy("label").agg(F.min("ord").alias("first_ord"), F.count("*").alias("support"))
    return first.withColumn("idx", F.row_number().over(Window.orderBy("first_ord", "label")) - 1)


def pair_rows(samples: DataFrame) -> DataFrame:
    """y, b, n: rows that carry y and not b, for each ordered pair of labels with such rows.

    From counts of labels and of label pairs within rows, so that no join of rows is needed; the
    labels, which are few, come to the driver and go out as one array.
    """
    one = exploded(samples.select("row_id", "labels")).groupBy(F.col("label").alias("y")).agg(F.count("*").alias("n_y"))
    names = sorted(r["y"] for r in one.select("y").collect())
    both = samples.select(F.explode("labels").alias("y"), "labels").select("y", F.explode("labels").alias("b")).groupBy("y", "b").agg(F.count("*").alias("n_both"))
    pairs = one.select("y", "n_y", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("b")).where("y <> b")
    return pairs.join(both, ["y", "b"], "left").select("y", "b", (F.col("n_y") - F.coalesce("n_both", F.lit(0))).alias("n")).where("n > 0")
