"""Checks of sample tables, each one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from isthmus.functions.vectors import non_finite


def feature_report(samples: DataFrame, column: str = "features") -> DataFrame:
    """One row: n_rows, min_size, max_size, non_finite (rows with a null, NaN or infinite entry)."""
    x = F.col(column)
    return samples.agg(F.count("*").alias("n_rows"), F.min(F.size(x)).alias("min_size"), F.max(F.size(x)).alias("max_size"), F.count_if(non_finite(x)).alias("non_finite"))


def check_features(samples: DataFrame, column: str = "features") -> tuple[int, int]:
    """Rows and features of a table whose features are finite and of one length; ValueError otherwise."""
    kind = samples.schema[column].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, NumericType):
        raise ValueError(f"{column} must be a 2D array: an array of numbers in every row")
    r = feature_report(samples, column).first()
    if r["non_finite"]:
        raise ValueError(f"{column} must contain only finite values")
    if r["n_rows"] and r["min_size"] != r["max_size"]:
        raise ValueError(f"{column} must be a 2D array: rows have {r['min_size']} to {r['max_size']} entries")
    return r["n_rows"], r["max_size"] or 0


def targets(samples: DataFrame, column: str = "target") -> DataFrame:
    """The table with its target as an array of doubles; a single number becomes an array of one."""
    kind = samples.schema[column].dataType
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, NumericType):
            raise ValueError(f"{column} must be numeric")
        return samples.withColumn(column, F.col(column).cast("array<double>"))
    if not isinstance(kind, NumericType):
        raise ValueError(f"{column} must be numeric")
    return samples.withColumn(column, F.array(F.col(column).cast("double")))


def is_multilabel(samples: DataFrame, column: str = "label") -> bool:
    """Whether a row has several labels: by type, as strings and bytes are atomic."""
    return isinstance(samples.schema[column].dataType, ArrayType)


def minmax_scaled(samples: DataFrame, column: str = "features") -> DataFrame:
    """Each feature scaled to [0, 1] over the table; a constant one becomes 0.

    One aggregate of 2 d columns without a shuffle of rows; its one row goes into the plan as literals.
    """
    head = samples.select(F.size(column).alias("d")).first()
    if head is None or head["d"] < 1:
        return samples
    x = F.col(column)
    ends = samples.agg(*(f(x[i]).alias(f"{n}{i}") for i in range(head["d"]) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def scaled(i: int) -> Column:
        lo, hi = float(ends[f"lo{i}"]), float(ends[f"hi{i}"])
        return (x[i] - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)

    return samples.withColumn(column, F.array(*(scaled(i) for i in range(head["d"]))))
