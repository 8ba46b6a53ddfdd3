"""Data quality counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_count(df: DataFrame, column: str) -> DataFrame:
    """Number of NaN in one column; NULL is not counted."""
    return df.select(F.count(F.when(F.isnan(column), F.lit(1))).alias(f"{column}_NaN_count"))


def null_cells_total(df: DataFrame) -> DataFrame:
    """Number of NULL cells in the whole frame."""
    per_row = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("long") for c in df.columns))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0).cast("long")).alias("null_cells"))


def rows_with_any_null(df: DataFrame) -> DataFrame:
    """Rows with a NULL in any column."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in df.columns)))


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL and NaN counts of every column, one row per column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def counts(c: str) -> Column:
        nan = F.count(F.when(F.isnan(c), F.lit(1))) if c in floating else F.lit(0).cast("long")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.when(F.col(c).isNull(), F.lit(1))).alias("nulls"),
            nan.alias("nans"),
        )

    return df.agg(F.array(*(counts(c) for c in df.columns)).alias("profile")).select(F.inline("profile"))


def row_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def split_covers_all(split: DataFrame) -> DataFrame:
    """Sizes of the sets next to the number of all rows."""
    return split.agg(
        F.count(F.when(F.col("split") == "train", F.lit(1))).alias("n_train"),
        F.count(F.when(F.col("split") == "test", F.lit(1))).alias("n_test"),
        F.count("*").alias("n_all"),
    ).withColumn("covers_all", F.col("n_train") + F.col("n_test") == F.col("n_all"))
