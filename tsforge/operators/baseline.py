"""Linear baseline for the task of the network: scaled look-ahead extremes from a feature window."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.session import cut_lineage


def window_regression(
    vectors: DataFrame,
    targets: tuple[str, ...] = ("y_min_scaled", "y_max_scaled"),
    l1: float = 1e-4,
    l2: float = 1e-4,
    max_iter: int = 50,
) -> DataFrame:
    """Fit each target on split = 'train' with L1 + L2 penalty; return MSE per target and split.

    Samples without a scaled target (a flat window) cannot be learned from and are not used. The
    learner passes over its input many times, so the vectors are written once first.
    """
    vectors = cut_lineage(vectors.select("features", "split", *targets))
    penalty = l1 + l2
    share = l1 / penalty if penalty else 0.0
    reports = []
    for target in targets:
        known = vectors.filter(F.col(target).isNotNull() & F.col("split").isNotNull())
        learner = LinearRegression(
            featuresCol="features", labelCol=target, predictionCol="predicted",
            regParam=penalty, elasticNetParam=share, maxIter=max_iter,
        )
        model = learner.fit(known.filter("split = 'train'"))
        error = F.col(target) - F.col("predicted")
        reports.append(
            model.transform(known)
            .groupBy("split")
            .agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"))
            .select(F.lit(target).alias("target"), "split", "n", "mse")
        )
    return reduce(DataFrame.unionByName, reports)
