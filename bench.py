"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from tsforge.catalog import candle_queries, spot_queries  # noqa: F401  (they register the queries)
from tsforge.catalog import fixtures as fx
from tsforge.catalog.registry import QUERIES
from tsforge.config import PrepConfig
from tsforge.plans.candle_features import prepare
from tsforge.session import local_session


def feature_tensor_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published geometry: minute bars, 120 steps back, 15 ahead, every 30th sample."""
    return prepare(fx.bars(spark, sf_dir, "Minute"), fx.shift_lookup(spark), PrepConfig()).samples


def feature_tensor_minute_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every sample kept."""
    config = PrepConfig(reduce_vector_sizes=False)
    return prepare(fx.bars(spark, sf_dir, "Minute"), fx.shift_lookup(spark), config).samples


HEADLINE = {
    "feature_tensor_minute": feature_tensor_minute,
    "feature_tensor_minute_all": feature_tensor_minute_all,
    **{
        name: QUERIES[name]
        for name in (
            "bars_from_events", "sample_moments", "resample_mean", "acf", "choose_d", "arima_grid_fit",
            "dedupe_union",
        )
    },
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name, build in HEADLINE.items():
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
