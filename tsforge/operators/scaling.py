"""Per-sample scaling and assembly of the five feature channels."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.functions.vectors import (
    ExtraFeature,
    one_step_change,
    standardise,
    window_moments,
)

CHANNELS = ("z_price", "z_volume", "z_extra", "sine", "cosine")


def with_moments(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Mean and population deviation per sample of every {name: array column}."""
    both = df.withColumns({f"_{n}": window_moments(F.col(a)) for n, a in arrays.items()})
    parts = {f"{n}_{part}": F.col(f"_{n}.{part}") for n in arrays for part in ("mean", "std")}
    return both.withColumns(parts).drop(*(f"_{n}" for n in arrays))


def zscore_window(df: DataFrame, array: str, name: str) -> DataFrame:
    """Standardised window next to its moments (name_mean, name_std)."""
    scaled = standardise(F.col(array), F.col(f"{name}_mean"), F.col(f"{name}_std"))
    return df.withColumn(f"z_{name}", scaled)


def scale_targets(df: DataFrame, by: str = "price") -> DataFrame:
    """Look-ahead extremes in units of the price look-back."""
    mean, std = F.col(f"{by}_mean"), F.col(f"{by}_std")
    return df.withColumns({
        "y_min_scaled": F.try_divide(F.col("y_min") - mean, std),
        "y_max_scaled": F.try_divide(F.col("y_max") - mean, std),
    })


def scale_path(df: DataFrame, by: str = "price") -> DataFrame:
    """Whole look-ahead path in units of the price look-back."""
    scaled = standardise(F.col("y_path"), F.col(f"{by}_mean"), F.col(f"{by}_std"))
    return df.withColumn("y_path_scaled", scaled)


def unscale(value: Column, mean: Column, std: Column) -> Column:
    """Back to original units."""
    return value * std + mean


def with_extra_feature(df: DataFrame, extra: ExtraFeature = one_step_change, steps: int | None = None) -> DataFrame:
    """Add x_extra, a plug-in feature computed from each price window and its number of steps.

    The default stands in for a feature whose definition is not public: the change from step to
    step inside the window.
    """
    return df.withColumn("x_extra", extra(F.col("x_price"), steps))


def scale_samples(
    windows: DataFrame, extra: ExtraFeature = one_step_change, steps: int | None = None
) -> DataFrame:
    """All scaled columns of a sample: channels, targets, path and the moments to undo them."""
    df = with_extra_feature(windows, extra, steps)
    arrays = {"price": "x_price", "volume": "x_volume", "extra": "x_extra", "path": "y_path"}
    df = with_moments(df, arrays)
    for name in ("price", "volume", "extra"):
        df = zscore_window(df, f"x_{name}", name)
    return scale_path(scale_targets(df))


def feature_tensor(scaled: DataFrame) -> DataFrame:
    """Replace the window columns by one array<struct> with five channels per step."""
    named = scaled.withColumnsRenamed({"x_sine": "sine", "x_cosine": "cosine"})
    dropped = [c for c in named.columns if c.startswith("x_") or c in CHANNELS]
    return named.withColumn("tensor", F.arrays_zip(*CHANNELS)).drop(*dropped)


def tensor_long(tensors: DataFrame, *keys: str) -> DataFrame:
    """One row per sample and step."""
    return tensors.select(*keys, F.posexplode("tensor").alias("step", "_s")).select(
        *keys, "step", *(F.col(f"_s.{c}").alias(c) for c in CHANNELS)
    )


def feature_vectors(tensors: DataFrame) -> DataFrame:
    """Tensor flattened step by step to one ML vector.

    A channel without variation has no z-score; every value of it equals the mean, so it enters as 0.
    """
    flat = F.flatten(
        F.transform("tensor", lambda s: F.array(*(F.coalesce(s[c], F.lit(0.0)) for c in CHANNELS)))
    )
    return tensors.withColumn("features", array_to_vector(flat)).drop("tensor")


def tensor_shape(tensors: DataFrame) -> DataFrame:
    """Input shape derived from the data: samples, steps and channels."""
    return tensors.agg(
        F.count("*").alias("n_samples"),
        F.max(F.size("tensor")).alias("n_timepoints"),
    ).withColumn("n_features", F.lit(len(CHANNELS)))
