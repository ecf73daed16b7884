"""Seeded test streams. SplitMix64 counts, so a draw needs no draw before it and rows are made side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.detectors import GAMMA, MIX1, MIX2

DRAWS = 12  # a sum of 12 uniform draws has variance 1


def unit_draws(seed: int, places: np.ndarray) -> np.ndarray:
    """The draws at the given places (from 0) of a seed's sequence, in [0, 1) by their top 53 bits."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        for shift, factor in ((30, MIX1), (27, MIX2)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _stream(spark: SparkSession, n: int, value, stream_id: int, step_ns: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("pos"), F.lit(stream_id).cast("long").alias("stream_id"), (i * step_ns).alias("ts_ns"), value.alias("value"), i.alias("seq"))


def uniform_noise(spark: SparkSession, n: int, seed: int, base: float = 50.0, scale: float = 0.05, stream_id: int = 1, step_ns: int = 1_000_000) -> DataFrame:
    """Messages of base, give or take scale."""

    @F.pandas_udf("double")
    def value(i: pd.Series) -> pd.Series:
        return pd.Series(base + (unit_draws(seed, i.to_numpy()) - 0.5) * 2.0 * scale)

    return _stream(spark, n, value(F.col("id")), stream_id, step_ns)


def near_gaussian(spark: SparkSession, n: int, seed: int, stream_id: int = 1, step_ns: int = 1_000_000) -> DataFrame:
    """Messages of 12 uniform draws' sum less 6: mean 0, variance 1."""

    @F.pandas_udf("double")
    def value(i: pd.Series) -> pd.Series:
        at = i.to_numpy() * DRAWS
        return pd.Series(sum(unit_draws(seed, at + k) for k in range(DRAWS)) - DRAWS / 2)

    return _stream(spark, n, value(F.col("id")), stream_id, step_ns)


def constant(spark: SparkSession, n: int, base: float = 50.0, stream_id: int = 1, step_ns: int = 1_000_000_000) -> DataFrame:
    return _stream(spark, n, F.lit(float(base)), stream_id, step_ns)


def shifted(spark: SparkSession, n: int, seed: int, onset: int, step: float = 0.0, slope: float = 0.0, skip: int = 0, stream_id: int = 1, step_ns: int = 1_000_000) -> DataFrame:
    """Messages of numpy's standard normal draws after `skip` others, raised by step from onset on and by slope more with each value
    after it. The draws depend on each other, so they are made on the driver: n is the size of a test stream."""
    values = np.random.default_rng(seed).normal(0, 1, skip + n)[skip:]
    values[onset:] += step + slope * np.arange(max(n - onset, 0))
    rows = [(i, stream_id, i * step_ns, float(x), i) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, stream_id long, ts_ns long, value double, seq long")
