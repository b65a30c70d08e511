"""Gaussian sources at known distances from their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed


def shifted(df: DataFrame, seed: int, key: list[str], shift: Column, dimensions: int) -> DataFrame:
    """`df` with x1 …: standard normal numbers keyed by the columns `key`, the first one shifted."""
    z = lambda k: keyed.normal(seed, *[F.col(c) for c in key], F.lit(k))
    return df.select("*", (z(1) + shift).alias("x1"), *[z(k).alias(f"x{k}") for k in range(2, dimensions + 1)])


def gaussian_cases(spark: SparkSession, conditions: DataFrame, repetitions: int, dimensions: int, seed: int) -> DataFrame:
    """Trials of every repetition of every condition.

    conditions: scenario, source (0: the target), true (squared distance, any for the target), n. Columns: case_id,
    source, is_target, i, x1 …; the first dimension is shifted by the root of `true`. Numbers are keyed, so any partition
    makes its own rows and nothing is shuffled.
    """
    r = conditions.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    target = F.col("source") == 0
    t = shifted(r, seed, ["scenario", "rep", "source", "i"], F.when(target, 0.0).otherwise(F.sqrt("true")), dimensions)
    return t.select(F.concat_ws("/", "scenario", "rep").alias("case_id"), "source", target.alias("is_target"), "i", *[f"x{k}" for k in range(1, dimensions + 1)])
