"""Quantile sketches that are kept, merged by adding, and asked for percentiles of a bounded relative error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The relative error of a percentile, and the size below which a value counts as zero.
ERROR, ZERO = 0.01, 1e-9


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket of a value: powers of a base wide enough for the error, by sign; in order of values. Null and NaN have none."""
    shift = math.ceil(-math.log(ZERO) / math.log(_gamma(error))) + 1
    power = F.ceil(F.log(F.abs(value)) / math.log(_gamma(error))) + shift
    return F.when(F.isnan(value), None).when(F.abs(value) < ZERO, F.lit(0)).otherwise(F.signum(value).cast("int") * power).cast("int")


def _middle(of: Column, error: float) -> Column:
    gamma = _gamma(error)
    shift = math.ceil(-math.log(ZERO) / math.log(gamma)) + 1
    return F.when(of == 0, 0.0).otherwise(F.signum(of) * 2 * F.exp((F.abs(of) - shift) * math.log(gamma)) / (gamma + 1))


def sketch(df: DataFrame, by: list[str], value: str, error: float = ERROR) -> DataFrame:
    """(by, bucket, n): a sketch a key. Its size hangs on the range of values (some 100 buckets a factor of 10), not on the number of rows."""
    return df.select(*by, bucket(F.col(value).cast("double"), error).alias("bucket")).where("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer keys as sketches of ``by``: the same as a sketch of all their rows."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], points: list[float], error: float = ERROR) -> DataFrame:
    """(by, n, p5, p50, ...): for every point the middle of the bucket that holds the value of rank floor(p (n - 1))."""
    order, key = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    placed = sketches.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(key)})
    at = [F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("bucket"))) for p in points]
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), *[F.bround(_middle(a, error), 6).alias(f"p{p * 100:g}") for a, p in zip(at, points)])
