"""Flows: cubes over filters, history before a period, days against their mean, coverage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL = "*"


def flow_cube(df: DataFrame, dims: list[str], period: str, kind: str, day: str) -> DataFrame:
    """Rows and days for every subset of ``dims``, each period or all, each kind or all.

    A dimension that is not filtered reads ``*``. Null kinds take part where the kind is not filtered. Rows are
    summed by day first; the grouping sets keep the day, so its count needs no distinct over raw rows.
    """
    named = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims], F.col(period).cast("string").alias(period), F.col(kind).cast("string").alias(kind), F.col(day).alias("day"))
    keys = [*dims, period, kind]
    summed = named.groupBy(*keys, "day").agg(F.count("*").alias("n"))
    sets = [[*some, "day"] for size in range(len(keys) + 1) for some in combinations(keys, size)]
    flags = [F.grouping(k).alias(f"_{k}") for k in keys]
    daily = summed.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "day").agg(*flags, F.sum("n").alias("n"))
    cube = daily.groupBy(*keys, *[f"_{k}" for k in keys]).agg(F.sum("n").alias("events"), F.count("day").alias("active_days"))
    return cube.where(f"_{kind} = 1 or {kind} is not null").select(*[F.when(F.col(f"_{k}") == 1, ALL).otherwise(F.col(k)).alias(k) for k in keys], "events", "active_days")


def history(df: DataFrame, by: list[str], period: str, day: str) -> DataFrame:
    """Per key and period: rows and days in it, and in all periods before. A day belongs to one period, so days add up."""
    grouped = df.groupBy(*by, period).agg(F.count("*").alias("events"), F.count_distinct(day).alias("days"))
    w = W.partitionBy(*by).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    return grouped.withColumns({"history_events": F.coalesce(F.sum("events").over(w), F.lit(0)), "history_days": F.coalesce(F.sum("days").over(w), F.lit(0))})


def days_against_mean(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Rows a day, less and over the key's mean of its active days."""
    daily = df.groupBy(*by, F.col(day).alias("day")).agg(F.count("*").alias("events"))
    mean = F.avg("events").over(W.partitionBy(*by))
    return daily.select(*by, "day", "events", F.bround(F.col("events") - mean, 6).alias("delta"), F.bround(F.col("events") / mean, 6).alias("ratio"))


def segments(df: DataFrame, names: list[str], current) -> DataFrame:
    """Rows now and before for each value of several columns at once: (segment, value, current, historical)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(n).cast("string").alias("value")) for n in names])).alias("s")
    each = df.select(pairs, current.alias("now"))
    return each.groupBy("s.segment", "s.value").agg(F.count_if("now").alias("current"), F.count_if(~F.col("now")).alias("historical"))


def coverage(df: DataFrame, by: list[str], date: str, high: float = 0.6, some: float = 0.3) -> DataFrame:
    """Per key and month: days with rows over the month's Mondays to Fridays, as a tier."""
    month = F.trunc(date, "MM").alias("month")
    grouped = df.groupBy(*by, month).agg(F.count("*").alias("events"), F.count_distinct(F.when(F.weekday(date) < 5, F.to_date(date))).alias("active"))
    workdays = F.size(F.filter(F.sequence("month", F.last_day("month")), lambda d: F.weekday(d) < 5))
    ratio = F.col("active") / F.col("workdays")
    return grouped.withColumn("workdays", workdays).withColumn("ratio", F.bround(ratio, 6)).withColumn("tier", F.when(ratio >= high, "high").when(ratio >= some, "partial").otherwise("low"))
