"""Money and counterparties: totals, concentration, spans, best names; origins and recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def donor_rollup(df: DataFrame, donor: str, receiver: str, date: str, amount: str, strata: list[str]) -> DataFrame:
    """Per donor: number, sum, mean and largest of donations, span of days, and the largest share that one value of each stratum has.

    One pass sums by donor and every stratum's value at once (grouping sets); the shares are maxima of those sums.
    """
    total = df.groupBy(donor).agg(
        F.count("*").alias("donations"), F.bround(F.sum(amount), 2).alias("total"), F.bround(F.avg(amount), 6).alias("mean"), F.max(amount).alias("largest"),
        F.count_distinct(receiver).alias("receivers"), F.datediff(F.max(date), F.min(date)).alias("span_days"),
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])).alias("s")
    sums = df.select(donor, F.col(amount).alias("amount"), pairs).groupBy(donor, "s.stratum", "s.value").agg(F.sum("amount").alias("part"))
    shares = sums.groupBy(donor).pivot("stratum", strata).agg(F.bround(F.max("part") / F.sum("part"), 6)).select(donor, *[F.col(s).alias(f"top_share_{s}") for s in strata])
    return total.join(shares, donor)


def counterparty_rollup(df: DataFrame, key: str, name: str, sequence: list[str], amount: str, preferred) -> DataFrame:
    """Per counterparty: payments, their sum, and its best name: the last preferred one, else the first of all."""
    out = df.groupBy(key).agg(
        F.count("*").alias("payments"), F.bround(F.sum(amount), 2).alias("total"),
        F.max_by(F.when(preferred, F.col(name)), F.when(preferred, F.struct(*sequence))).alias("_last"), F.min_by(name, F.struct(*sequence)).alias("_first"),
    )
    return out.select(key, "payments", "total", F.coalesce("_last", "_first").alias("best_name"))


def recurrence(df: DataFrame, pair: list[str], case: str, date: str, least: int = 2) -> DataFrame:
    """Pairs that meet in ``least`` cases or more, with the first and last day."""
    out = df.groupBy(*pair).agg(F.count_distinct(case).alias("cases"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    return out.where(F.col("cases") >= least)


def shares_of_origin(df: DataFrame, origins: str, totals: DataFrame, key: str) -> DataFrame:
    """Rows per origin, where a row may have several, over the origin's own total."""
    counted = df.select(F.explode(origins).alias(key)).groupBy(key).agg(F.count("*").alias("rows"))
    return counted.join(totals, key).select(key, "rows", "total", F.bround(F.col("rows") / F.col("total"), 6).alias("share"))
