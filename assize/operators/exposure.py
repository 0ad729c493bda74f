"""Single-subject flows, exposure scores, conflicts, timelines, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.stats import degree_decay, z_score


def subject_flow(df: DataFrame, subject: Column, period: Column, day: str, least_events: int = 5, least_days: int = 3, least_history: int = 20) -> DataFrame:
    """One row: a subject's rows and days in a period and before, and whether they admit a reading."""
    rows = df.where(subject).select(period.alias("now"), F.col(day).alias("day"))
    out = rows.agg(F.count_if("now").alias("events"), F.count_distinct(F.when(F.col("now"), F.col("day"))).alias("active_days"), F.count_if(~F.col("now")).alias("history_events"), F.count_distinct(F.when(~F.col("now"), F.col("day"))).alias("history_days"))
    mean = F.when(F.col("history_days") > 0, F.bround(F.col("history_events") / F.col("history_days"), 6))
    reading = F.when((F.col("events") >= least_events) & (F.col("active_days") >= least_days) & (F.col("history_events") >= least_history), "comparable").otherwise("inconclusive")
    return out.withColumn("history_mean", mean).withColumn("reading", reading)


def exposure_score(gap_days: Column, bias: Column, coverage: Column, n: Column) -> Column:
    """An additive score of nearness, lowered by selection bias and thin coverage; capped where rows are few."""
    near = F.when(gap_days <= 7, 0.5).when(gap_days <= 14, 0.35).when(gap_days <= 30, 0.2).when(gap_days <= 60, 0.1).otherwise(0.0)
    base = near + F.when(gap_days.isNotNull(), 0.3).otherwise(0.0)
    trust = F.when(coverage == "low", 0.5).when(coverage == "partial", 0.8).otherwise(1.0)
    score = base * F.when(bias, 0.7).otherwise(1.0) * trust
    return F.bround(F.when(n < 5, F.least(score, F.lit(0.29))).otherwise(score), 6)


def exposure_tier(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def conflicts(df: DataFrame, pair: list[str], degree: str, value: str, baseline: str, least: int = 3, flag_delta: float = 0.15) -> DataFrame:
    """Per pair: the rate less its baseline, decayed by the distance of the link; a flag where both suffice."""
    out = df.groupBy(*pair).agg(F.min(degree).alias("degree"), F.count(value).alias("n"), F.avg(value).alias("rate"), F.avg(baseline).alias("base"))
    delta = F.bround(F.col("rate") - F.col("base"), 6)
    risk = F.bround((F.col("rate") - F.col("base")) * degree_decay(F.col("degree")), 6)
    return out.select(*pair, "degree", "n", delta.alias("delta"), risk.alias("risk"), ((risk > flag_delta) & (F.col("n") >= least)).alias("red_flag"))


def timeline_features(df: DataFrame, case: str, date: str, kind: str, peers: str, least: int = 5) -> DataFrame:
    """Per case: rows, kinds, length and longest pause, and the share of its peers that last no longer."""
    w = W.partitionBy(case).orderBy(date)
    paused = df.withColumn("_pause", F.datediff(F.col(date), F.lag(date).over(w)))
    out = paused.groupBy(case, peers).agg(F.count("*").alias("events"), F.count_distinct(kind).alias("kinds"), F.datediff(F.max(date), F.min(date)).alias("days"), F.max("_pause").alias("longest_pause"))
    counted = out.groupBy(peers, "days").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(peers).orderBy("days")
    ranks = counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(W.partitionBy(peers)))
    share = F.when(F.col("_all") >= least, F.bround(F.col("_upto") / F.col("_all"), 6))
    return out.join(ranks, [peers, "days"]).select(case, peers, "events", "kinds", "days", "longest_pause", share.alias("peer_share"))


def cross_section(df: DataFrame, member: str, period: str, bar: float = 2.0) -> DataFrame:
    """Each member's rows in a period against all members' in it."""
    counts = df.groupBy(member, period).agg(F.count("*").alias("n"))
    w = W.partitionBy(period)
    z = z_score(F.col("n"), F.avg("n").over(w), F.stddev_pop("n").over(w))
    return counts.withColumn("z", z).withColumn("is_anomaly", F.col("z") > bar)


def weighted_baseline(df: DataFrame, group: str, stratum: str, value: str) -> DataFrame:
    """Per group: its rate, and the mean of all strata's rates weighted by the group's rows in each."""
    own = df.where(F.col(value).isNotNull()).groupBy(group, stratum).agg(F.count("*").alias("w"), F.sum(value).alias("s"))
    base = own.groupBy(stratum).agg((F.sum("s") / F.sum("w")).alias("b"))
    out = own.join(base, stratum).groupBy(group).agg(F.sum("w").alias("n"), (F.sum("s") / F.sum("w")).alias("r"), (F.sum(F.col("w") * F.col("b")) / F.sum("w")).alias("b"))
    return out.select(group, "n", F.bround("r", 6).alias("rate"), F.bround("b", 6).alias("baseline"), F.bround(F.col("r") - F.col("b"), 6).alias("delta"))
