"""Rates of outcomes: smoothed, leave-one-out, stratified, by group and member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.rules import group_status
from assize.functions.stats import chi2_p_bracket, posterior_mean


def favorable_rate(outcome: Column) -> Column:
    """The share of favourable ones among outcomes that are favourable or unfavourable."""
    return F.avg(F.when(outcome == "favorable", 1.0).when(outcome == "unfavorable", 0.0))


def counts(outcome: Column) -> list[Column]:
    return [F.count_if(outcome == "favorable").alias("favorable"), F.count_if(outcome == "unfavorable").alias("unfavorable")]


def smoothed(df: DataFrame, group: list[str], outcome: str, least: int = 5, most: int = 5000) -> DataFrame:
    """Per group: numbers of outcomes, raw and smoothed rates, and whether its size admits comparison."""
    grouped = df.groupBy(*group).agg(F.count("*").alias("n"), *counts(F.col(outcome)))
    decided = F.col("favorable") + F.col("unfavorable")
    rates = grouped.withColumns({"smoothed_rate": posterior_mean(F.col("favorable"), decided), "raw_rate": F.when(decided > 0, F.bround(F.col("favorable") / decided, 6))})
    return rates.withColumn("status", group_status(F.col("n"), least, most))


def leave_one_out(df: DataFrame, group: list[str], member: str, outcome: str, least_members: int = 2, least_rows: int = 10) -> DataFrame:
    """Per group and member: the smoothed rate of all other members, as totals less its own numbers."""
    own = df.groupBy(*group, member).agg(F.count("*").alias("own_n"), *counts(F.col(outcome)))
    w = W.partitionBy(*group)
    totals = own.withColumns({"group_n": F.sum("own_n").over(w), "members": F.count("*").over(w), "all_f": F.sum("favorable").over(w), "all_u": F.sum("unfavorable").over(w)})
    kept = totals.where((F.col("members") >= least_members) & (F.col("group_n") >= least_rows))
    rest_f, rest_u = F.col("all_f") - F.col("favorable"), F.col("all_u") - F.col("unfavorable")
    return kept.select(*group, member, "own_n", (F.col("group_n") - F.col("own_n")).alias("rest_n"), posterior_mean(rest_f, rest_f + rest_u).alias("loo_rate"))


def leave_one_out_distribution(df: DataFrame, group: list[str], member: str, value: str, least_members: int = 2, least_rows: int = 10) -> DataFrame:
    """Long form of each member's distribution of values among the others of its group: (group, member, value, n)."""
    own = df.groupBy(*group, member, value).agg(F.count("*").alias("own"))
    members = own.groupBy(*group, member).agg(F.sum("own").alias("rows"))
    w = W.partitionBy(*group)
    members = members.withColumns({"m": F.count("*").over(w), "t": F.sum("rows").over(w)}).where((F.col("m") >= least_members) & (F.col("t") >= least_rows)).select(*group, member)
    totals = own.groupBy(*group, value).agg(F.sum("own").alias("total"))
    dense = members.join(totals, group).join(own, [*group, member, value], "left")
    rest = (F.col("total") - F.coalesce("own", F.lit(0))).alias("n")
    return dense.select(*group, member, value, rest).where("n > 0")


def stratified(df: DataFrame, fine: list[str], coarse: list[str], outcome: str, least: int = 10) -> DataFrame:
    """Per fine cell its rate if it has enough decided rows, else that of its coarse cell."""
    decided = df.where(F.col(outcome).isin("favorable", "unfavorable"))
    cells = decided.groupBy(*fine).agg(F.count("*").alias("cell_n"), F.bround(favorable_rate(F.col(outcome)), 6).alias("cell_rate"))
    wide = decided.groupBy(*coarse).agg(F.bround(favorable_rate(F.col(outcome)), 6).alias("coarse_rate"))
    rate = F.coalesce(F.when(F.col("cell_n") >= least, F.col("cell_rate")), F.col("coarse_rate"))
    return cells.join(wide, coarse, "left").select(*fine, "cell_n", rate.alias("rate"), F.when(F.col("cell_n") >= least, "cell").otherwise("coarse").alias("basis"))


def histogram(df: DataFrame, group: list[str], value: str, top: int | None = None) -> DataFrame:
    """Counts of values per group, ranked; ties by value. ``top`` keeps the first ones."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), value))
    out = df.groupBy(*group, value).agg(F.count("*").alias("n")).withColumn("rank", rank)
    return out.where(F.col("rank") <= top) if top else out


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The commonest value per group, the smallest among equals, and whether there was a tie."""
    ranked = histogram(df, group, value)
    ties = F.count("*").over(W.partitionBy(*group, "n"))
    return ranked.withColumn("tied", ties > 1).where("rank = 1").select(*group, F.col(value).alias("modal_value"), "n", "tied")


def uniformity(df: DataFrame, group: list[str], member: str, least: int = 50) -> DataFrame:
    """Chi-square of members' counts per group against even shares."""
    own = df.groupBy(*group, member).agg(F.count("*").alias("n"))
    grouped = own.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("members"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max_by(member, F.struct("n", member)).alias("most_common"))
    # sum of (n - e)^2 / e with e = total / members
    chi2 = F.bround(F.col("squares") * F.col("members") / F.col("total") - F.col("total"), 6)
    out = grouped.where((F.col("total") >= least) & (F.col("members") >= 2)).withColumn("chi2", chi2).withColumn("df", F.col("members") - 1)
    return out.select(*group, "total", "members", "most_common", "chi2", "df", chi2_p_bracket(F.col("chi2"), F.col("df")).alias("p_bracket"))


def against_group(df: DataFrame, group: list[str], member: str, value: str, least: int = 30) -> DataFrame:
    """Per member: chi-square of its values against its group's distribution, and the value it departs in most."""
    own = df.groupBy(*group, member, value).agg(F.count("*").alias("obs"))
    totals = own.groupBy(*group, value).agg(F.sum("obs").alias("value_n")).withColumn("group_n", F.sum("value_n").over(W.partitionBy(*group))).where(F.col("group_n") >= least)
    members = own.groupBy(*group, member).agg(F.sum("obs").alias("member_n"))
    dense = members.join(totals, group).join(own, [*group, member, value], "left").withColumn("obs", F.coalesce("obs", F.lit(0)))
    expected = F.col("value_n") * F.col("member_n") / F.col("group_n")
    delta = F.col("obs") / F.col("member_n") - F.col("value_n") / F.col("group_n")
    parts = dense.withColumns({"part": (F.col("obs") - expected) ** 2 / expected, "delta": F.bround(delta, 9)})
    out = parts.groupBy(*group, member).agg(
        F.first("member_n").alias("member_n"), F.bround(F.sum("part"), 6).alias("chi2"), (F.count("*") - 1).alias("df"),
        F.max_by(F.struct(F.col(value).alias("v"), "delta"), F.struct(F.abs("delta"), F.col(value))).alias("most"),
    )
    return out.select(*group, member, "member_n", "chi2", "df", chi2_p_bracket(F.col("chi2"), F.col("df")).alias("p_bracket"), F.col("most.v").alias("direction"), F.bround("most.delta", 6).alias("direction_delta"))
