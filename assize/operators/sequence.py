"""Ordered series: effects of runs, dense months, rolling rates, breaks, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.stats import z_score


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, least: int = 3) -> DataFrame:
    """Lag-1 autocorrelation of a 0/1 series per key; zero without variance."""
    w = W.partitionBy(*by)
    mean = F.avg(value).over(w)
    rows = df.withColumn("_dev", F.col(value) - mean).withColumn("_next", F.lead("_dev").over(w.orderBy(*order)))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_dev") * F.col("_next")).alias("cov"), F.sum(F.col("_dev") * F.col("_dev")).alias("var"))
    value_ = F.when((F.col("n") < 3) | (F.col("var") < 1e-12), 0.0).otherwise(F.col("cov") / F.col("var"))
    return sums.where(F.col("n") >= least).select(*by, "n", F.bround(value_, 6).alias("autocorrelation"))


def streak_effect(df: DataFrame, by: list[str], order: list[str], value: str, length: int, least: int = 3) -> DataFrame:
    """The mean of a 0/1 series right after ``length`` ones in a row, less its overall mean."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(-length, -1)
    rows = df.withColumn("run", F.sum(value).over(before))
    after = F.when(F.col("run") == length, F.col(value))
    sums = rows.groupBy(*by).agg(F.avg(value).alias("base"), F.count(after).alias("occurrences"), F.avg(after).alias("after"))
    effect = F.when(F.col("occurrences") >= least, F.bround(F.col("after") - F.col("base"), 6))
    return sums.select(*by, F.lit(length).alias("streak"), "occurrences", effect.alias("effect"))


def monthly(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Per key and month from its first to its last: rows and sum of ``value``, with empty months."""
    grouped = df.groupBy(*by, F.trunc(date, "MM").alias("month")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    spine = grouped.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = spine.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(grouped, [*by, "month"], "left").select(*by, "month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))


def rolling(months: DataFrame, by: list[str], size: int = 6) -> DataFrame:
    """The rate over the last ``size`` months of ``monthly`` rows."""
    w = W.partitionBy(*by).orderBy("month").rowsBetween(1 - size, 0)
    n = F.sum("n").over(w)
    return months.withColumn("rolling_n", n).withColumn("rolling_rate", F.when(n > 0, F.bround(F.sum("s").over(w) / n, 6)))


def scored(months: DataFrame, by: list[str]) -> DataFrame:
    """The month's rate and its z-score among the key's months."""
    w = W.partitionBy(*by)
    rated = months.withColumn("rate", F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    return rated.withColumn("z", z_score(F.col("rate"), F.avg("rate").over(w), F.stddev_pop("rate").over(w)))


def cusum(months: DataFrame, by: list[str], drift: float = 0.25, bar: float = 2.0, first: int = 5) -> DataFrame:
    """Two-sided cumulative sums of z-scores per key, clamped at zero; a break is a sum of ``bar`` or more from index ``first`` on.

    A fold over the key's months in order; months without rows count as the mean.
    """
    rows = scored(months, by).withColumn("z", F.coalesce("z", F.lit(0.0)))
    series = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("month", "z"))).alias("series"))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<struct<month:date,up:double,down:double>>").alias("path"))

    def step(state, x):
        up = F.greatest(F.lit(0.0), state["up"] + x["z"] - drift)
        down = F.greatest(F.lit(0.0), state["down"] - x["z"] - drift)
        return F.struct(up.alias("up"), down.alias("down"), F.concat(state["path"], F.array(F.struct(x["month"].alias("month"), up.alias("up"), down.alias("down")))).alias("path"))

    folded = series.select(*by, F.posexplode(F.aggregate("series", start, step)["path"]).alias("at", "p"))
    peak = F.greatest("p.up", "p.down")
    return folded.select(*by, "p.month", F.bround("p.up", 6).alias("cusum_up"), F.bround("p.down", 6).alias("cusum_down"), ((peak >= bar) & (F.col("at") >= first)).alias("is_break"))


def year_over_year(df: DataFrame, by: list[str], year: str, value: str) -> DataFrame:
    """The change of a yearly rate against the very year before."""
    yearly = df.groupBy(*by, F.col(year).alias("year")).agg(F.count(value).alias("n"), F.avg(value).alias("rate"))
    before = yearly.select(*by, (F.col("year") + 1).alias("year"), F.col("rate").alias("rate_before"))
    return yearly.join(before, [*by, "year"], "left").select(*by, "year", "n", F.bround("rate", 6).alias("rate"), F.bround(F.col("rate") - F.col("rate_before"), 6).alias("delta"))


def seasonality(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """The rate of each calendar month less the key's overall rate."""
    grouped = df.groupBy(*by, F.month(date).alias("calendar_month")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    w = W.partitionBy(*by)
    overall = F.sum("s").over(w) / F.sum("n").over(w)
    return grouped.select(*by, "calendar_month", "n", F.bround(F.col("s") / F.col("n") - overall, 6).alias("delta"))


def around_events(df: DataFrame, date: str, value: str, events: DataFrame, days: int = 180, least: int = 5) -> DataFrame:
    """For a few dated events (event, event_date): the rate in the days before and after, the day itself left out of both ends but the start.

    The event list is a small table of the caller's; each row meets the events whose window it falls into.
    """
    gap = F.datediff(F.col(date), F.col("event_date"))
    near = df.join(F.broadcast(events), gap.between(-days, days))
    early, late = gap < 0, gap > 0
    out = near.groupBy("event", "event_date").agg(
        F.count(F.when(early, F.col(value))).alias("n_before"), F.avg(F.when(early, F.col(value))).alias("before"),
        F.count(F.when(late, F.col(value))).alias("n_after"), F.avg(F.when(late, F.col(value))).alias("after"),
    )
    delta = F.when((F.col("n_before") >= least) & (F.col("n_after") >= least), F.bround(F.col("after") - F.col("before"), 6))
    return out.select("event", "event_date", "n_before", "n_after", delta.alias("delta"))


def changes(df: DataFrame, by: list[str], order: list[str], member: str) -> DataFrame:
    """Rows at which the member differs from the last known one of the key."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("previous", F.last(member, True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return rows.where(F.col(member).isNotNull() & F.col("previous").isNotNull() & (F.col(member) != F.col("previous")))


def after_change(df: DataFrame, by: list[str], order: list[str], member: str, value: str, outcome: str, least: int = 3, flag_delta: float = 0.15) -> DataFrame:
    """For each change of member: outcomes and rate of the new member from there to the key's end, against all it decides anywhere.

    All rows with an ``outcome`` count, and for the flag's ``least``; the rate is that of the rows with a ``value``.

    Counts run from the back of each (key, member), so nothing is joined with its own history.
    """
    rows = df.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    back = W.partitionBy(*by, member).orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({"_n": F.count(outcome).over(back), "_v": F.count(value).over(back), "_s": F.sum(value).over(back)})
    turned = changes(summed, by, order, member)
    base = df.where(F.col(value).isNotNull()).groupBy(F.col(member).alias("new_member")).agg(F.avg(value).alias("_base"))
    out = turned.select(*by, F.col("seq").alias("from_seq"), F.col(member).alias("new_member"), "previous", F.col("_n").alias("n"), (F.col("_s") / F.when(F.col("_v") > 0, F.col("_v"))).alias("_rate")).join(base, "new_member", "left")
    delta = F.bround(F.col("_rate") - F.col("_base"), 6)
    flag = F.coalesce((delta > flag_delta) & (F.col("n") >= least), F.lit(False))
    return out.select(*by, "from_seq", "new_member", "previous", "n", F.bround("_rate", 6).alias("rate"), delta.alias("delta"), flag.alias("red_flag"))


def percentiles(df: DataFrame, by: list[str], value: str, points: list[float], least: int = 10) -> DataFrame:
    """Exact interpolated percentiles per key, in columns p5, p50 and so on.

    Equal values are counted before they are shuffled, and running counts tell where a percentile lies, so no buffer holds a key's values.
    """
    order, key = W.partitionBy(*by).orderBy("_x").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    placed = counted.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(key)}).where(F.col("_all") >= least)
    out = [F.sum("_n").alias("n")]
    for p in points:
        at = F.lit(p) * (F.col("_all") - 1)
        low, high = (F.min(F.when(F.col("_upto") > part, F.col("_x"))) for part in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(f"p{p * 100:g}"))
    return placed.groupBy(*by).agg(*out)


def percentile_flags(df: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95, least: int = 10) -> DataFrame:
    """Each row against its peers: below the low percentile, above the high one, and its distance from the median in spreads."""
    peers = percentiles(df, by, value, [low, 0.5, high], least).toDF(*by, "peers", "p_low", "p_mid", "p_high")
    spread = F.greatest(F.col("p_high") - F.col("p_low"), F.lit(1.0))
    out = df.where(F.col(value).isNotNull()).join(peers, by)
    flag = F.when(F.col(value) < F.col("p_low"), "low").when(F.col(value) > F.col("p_high"), "high").otherwise("normal")
    return out.withColumn("flag", flag).withColumn("distance", F.bround((F.col(value) - F.col("p_mid")) / spread, 6))


def greedy_durations(df: DataFrame, by: list[str], order: list[str], date: str, opens, closes) -> DataFrame:
    """Days between each opening row and the next closing row that no earlier opening has taken, per key, first in first out.

    Running counts tell all: a closing is in vain if it brings the closings further above the openings than ever
    before; of those that are not, the r-th takes the r-th opening.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.where(opens | closes).select(*by, *[c for c in order if c not in by], F.col(date).cast("date").alias("day"), opens.alias("is_open"))
    counted = rows.withColumns({"opened_n": F.sum(F.col("is_open").cast("int")).over(w), "closed_n": F.sum((~F.col("is_open")).cast("int")).over(w)})
    vain = counted.withColumn("vain", F.greatest(F.max(F.col("closed_n") - F.col("opened_n")).over(w), F.lit(0)))
    before = F.coalesce(F.lag("vain").over(W.partitionBy(*by).orderBy(*order)), F.lit(0))
    told = vain.withColumn("met", ~F.col("is_open") & (F.col("vain") == before))
    openings = told.where("is_open").select(*by, F.col("opened_n").alias("r"), F.col("day").alias("opened"))
    closings = told.where("met").select(*by, (F.col("closed_n") - F.col("vain")).alias("r"), F.col("day").alias("closed"))
    return openings.join(closings, [*by, "r"]).select(*by, (F.col("r") - 1).cast("int").alias("number"), "opened", "closed", F.datediff("closed", "opened").alias("days"))
