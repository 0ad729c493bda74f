"""Scores: rarity against baselines, alerts, compound risk, affinity, alternative means, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.rules import group_status


def rarity(
    df: DataFrame, key: str, group: list[str], member: str, dims: list[str], stratum: str | None = None, by_stratum: str | None = None, suppressed: dict[str, Column] | None = None,
    noise: float = 0.40, least: int = 5, most: int = 5000, loo_rows: int = 10, conclusive: int = 10, least_stratum: int = 5,
) -> DataFrame:
    """Mean rarity of every row's values within its group.

    A value's rarity is one less its share of the group; where the group has two members and ``loo_rows`` rows,
    the row's own member's rows are left out of it, and with them its distributions. The dimension ``by_stratum``
    is held against the rows of the same ``stratum`` if these are ``least_stratum``, else against the group; the
    pair of both counts as a dimension of its own. Shares of ``noise`` or more are left out first, unless all are;
    then dimensions that a rule of procedure explains (``suppressed``: a condition each, under ``pair`` that of the pair).
    Where none is left all dimensions count, noise too. Few rows behind a score, a single dimension, or any that was
    suppressed make it inconclusive.

    Rows are counted by their combination of values; all shares come from these counts, and one join hands the
    scores back.
    """
    values = list(dict.fromkeys([*dims, *([stratum] if stratum else []), *([by_stratum] if by_stratum else [])]))
    rules = {d: F.coalesce(c, F.lit(False)).alias(f"no_{d}") for d, c in (suppressed or {}).items()}
    rows = df.select(key, *group, member, *values, *rules.values())
    kinds = [*group, member, *values, *[f"no_{d}" for d in rules]]
    cells = rows.groupBy(*kinds).agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(W.partitionBy(*by))
    first = (F.row_number().over(W.partitionBy(*group, member).orderBy("n")) == 1).cast("int")
    cells = cells.withColumns({"group_n": total(*group), "own_n": total(*group, member), "_first": first}).withColumn("members", F.sum("_first").over(W.partitionBy(*group)))
    cells = cells.where(group_status(F.col("group_n"), least, most) == "valid")
    without = (F.col("members") >= 2) & (F.col("group_n") >= loo_rows)
    rest = lambda every, own: F.when(without, F.col(every) - F.col(own)).otherwise(F.col(every))
    cells = cells.withColumn("base_n", rest("group_n", "own_n"))
    sets = {d: [d] for d in dims} | ({"_stratum": [stratum], "_pair": [stratum, by_stratum]} if stratum else {})
    for name, by in sets.items():
        cells = cells.withColumns({f"all_{name}": total(*group, *by), f"own_{name}": total(*group, member, *by)})
    part = lambda d, known, share: F.when(known, F.struct(share.alias("p"), (F.col(f"no_{d}") if d in rules else F.lit(False)).alias("explained")))
    shown = [part(d, F.col(d).isNotNull(), rest(f"all_{d}", f"own_{d}") / F.col("base_n")) for d in dims if d != by_stratum]
    if stratum:
        enough = rest("all__stratum", "own__stratum") >= least_stratum
        share = F.when(enough, rest("all__pair", "own__pair") / rest("all__stratum", "own__stratum")).otherwise(rest(f"all_{by_stratum}", f"own_{by_stratum}") / F.col("base_n"))
        known = F.col(by_stratum).isNotNull()
        shown += [part(by_stratum, known, share), part("pair", known & F.col(stratum).isNotNull(), share)]
    cells = cells.withColumn("shares", F.array_compact(F.array(*shown)))
    sharp = F.filter("shares", lambda x: x["p"] < noise)
    cells = cells.withColumn("kept", F.when(F.size(sharp) > 0, sharp).otherwise(F.col("shares")))
    left = F.filter("kept", lambda x: ~x["explained"])
    cells = cells.withColumns({"used": F.when(F.size(left) > 0, left).otherwise(F.col("shares")), "noted": F.size(left) < F.size("kept")})
    score = 1 - F.aggregate("used", F.lit(0.0), lambda s, x: s + x["p"]) / F.size("used")
    kind = F.when((F.col("base_n") < conclusive) | (F.size("used") < 2) | F.col("noted"), "inconclusive").otherwise("atypical")
    scored = cells.where(F.size("shares") > 0).select(*[F.col(c).alias(f"c_{c}") for c in kinds], "group_n", "base_n", F.size("used").alias("dims_used"), F.bround(score, 6).alias("score"), kind.alias("kind"))
    same = F.lit(True)
    for c in kinds:
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return rows.join(scored, same).select(key, *group, member, "group_n", "base_n", "dims_used", "score", "kind")


def alerts(scores: DataFrame, bar: float = 0.75) -> DataFrame:
    return scores.where(F.col("score") >= bar)


def affinity(df: DataFrame, left: str, right: str, stratum: str, case: str, favorable: str, least_cases: int = 2, flag_cases: int = 5, flag_delta: float = 0.15) -> DataFrame:
    """Pairs' rates against what each side has over the strata the pair meets in; sums per (side, stratum), never raw rows."""
    good, n = F.sum(F.when(F.col(favorable) == 1, 1).otherwise(0)), F.count(favorable)
    pairs = df.groupBy(left, right, stratum).agg(F.count_distinct(case).alias("cases"), n.alias("n"), good.alias("f"))
    side = lambda c: df.groupBy(c, stratum).agg(n.alias(f"{c}_n"), good.alias(f"{c}_f"))
    met = pairs.join(side(left), [left, stratum]).join(side(right), [right, stratum])
    out = met.groupBy(left, right).agg(F.sum("cases").alias("cases"), *[F.sum(c).alias(c) for c in ("n", "f", f"{left}_n", f"{left}_f", f"{right}_n", f"{right}_f")])
    rate = F.col("f") / F.col("n")
    deltas = [F.bround(rate - F.col(f"{c}_f") / F.col(f"{c}_n"), 6).alias(f"delta_{k}") for k, c in (("left", left), ("right", right))]
    out = out.where((F.col("cases") >= least_cases) & (F.col("n") > 0)).select(left, right, "cases", F.bround(rate, 6).alias("rate"), *deltas)
    return out.withColumn("red_flag", (F.col("cases") >= flag_cases) & (F.col("delta_left") > flag_delta) & (F.col("delta_right") > flag_delta))


def compound(signals: DataFrame, by: list[str], families: dict[str, str]) -> DataFrame:
    """Signals of many sources (by, signal, strength) gathered by key and ranked; two families or more are a red flag."""
    family = F.col("signal")
    for name, group in families.items():
        family = F.when(F.col("signal") == name, group).otherwise(family)
    out = signals.withColumn("family", family).groupBy(*by).agg(
        F.count_distinct("signal").alias("signal_count"), F.count_distinct("family").alias("family_count"), F.bround(F.max("strength"), 6).alias("max_strength"),
        F.bround(F.sum("strength"), 6).alias("sum_strength"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"),
    )
    return out.withColumn("red_flag", F.col("family_count") >= 2)



def ranked(compound_rows: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Compound rows by flag, signals, families, strengths, then key."""
    out = compound_rows.orderBy(F.desc("red_flag"), F.desc("signal_count"), F.desc("family_count"), F.desc("max_strength"), F.desc("sum_strength"), *by)
    return out.limit(limit) if limit else out


def alternative_means(df: DataFrame, key: str, values: list[str], noise: float = 0.4) -> DataFrame:
    """Several means of a row's rarities: arithmetic, filtered, geometric, harmonic, largest, trimmed."""
    v = F.array_compact(F.array(*values))
    rows = df.withColumn("v", v).where(F.size("v") > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sharp = F.filter("v", lambda x: x > 1 - noise)
    inner = F.when(F.size("v") > 2, F.slice(F.array_sort("v"), F.lit(2), F.size("v") - 2)).otherwise(F.col("v"))
    return rows.select(
        key, F.bround(total(F.col("v")) / F.size("v"), 6).alias("arithmetic"), F.bround(F.when(F.size(sharp) > 0, total(sharp) / F.size(sharp)).otherwise(total(F.col("v")) / F.size("v")), 6).alias("filtered"),
        F.bround(F.exp(total(F.transform("v", lambda x: F.ln(F.greatest(x, F.lit(1e-9))))) / F.size("v")), 6).alias("geometric"),
        F.bround(F.size("v") / total(F.transform("v", lambda x: 1 / F.greatest(x, F.lit(1e-9)))), 6).alias("harmonic"), F.bround(F.array_max("v"), 6).alias("largest"), F.bround(total(inner) / F.size(inner), 6).alias("trimmed"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, bins: int = 1024) -> DataFrame:
    """AUROC by rank sums over equal scores, and the mean score by label.

    Equal scores are counted first; ranks are running sums over the distinct scores, in order within ranges of
    the score and offset by the ranges before, so no task sorts all of them.
    """
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, width = float(ends["lo"] or 0.0), (float(ends["hi"] or 0.0) - float(ends["lo"] or 0.0)) / bins or 1.0
    counted = df.groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(label).alias("pos"), F.count("*").alias("n")).withColumn("bin", F.floor((F.col("x") - lo) / width))
    offsets = counted.groupBy("bin").agg(F.sum("n").alias("bin_n")).withColumn("offset", F.coalesce(F.sum("bin_n").over(W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy("bin").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    ranks = counted.join(offsets, "bin").withColumn("rank", F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranks.agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"), F.sum(F.col("pos") * F.col("rank")).alias("rank_sum"), F.sum(F.col("pos") * F.col("x")).alias("pos_x"), F.sum((F.col("n") - F.col("pos")) * F.col("x")).alias("neg_x"))
    return sums.select("pos", "neg", F.bround((F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")), 6).alias("auroc"), F.bround(F.col("pos_x") / F.col("pos") - F.col("neg_x") / F.col("neg"), 6).alias("separation"))
