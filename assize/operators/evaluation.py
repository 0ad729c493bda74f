"""How well scores rank labels: shares among the first, areas, concentration, paired tests, intervals by resampling; and other means of rarities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.stats import erfc
from assize.operators.resampling import drawn_counts

#: Ranges of a value that are put in order each by itself.
RANGES = 1024
# The cap of a surprisal in bits, and the probability from which a dimension counts as noise.
MOST_BITS, NOISE = 20.0, 0.4


def running(counted: DataFrame, value: str, sums: list[str], by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``counted`` (a row a value of each key ``by``) with ``before_<sum>``: the sums over the smaller values of the key, and ``all_<sum>``.

    Values are put in order within ranges of equal width and offset by what the ranges before hold, so no task sorts all values
    of a key; a key has at most ``ranges`` ranges.
    """
    by = by or []
    ends = counted.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges)).otherwise(0).cast("int")
    placed = counted.join(F.broadcast(ends)).withColumn("_range", part).drop("lo", "hi")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    earlier, key = W.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*(by or [F.lit(0)]))
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums], *[F.sum(f"_sum_{s}").over(key).alias(f"all_{s}") for s in sums])
    within = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumns({f"_in_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    out = summed.join(offsets, [*by, "_range"])
    return out.select(*counted.columns, *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums], *[f"all_{s}" for s in sums])


def _area(pos: str = "pos", neg: str = "neg") -> Column:
    """The area under the curve: the share of pairs of unlike labels in order, equal scores counting half; one half without pairs."""
    wins = F.sum(F.col(pos) * (F.col(f"before_{neg}") + F.col(neg) / 2))
    pairs = F.max(f"all_{pos}") * F.max(f"all_{neg}")
    return F.when(pairs > 0, wins / pairs).otherwise(0.5)


def evaluated(df: DataFrame, score: str, label: str, key: str, firsts: tuple[int, ...] = (10, 50, 100), bar: float = 0.75) -> DataFrame:
    """One row: rows, positives, area, separation, concentration, rows at ``bar`` or above, and the share of positives among the first k.

    Concentration is 1 where all positives come first and 0 where they lie at random; equal scores share their mean place.
    Among the first k equal scores come in order of ``key``; no more than the largest k rows are gathered for that.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    ranks = running(counted, "x", ["pos", "neg"])
    n, pos = F.max("all_pos") + F.max("all_neg"), F.max("all_pos")
    # places from the top: those of larger scores, then the middle of the equal ones
    place = (F.col("all_pos") + F.col("all_neg") - F.col("before_pos") - F.col("before_neg") - F.col("n")) + (F.col("n") + 1) / 2
    area = F.sum(F.col("pos") * (F.col("all_pos") + F.col("all_neg") - place + 1))
    best, chance = pos * (pos + 1) / 2 + pos * (n - pos), pos * (n + 1) / 2
    mean = lambda c, total: F.sum(F.col(c) * F.col("x")) / total
    separation = F.when((pos > 0) & (n > pos), mean("pos", pos) - mean("neg", n - pos)).otherwise(0.0)
    gini = F.when((pos > 0) & (n > pos), (area - chance) / (best - chance)).otherwise(0.0)
    whole = ranks.agg(n.alias("rows"), pos.alias("positives"), F.bround(_area(), 6).alias("area"), F.bround(separation, 6).alias("separation"), F.bround(gini, 6).alias("concentration"), F.coalesce(F.sum(F.when(F.col("x") >= bar, F.col("n"))), F.lit(0)).alias("above"))
    top = df.orderBy(F.desc(score), key).limit(max(firsts)).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), key)))
    shares = top.agg(*[F.bround(F.avg(F.when(F.col("place") <= k, F.when(F.col(label) == 1, 1.0).otherwise(0.0))), 6).alias(f"precision_{k}") for k in firsts])
    return whole.join(F.broadcast(shares))


def signed_ranks(df: DataFrame, first: str, second: str, least: int = 10) -> DataFrame:
    """Wilcoxon's test of paired values: (n, w_plus, p, p_tied); p by the normal approximation, p_tied with the variance less what ties take.

    Pairs without a difference are left out; fewer than ``least`` others give 0 and 1. Differences of equal size are counted
    first and share their mean rank.
    """
    d = F.col(first).cast("double") - F.col(second).cast("double")
    sizes = df.select(d.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("x")).agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    ranks = running(sizes, "x", ["n"])
    t = F.col("n").cast("double")
    sums = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("plus") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("w"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24
    p = lambda variance: F.when(variance > 0, erfc(F.abs(F.col("w") - n * (n + 1) / 4) / F.sqrt(variance) / math.sqrt(2))).otherwise(1.0)
    enough = F.col("n") >= least
    return sums.select("n", F.when(enough, F.bround("w", 6)).otherwise(0.0).alias("w_plus"), *[F.when(enough, F.bround(p(v), 6)).otherwise(1.0).alias(name) for name, v in (("p", spread), ("p_tied", spread - F.col("ties") / 48))])


def area_interval(df: DataFrame, score: str, label: str, key: str, turns: int = 200) -> DataFrame:
    """(area, low, high): the area and the bounds of its middle 95 % over ``turns`` resamplings of the rows.

    A row's weights hang on its key alone, so resampling needs no pass of its own a turn and runs agree whatever the partitions.
    Each turn's weights are worked out for many rows at once and counted by score where the rows lie.
    """
    counted = drawn_counts(df, F.col(score), F.coalesce(F.col(label), F.lit(0)) == 1, F.col(key), turns)
    areas = running(counted, "x", ["pos", "neg"], ["turn"]).groupBy("turn").agg(_area().alias("area"))
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.col("area"))))
    at = lambda share: F.get(sorted_, F.lit(min(turns - 1, int(share * turns))))
    return areas.agg(F.bround(F.max(F.when(F.col("turn") == 0, F.col("area"))), 6).alias("area"), F.bround(at(0.025), 6).alias("low"), F.bround(at(0.975), 6).alias("high"))


def dimension_shares(df: DataFrame, key: str, group: list[str], dims: list[str]) -> DataFrame:
    """(key, dim, probability): the share of a row's value in its group, for every dimension it has a value of; from counted cells."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p")
    rows = df.select(key, *group, pairs).select(key, *group, "p.dim", "p.value")
    sizes = df.groupBy(*group).agg(F.count("*").alias("total"))
    cells = rows.where("value is not null").groupBy(*group, "dim", "value").agg(F.count("*").alias("n")).join(sizes, group)
    return rows.join(cells, [*group, "dim", "value"]).select(key, "dim", (F.col("n") / F.col("total")).alias("probability"))


def scoring_methods(dims: DataFrame, key: str, probability: str = "probability") -> DataFrame:
    """Eight scores of rows (key, probability), by the rarity 1 - p of each dimension.

    m0 mean; m1 weighted by surprisal, in bits up to ``MOST_BITS``; m2 and m4 the same without dimensions of ``NOISE`` or more, unless
    none is left; m3 geometric; m5 largest; m6 harmonic, of rarities above zero; m7 without the least. Sums a key, no lists.
    """
    p = F.col(probability)
    r = F.lit(1.0) - p
    w = F.when(p <= 0, 1.0).otherwise(F.least(-F.log2(p), F.lit(MOST_BITS)) / MOST_BITS)
    sharp = p < NOISE
    total, n = F.sum("r"), F.count("*")
    over = lambda c: F.when(F.sum(F.when(c, F.col("w"))) > 0, F.sum(F.when(c, F.col("w") * F.col("r"))) / F.sum(F.when(c, F.col("w")))).otherwise(0.0)
    rows = dims.select(key, r.alias("r"), w.alias("w"), sharp.alias("sharp"))
    kept = F.count_if("sharp")
    scores = {
        "m0": total / n, "m1": over(F.lit(True)), "m2": F.when(kept > 0, F.sum(F.when(F.col("sharp"), F.col("r"))) / kept).otherwise(total / n), "m3": F.exp(F.sum(F.log(F.greatest("r", F.lit(1e-10)))) / n),
        "m4": F.when(kept > 0, over(F.col("sharp"))).otherwise(over(F.lit(True))), "m5": F.max("r"),
        "m6": F.when(F.count_if(F.col("r") > 0) > 0, F.count_if(F.col("r") > 0) / F.sum(F.when(F.col("r") > 0, 1 / F.col("r")))).otherwise(0.0), "m7": F.when(n > 1, (total - F.min("r")) / (n - 1)).otherwise(total / n),
    }
    return rows.groupBy(key).agg(*[F.bround(F.least(s, F.lit(1.0)), 6).alias(name) for name, s in scores.items()])
