"""Graphs: bounded search, expansion with a breaker, component rollups, edge scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.session import cut


def bounded_search(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, degree, path): all nodes within ``depth`` steps of each seed, each at its least degree.

    ``edges`` (src, dst) is walked from src to dst; of paths of equal length the first in order stays. Every
    round joins only the nodes that are new.
    """
    known = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("degree"), F.array(F.col("node").cast("string")).alias("path")).distinct())
    frontier = known
    for degree in range(1, depth + 1):
        steps = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("seed", F.col("dst").alias("node"))
        steps = steps.agg(F.lit(degree).alias("degree"), F.min(F.concat("path", F.array(F.col("dst").cast("string")))).alias("path"))
        frontier = cut(steps.join(known.select("seed", "node"), ["seed", "node"], "left_anti"))
        if not frontier.take(1):
            break
        known = cut(known.unionByName(frontier))
    return known


def expand_with_breaker(seeds: DataFrame, bridge: DataFrame, groups: DataFrame, members: DataFrame, limit: int = 5000) -> DataFrame:
    """Seeds to entities through a bridge and the groups of what it meets: (seed, entity, degree, truncated).

    ``seeds`` (seed, key), ``bridge`` (key, unit), ``groups`` (unit, group), ``members`` (unit, entity). If the
    groups that a seed meets hold more than ``limit`` units together, it is not expanded and says so.

    Seeds whose only key is the same reach the same, so the least of them is expanded and the others take what it finds.
    """
    keys = seeds.where("seed is not null and key is not null").select("seed", "key").distinct()
    lone = keys.groupBy("seed").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    leads = lone.where("n = 1").groupBy("key").agg(F.min("seed").alias("lead"))
    led = cut(lone.withColumn("key", F.when(F.col("n") == 1, F.col("key"))).join(leads, "key", "left").select("seed", F.coalesce("lead", "seed").alias("lead")))
    asked = keys.join(led.where("seed = lead").select("seed"), "seed")
    direct = asked.join(bridge, "key").select("seed", "unit").distinct()
    met = direct.join(groups, "unit").select("seed", "group").distinct()
    sizes = groups.groupBy("group").agg(F.count_distinct("unit").alias("size"))
    gate = met.join(sizes, "group").groupBy("seed").agg(F.sum("size").alias("reach"))
    open_ = gate.where(F.col("reach") <= limit).select("seed")
    wide = met.join(open_, "seed").join(groups, "group").select("seed", "unit").distinct()
    reach = direct.withColumn("degree", F.lit(1)).unionByName(wide.join(direct, ["seed", "unit"], "left_anti").withColumn("degree", F.lit(2)))
    found = reach.join(members, "unit").groupBy("seed", "entity").agg(F.min("degree").alias("degree"))
    told = found.join(gate, "seed", "left").select(F.col("seed").alias("lead"), "entity", "degree", F.coalesce(F.col("reach") > limit, F.lit(False)).alias("truncated"))
    return led.join(told, "lead").select("seed", "entity", "degree", "truncated")


def component_rollup(members: DataFrame, facts: DataFrame, node: str, component: str, amount: str) -> DataFrame:
    """Per component: its nodes, the rows of its facts, their sum, and the largest node's share of it."""
    joined = members.join(facts, node, "left").groupBy(component, node).agg(F.count(amount).alias("rows"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"))
    out = joined.groupBy(component).agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows"), F.sum("amount").alias("total"), F.max("amount").alias("largest"))
    share = F.when(F.col("total") > 0, F.bround(F.col("largest") / F.col("total"), 6))
    return out.select(component, "nodes", "rows", F.bround("total", 2).alias("total"), share.alias("top_share"))


# Weights of evidence and what lowers them.
STRENGTH = {"deterministic": 3.0, "exact": 2.0, "statistical": 1.5, "inferred": 1.0, "fuzzy": 0.5}
PENALTY_FUZZY, PENALTY_TRUNCATED, PENALTY_SINGLE, PENALTY_NO_ID = 0.3, 0.5, 1.0, 0.5


def entity_scores(edges: DataFrame, most_signals: int = 10) -> DataFrame:
    """Decomposable scores per destination and mode from edges (src, dst, strength, truncated, has_id).

    Strict mode takes deterministic and exact edges; broad mode takes all. A single edge lowers the score.
    """
    weight = F.lit(0.0)
    for name, value in STRENGTH.items():
        weight = weight + F.when(F.col("strength") == name, value).otherwise(0.0)
    penalty = F.when(F.col("strength") == "fuzzy", PENALTY_FUZZY).otherwise(0.0) + F.when(F.col("truncated"), PENALTY_TRUNCATED).otherwise(0.0) + F.when(F.col("has_id"), 0.0).otherwise(PENALTY_NO_ID)
    modes = F.when(F.col("strength").isin("deterministic", "exact") & ~F.col("truncated"), F.array(F.lit("strict"), F.lit("broad"))).otherwise(F.array(F.lit("broad")))
    each = edges.select("dst", F.explode(modes).alias("mode"), weight.alias("weight"), penalty.alias("penalty"))
    out = each.groupBy("dst", "mode").agg(F.count("*").alias("signals"), F.bround(F.sum("weight"), 6).alias("weight"), F.bround(F.sum("penalty"), 6).alias("penalty"))
    single = F.when(F.col("signals") == 1, PENALTY_SINGLE).otherwise(0.0)
    mean = (F.col("weight") - F.col("penalty") - single) / F.col("signals")
    return out.withColumn("score", F.bround(F.greatest(mean, F.lit(0.0)) * F.least("signals", F.lit(most_signals)), 6))


def evidence_bundles(edges: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """Per destination of ``least`` signals or more: their number and kinds, the first ``most`` sources, a tier, and whether it needs review.

    Sources are ranked before they are gathered, so a list holds ``most`` at the longest.
    """
    sums = edges.groupBy("dst", "src", "strength").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("cut"))
    rows = sums.groupBy("dst").agg(F.sum("n").alias("signals"), F.count_distinct("strength").alias("kinds"), F.bool_or(F.col("cut") | (F.col("strength") == "fuzzy")).alias("needs_review")).where(F.col("signals") >= least)
    turn = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    sources = sums.select("dst", "src").distinct().withColumn("turn", turn).where(F.col("turn") <= most).groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("sources"))
    tier = F.when(F.col("signals") >= 20, "high").when(F.col("signals") >= 5, "medium").otherwise("low")
    return rows.join(sources, "dst").select("dst", "signals", "kinds", "sources", tier.alias("tier"), "needs_review")


def neighbours(edges: DataFrame, node, limit: int = 500) -> DataFrame:
    """The nodes one step away in either direction, in order of id; at most ``limit``, as the feature asks."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node"))
    return near.groupBy("node").agg(F.count("*").alias("edges")).orderBy("node").limit(limit)
