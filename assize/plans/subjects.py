"""Queries on single subjects, exposures and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import exposure
from assize.plans.bindings import DECISIONS, Registry, decisions
from assize.plans.entities import EDGES, _edges
from assize.plans.series import proximity_buckets
from assize.session import read_table

R = Registry()


@R.add(f"""WITH {DECISIONS}, s AS (SELECT d, y = 2000 AS now FROM dec WHERE contains(lower(member), 'nation_1') AND y <= 2000), a AS (SELECT count(*) FILTER (now) AS events, count(DISTINCT d) FILTER (now) AS active_days, count(*) FILTER (NOT now) AS history_events, count(DISTINCT d) FILTER (NOT now) AS history_days FROM s)
SELECT *, CASE WHEN history_days > 0 THEN round_even(history_events / history_days, 6) END::DOUBLE AS history_mean, CASE WHEN events >= 5 AND active_days >= 3 AND history_events >= 20 THEN 'comparable' ELSE 'inconclusive' END AS reading FROM a""")
def minister_flow(spark, folder):
    return exposure.subject_flow(decisions(spark, folder).where("y <= 2000"), F.contains(F.lower("member"), F.lit("nation_1")), F.col("y") == 2000, "d")


@R.add("""WITH a AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, CAST(ts AS DATE) AS later FROM events WHERE event_type = 'purchase'),
m AS (SELECT a.user_id, a.event_id, min(date_diff('day', d, later)) AS gap, count(later) AS n FROM a LEFT JOIN b ON a.user_id = b.user_id AND date_diff('day', d, later) > 0 AND date_diff('day', d, later) <= 10 GROUP BY ALL),
s AS (SELECT *, (CASE WHEN gap <= 7 THEN 0.5 WHEN gap <= 14 THEN 0.35 ELSE 0.0 END + CASE WHEN gap IS NOT NULL THEN 0.3 ELSE 0.0 END) * CASE WHEN user_id % 2 = 0 THEN 0.7 ELSE 1.0 END * CASE user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 1.0 END AS r FROM m), t AS (SELECT user_id, event_id, round_even(CASE WHEN n < 5 THEN least(r, 0.29) ELSE r END, 6)::DOUBLE AS score FROM s)
SELECT *, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM t""")
def exposure_scores(spark, folder):
    near = proximity_buckets(spark, folder).groupBy("user_id", "event_id").agg(F.min("gap_days").alias("gap"), F.count("later_id").alias("n"))
    cover = F.when(F.col("user_id") % 3 == 0, "low").when(F.col("user_id") % 3 == 1, "partial").otherwise("high")
    scored = near.select("user_id", "event_id", exposure.exposure_score(F.col("gap"), F.col("user_id") % 2 == 0, cover, F.col("n")).alias("score"))
    return scored.withColumn("tier", exposure.exposure_tier(F.col("score")))


@R.add(f"""WITH {DECISIONS}, l AS (SELECT l_suppkey AS company, member, l_linenumber AS degree, fav, 0.5 AS base FROM lineitem JOIN dec ON l_orderkey = event_id), g AS (SELECT company, member, min(degree) AS degree, count(fav) AS n, avg(fav) AS r FROM l GROUP BY ALL), c AS (SELECT *, round_even((r - 0.5) * pow(0.5, greatest(degree - 2, 0)), 6)::DOUBLE AS risk FROM g)
SELECT company, member, degree, n, round_even(r - 0.5, 6)::DOUBLE AS delta, risk, risk > 0.15 AND n >= 3 AS red_flag FROM c""")
def corporate_conflicts(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("company"), F.col("l_linenumber").alias("degree"))
    rows = decisions(spark, folder).join(lines, F.expr("l_orderkey = event_id")).withColumn("base", F.lit(0.5))
    return exposure.conflicts(rows, ["company", "member"], "degree", "fav", "base")


@R.add(f"""WITH {DECISIONS}, p AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY case_id ORDER BY d), d) AS pause FROM dec), g AS (SELECT case_id, member, count(*) AS events, count(DISTINCT cls) AS kinds, date_diff('day', min(d), max(d))::INT AS days, max(pause)::INT AS longest_pause FROM p GROUP BY ALL)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY member) >= 5 THEN round_even((count(*) OVER (PARTITION BY member ORDER BY days)) / (count(*) OVER (PARTITION BY member)), 6) END::DOUBLE AS peer_share FROM g""")
def procedural_timeline(spark, folder):
    return exposure.timeline_features(decisions(spark, folder), "case_id", "d", "cls", "member")


@R.add(f"""WITH {DECISIONS}, c AS (SELECT member, y, count(*) AS n FROM dec GROUP BY ALL), z AS (SELECT *, CASE WHEN stddev_pop(n) OVER w = 0 THEN 0.0 ELSE round_even((n - avg(n) OVER w) / stddev_pop(n) OVER w, 6) END::DOUBLE AS z FROM c WINDOW w AS (PARTITION BY y)) SELECT *, z > 2.0 AS is_anomaly FROM z""")
def cross_section_anomaly(spark, folder):
    return exposure.cross_section(decisions(spark, folder), "member", "y")


@R.add(f"""WITH {DECISIONS}, o AS (SELECT member, cls, count(*) AS w, sum(fav) AS s FROM dec WHERE fav IS NOT NULL GROUP BY ALL), b AS (SELECT cls, sum(s) / sum(w) AS b FROM o GROUP BY cls), g AS (SELECT member, sum(w)::BIGINT AS n, sum(s) / sum(w) AS r, sum(w * b) / sum(w) AS b FROM o JOIN b USING (cls) GROUP BY member)
SELECT member, n, round_even(r, 6)::DOUBLE AS rate, round_even(b, 6)::DOUBLE AS baseline, round_even(r - b, 6)::DOUBLE AS delta FROM g""")
def weighted_class_baseline(spark, folder):
    return exposure.weighted_baseline(decisions(spark, folder), "member", "cls", "fav")


@R.add(f"""WITH {EDGES} SELECT dst, strength, count(*) AS edges, bool_or(truncated) AS truncated FROM eg WHERE strength IN ('deterministic', 'exact', 'statistical') GROUP BY ALL""")
def evidence_threshold(spark, folder):
    """Edges of at least statistical strength, strengths in order."""
    order = ["fuzzy", "inferred", "statistical", "exact", "deterministic"]
    enough = order[order.index("statistical") :]
    return _edges(spark, folder).where(F.col("strength").isin(*enough)).groupBy("dst", "strength").agg(F.count("*").alias("edges"), F.bool_or("truncated").alias("truncated"))


@R.add(f"""WITH {EDGES} SELECT src, dst, min(CASE strength WHEN 'deterministic' THEN 1 WHEN 'exact' THEN 1 WHEN 'statistical' THEN 2 WHEN 'inferred' THEN 3 ELSE 4 END)::INT AS cost, count(*) AS edges FROM eg GROUP BY ALL""")
def path_candidates(spark, folder):
    cost = F.when(F.col("strength").isin("deterministic", "exact"), 1).when(F.col("strength") == "statistical", 2).when(F.col("strength") == "inferred", 3).otherwise(4)
    return _edges(spark, folder).groupBy("src", "dst").agg(F.min(cost).alias("cost"), F.count("*").alias("edges"))
