"""Series of decisions over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import joins, sequence
from assize.plans.bindings import DECISIONS, VELOCITIES, Registry, decisions, velocities
from assize.session import read_table

R = Registry()
BINARY = f"{DECISIONS}, b AS (SELECT * FROM dec WHERE fav IS NOT NULL)"


@R.add(f"""WITH {BINARY}, m AS (SELECT member, d, event_id, fav - avg(fav) OVER (PARTITION BY member) AS e FROM b), l AS (SELECT *, lead(e) OVER (PARTITION BY member ORDER BY d, event_id) AS ne FROM m)
SELECT member, count(*) AS n, round_even(CASE WHEN count(*) < 3 OR sum(e * e) < 1e-12 THEN 0.0 ELSE sum(e * ne) / sum(e * e) END, 6)::DOUBLE AS autocorrelation FROM l GROUP BY ALL HAVING count(*) >= 50""")
def autocorr_lag1(spark, folder):
    return sequence.autocorrelation(decisions(spark, folder).where("fav is not null"), ["member"], ["d", "event_id"], "fav", 50)


@R.add(" UNION ALL ".join(f"""SELECT * FROM (WITH {BINARY}, r AS (SELECT member, fav, sum(fav) OVER (PARTITION BY member ORDER BY d, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS run FROM b)
SELECT member, {k} AS streak, count(*) FILTER (run = {k}) AS occurrences, CASE WHEN count(*) FILTER (run = {k}) >= 3 THEN round_even(avg(fav) FILTER (run = {k}) - avg(fav), 6) END::DOUBLE AS effect FROM r GROUP BY member)""" for k in (3, 5)))
def streak_effect_3_5(spark, folder):
    rows = decisions(spark, folder).where("fav is not null")
    return sequence.streak_effect(rows, ["member"], ["d", "event_id"], "fav", 3).unionByName(sequence.streak_effect(rows, ["member"], ["d", "event_id"], "fav", 5))


MONTHS = f"""{DECISIONS}, g AS (SELECT cls, date_trunc('month', d)::DATE AS month, count(fav) AS n, coalesce(sum(fav), 0)::BIGINT AS s FROM dec GROUP BY ALL),
sp AS (SELECT cls, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month FROM (SELECT cls, min(month)::TIMESTAMP AS a, max(month)::TIMESTAMP AS b FROM g GROUP BY cls)),
mon AS (SELECT cls, month, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM sp LEFT JOIN g USING (cls, month))"""


@R.add(f"""WITH {MONTHS} SELECT cls, month, n, s, (sum(n) OVER w)::BIGINT AS rolling_n, CASE WHEN sum(n) OVER w > 0 THEN round_even((sum(s) OVER w) / (sum(n) OVER w), 6) END::DOUBLE AS rolling_rate FROM mon WINDOW w AS (PARTITION BY cls ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def monthly_rolling_rate(spark, folder):
    return sequence.rolling(sequence.monthly(decisions(spark, folder), ["cls"], "d", "fav"), ["cls"])


SCORED = f"""{MONTHS}, rt AS (SELECT *, CASE WHEN n > 0 THEN s / n END AS rate FROM mon), zs AS (SELECT cls, month, n, rate, CASE WHEN stddev_pop(rate) OVER w = 0 THEN 0.0 ELSE round_even((rate - avg(rate) OVER w) / stddev_pop(rate) OVER w, 6) END AS z FROM rt WINDOW w AS (PARTITION BY cls))"""


@R.add(f"WITH {SCORED} SELECT cls, month, n, round_even(rate, 6)::DOUBLE AS rate, z::DOUBLE AS z FROM zs")
def monthly_zscore(spark, folder):
    return sequence.scored(sequence.monthly(decisions(spark, folder), ["cls"], "d", "fav"), ["cls"]).select("cls", "month", "n", F.bround("rate", 6).alias("rate"), "z")


@R.add(f"""WITH RECURSIVE {SCORED}, o AS (SELECT cls, month, coalesce(z, 0.0) AS z, row_number() OVER (PARTITION BY cls ORDER BY month) AS k FROM zs),
c AS (SELECT cls, month, k, greatest(0.0, z - 0.25)::DOUBLE AS up, greatest(0.0, -z - 0.25)::DOUBLE AS down FROM o WHERE k = 1 UNION ALL
  SELECT o.cls, o.month, o.k, greatest(0.0, c.up + o.z - 0.25)::DOUBLE, greatest(0.0, c.down - o.z - 0.25)::DOUBLE FROM c JOIN o ON o.cls = c.cls AND o.k = c.k + 1)
SELECT cls, month, round_even(up, 6)::DOUBLE AS cusum_up, round_even(down, 6)::DOUBLE AS cusum_down, greatest(up, down) >= 2.0 AND k - 1 >= 5 AS is_break FROM c""")
def cusum_breakpoints(spark, folder):
    return sequence.cusum(sequence.monthly(decisions(spark, folder), ["cls"], "d", "fav"), ["cls"])


@R.add(f"""WITH {DECISIONS}, g AS (SELECT member, y AS year, count(fav) AS n, avg(fav) AS r FROM dec GROUP BY ALL)
SELECT g.member, g.year, g.n, round_even(g.r, 6)::DOUBLE AS rate, round_even(g.r - p.r, 6)::DOUBLE AS delta FROM g LEFT JOIN g p ON p.member = g.member AND p.year = g.year - 1""")
def yoy_delta(spark, folder):
    return sequence.year_over_year(decisions(spark, folder), ["member"], "y", "fav")


@R.add(f"""WITH {DECISIONS}, g AS (SELECT cls, month(d) AS calendar_month, count(fav) AS n, sum(fav) AS s FROM dec GROUP BY ALL)
SELECT cls, calendar_month::INT AS calendar_month, n, round_even(s / n - (sum(s) OVER (PARTITION BY cls)) / (sum(n) OVER (PARTITION BY cls)), 6)::DOUBLE AS delta FROM g""")
def seasonality_delta(spark, folder):
    return sequence.seasonality(decisions(spark, folder), ["cls"], "d", "fav")


@R.add(f"""WITH {DECISIONS}, e(event, event_date) AS (VALUES ('reform', DATE '1997-03-01'), ('recess', DATE '1998-07-15'), ('election', DATE '2000-10-01')),
n AS (SELECT event, event_date, date_diff('day', event_date, d) AS gap, fav FROM dec JOIN e ON date_diff('day', event_date, d) BETWEEN -180 AND 180),
g AS (SELECT event, event_date, count(fav) FILTER (gap < 0) AS n_before, avg(fav) FILTER (gap < 0) AS b, count(fav) FILTER (gap > 0) AS n_after, avg(fav) FILTER (gap > 0) AS a FROM n GROUP BY ALL)
SELECT event, event_date, n_before, n_after, CASE WHEN n_before >= 5 AND n_after >= 5 THEN round_even(a - b, 6) END::DOUBLE AS delta FROM g""")
def event_window_before_after(spark, folder):
    events = spark.sql("select * from values ('reform', date '1997-03-01'), ('recess', date '1998-07-15'), ('election', date '2000-10-01') as e(event, event_date)")
    return sequence.around_events(decisions(spark, folder), "d", "fav", events)


@R.add(f"""WITH {VELOCITIES} SELECT cls, y, count(*) AS n, round_even(quantile_cont(days, 0.05), 6)::DOUBLE AS p5, round_even(quantile_cont(days, 0.1), 6)::DOUBLE AS p10, round_even(quantile_cont(days, 0.5), 6)::DOUBLE AS p50, round_even(quantile_cont(days, 0.9), 6)::DOUBLE AS p90, round_even(quantile_cont(days, 0.95), 6)::DOUBLE AS p95 FROM vel GROUP BY ALL HAVING count(*) >= 10""")
def velocity_percentiles(spark, folder):
    found = sequence.percentiles(velocities(spark, folder), ["cls", "y"], "days", [0.05, 0.1, 0.5, 0.9, 0.95])
    return found.select("cls", "y", "n", *[F.bround(c, 6).alias(c) for c in found.columns[3:]])


@R.add(f"""WITH {VELOCITIES}, p AS (SELECT cls, y, count(*) AS peers, quantile_cont(days, 0.05) AS lo, quantile_cont(days, 0.5) AS mid, quantile_cont(days, 0.95) AS hi FROM vel GROUP BY ALL HAVING count(*) >= 10)
SELECT cls, y, line_id, days, peers, CASE WHEN days < lo THEN 'low' WHEN days > hi THEN 'high' ELSE 'normal' END AS flag, round_even((days - mid) / greatest(hi - lo, 1.0), 6)::DOUBLE AS distance FROM vel JOIN p USING (cls, y)""")
def peer_percentile_flags(spark, folder):
    return sequence.percentile_flags(velocities(spark, folder), ["cls", "y"], "days").select("cls", "y", "line_id", "days", "peers", "flag", "distance")


FIRST = f"""{DECISIONS}, f AS (SELECT l_orderkey, arg_min(l_suppkey, struct_pack(n := l_linenumber, s := l_suppkey)) AS s FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), x AS (SELECT case_id, d, event_id, fav, outcome, s AS holder FROM dec LEFT JOIN f ON l_orderkey = event_id),
ch AS (SELECT *, row_number() OVER w AS seq, last_value(holder IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM x WINDOW w AS (PARTITION BY case_id ORDER BY d, event_id))"""


def _holders(spark, folder):
    first = read_table(spark, folder, "lineitem").where("l_linenumber < 5").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("holder"))
    return decisions(spark, folder).join(first, F.expr("event_id = l_orderkey"), "left").select("case_id", "d", "event_id", "fav", "outcome", "holder")


@R.add(f"WITH {FIRST} SELECT case_id, d, event_id, holder, previous FROM ch WHERE holder IS NOT NULL AND previous IS NOT NULL AND holder <> previous")
def member_change_detection(spark, folder):
    return sequence.changes(_holders(spark, folder), ["case_id"], ["d", "event_id"], "holder").select("case_id", "d", "event_id", "holder", "previous")


@R.add(f"""WITH {FIRST}, t AS (SELECT case_id, seq AS from_seq, holder AS new_member, previous FROM ch WHERE holder IS NOT NULL AND previous IS NOT NULL AND holder <> previous)
, bs AS (SELECT holder AS new_member, avg(fav) AS base FROM x WHERE fav IS NOT NULL GROUP BY ALL),
g AS (SELECT t.case_id, from_seq::INT AS from_seq, new_member, t.previous, count(outcome) AS n, avg(fav) AS r FROM t JOIN ch ON ch.case_id = t.case_id AND ch.seq >= t.from_seq AND ch.holder = t.new_member GROUP BY ALL)
SELECT case_id, from_seq, new_member, previous, n, round_even(r, 6)::DOUBLE AS rate, round_even(r - base, 6)::DOUBLE AS delta, coalesce(round_even(r - base, 6) > 0.15 AND n >= 3, false) AS red_flag FROM g LEFT JOIN bs USING (new_member)""")
def rate_after_change(spark, folder):
    return sequence.after_change(_holders(spark, folder), ["case_id"], ["d", "event_id"], "holder", "fav", "outcome")


@R.add("""WITH e AS (SELECT user_id, event_id, ts, event_type, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_other FROM events)
SELECT user_id, event_id, CAST(ts AS DATE) AS day, CAST(next_other AS DATE) AS next_day FROM e WHERE event_type = 'error' AND (next_other IS NULL OR date_diff('day', CAST(ts AS DATE), CAST(next_other AS DATE)) > 2)""")
def stalled_not_followed(spark, folder):
    rows = joins.not_followed(read_table(spark, folder, "events"), ["user_id"], "ts", F.col("event_type") == "error", F.col("event_type") == "purchase", 2, ["event_id"])
    return rows.select("user_id", "event_id", F.to_date("ts").alias("day"), F.to_date("next_other").alias("next_day"))


@R.add("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, event_type = 'view' AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'purchase')),
q AS (SELECT user_id, 0::BIGINT AS k, []::DATE[] AS waiting, NULL::DATE AS opened, NULL::DATE AS closed, -1::BIGINT AS number FROM e GROUP BY user_id
  UNION ALL SELECT q.user_id, e.k, CASE WHEN o THEN list_append(waiting, d) ELSE waiting[2:] END, CASE WHEN NOT o AND len(waiting) > 0 THEN waiting[1] END, CASE WHEN NOT o AND len(waiting) > 0 THEN d END, number + CASE WHEN NOT o AND len(waiting) > 0 THEN 1 ELSE 0 END FROM q JOIN e ON e.user_id = q.user_id AND e.k = q.k + 1)
SELECT user_id, number::INT AS number, opened, closed, date_diff('day', opened, closed)::INT AS days FROM q WHERE opened IS NOT NULL""")
def greedy_pair_durations(spark, folder):
    kind = F.col("event_type")
    return sequence.greedy_durations(read_table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "ts", kind == "view", kind == "purchase")


@R.add(f"WITH {DECISIONS} SELECT case_id, arg_max(member, struct_pack(d := d, e := event_id)) AS member, arg_max(cls, struct_pack(d := d, e := event_id)) AS cls, max(d) AS d FROM dec GROUP BY case_id")
def latest_per_key(spark, folder):
    return joins.latest_per_key(decisions(spark, folder), ["case_id"], ["d", "event_id"], ["member", "cls", "d"])


@R.add("""WITH a AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, event_id AS later_id, CAST(ts AS DATE) AS later FROM events WHERE event_type = 'purchase'),
m AS (SELECT a.user_id, a.event_id, later_id, date_diff('day', d, later) AS gap FROM a LEFT JOIN b ON a.user_id = b.user_id AND date_diff('day', d, later) > 0 AND date_diff('day', d, later) <= 10)
SELECT user_id, event_id, later_id, gap::INT AS gap_days, CASE WHEN gap IS NULL THEN 'none' WHEN gap <= 7 THEN 'd07' WHEN gap <= 14 THEN 'd14' ELSE 'd30' END AS bucket FROM m""")
def proximity_buckets(spark, folder):
    events = read_table(spark, folder, "events")
    left = events.where("event_type = 'signup'").select("user_id", "event_id", F.to_date("ts").alias("day"))
    right = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("later_id"), F.to_date("ts").alias("later"))
    met = joins.within_days(left, right, ["user_id"], "day", "later", 10)
    return met.select("user_id", "event_id", "later_id", "gap_days", joins.gap_bucket(F.col("gap_days")).alias("bucket"))
