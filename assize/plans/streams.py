"""Event windows, held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.plans.bindings import Registry
from assize.session import read_table
from assize.streaming import events

R = Registry()


@R.add("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round_even(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def events_tumbling(spark, folder):
    return events.tumbling(read_table(spark, folder, "events"), "ts", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT (date_trunc('day', ts) - k * INTERVAL 1 DAY)::TIMESTAMP AS start, event_type, count(*) AS events FROM events, generate_series(0, 6) g(k) GROUP BY ALL")
def events_sliding(spark, folder):
    return events.sliding(read_table(spark, folder, "events"), "ts", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def events_sessions(spark, folder):
    return events.sessions(read_table(spark, folder, "events"), "ts", ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def json_field_filter(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    return read_table(spark, folder, "events").select("event_id", k.alias("k")).where("k > 50")
