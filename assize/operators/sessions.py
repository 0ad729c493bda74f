"""Events of sessions, and what held when they took place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions import rules
from assize.functions.text import stable_id
from assize.operators.joins import first_wins, latest_per_key
from assize.operators.sequence import greedy_durations


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_date: str, right_date: str, order: list[str], values: list[str], slice_days: int = 365) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of its key on or before its date; null where there is none.

    Of several rows of a date the last in ``order`` counts; a row without a date or of another key counts for nothing. Both sides
    are put in one order and a running last is taken, so no row meets more than one other. A key's rows are cut into spans of
    ``slice_days``, each put in order by itself, and what held at a span's begin is the last of the spans before it that have
    any; so a key that holds most rows is put in order span by span.
    """
    held = F.struct(*[F.col(v) for v in values])
    span = lambda c: F.floor(F.unix_date(F.to_date(c)) / slice_days).alias("_span")
    known = right.where(F.col(right_date).isNotNull())
    for key in by:
        known = known.where(F.col(key).isNotNull())
    first = F.struct(*[F.col(c) for c in order])
    at = F.col(right_date).cast("timestamp")
    daily = known.groupBy(*by, at.alias("_at"), span(right_date)).agg(F.max_by(held, first).alias("_held"))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(*by, F.col(left_date).cast("timestamp").alias("_at"), span(left_date), "_row", F.lit(None).cast(daily.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_side"))
    both = rows.unionByName(daily.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    within = W.partitionBy(*by, "_span").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("_now", F.last("_held", True).over(within)).where("_side = 1")
    ends = daily.groupBy(*by, "_span").agg(F.max_by("_held", "_at").alias("_end"))
    spans = ends.unionByName(rows.select(*by, "_span").distinct(), allowMissingColumns=True).groupBy(*by, "_span").agg(F.first("_end", True).alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_span").alias("_s"), F.last("_end", True).over(earlier).alias("_before")).where("_before is not null")
    same = F.col("_span") == F.col("_s")
    for key in by:
        same = same & (F.col(key) == F.col(f"_{key}"))
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_now", "_before"))
    return placed.join(carried, same, "left").select("_row.*", found.alias("_found")).select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


#: Categories of movements that belong to sessions.
CATEGORIES = ("pauta", "vista", "decisao")


def session_events(movements: DataFrame, virtual: DataFrame, decisions: DataFrame, ingest: tuple[str, ...] = ()) -> DataFrame:
    """Events of sessions of every case: (event_id, case, movement, session, event, date, member, days).

    ``movements`` (case, movement, date, description, member), ``virtual`` (case, entry, date, member), ``decisions`` (case, decision, date, member).
    Movements of a session's category come first, virtual sessions after them; of several events of one case, date and kind the
    first stays; of several rows of one movement the first by ``ingest``, columns of ``movements``, then those that name a member,
    in order of names. Where no member is named, the case's last decision that names one tells it. A request to view the files lasts
    until the first return on its day or later that no earlier request has taken.
    """
    kept = movements.where(rules.movement_category(F.col("description")).isin(*CATEGORIES))
    listed = kept.select("case", F.col("movement").cast("string").alias("movement"), F.col("movement").alias("turn"), F.lit(0).alias("source"), rules.session_kind(F.col("description")).alias("session"), rules.session_event(F.col("description")).alias("event"), F.col("date").cast("date").alias("date"), "member", *ingest)
    others = virtual.select("case", F.lit(None).cast("string").alias("movement"), F.col("entry").alias("turn"), F.lit(1).alias("source"), F.lit("plenario_virtual").alias("session"), F.lit("julgamento").alias("event"), F.col("date").cast("date").alias("date"), "member")
    named = F.when(F.col("member") != "", F.col("member"))
    once = first_wins(listed.unionByName(others, allowMissingColumns=True), ["case", "date", "event"], ["source", "turn", *ingest, named.asc_nulls_last(), F.col("session").asc_nulls_last()])
    last = latest_per_key(decisions.where("member is not null").withColumn("day", F.coalesce(F.col("date").cast("date").cast("string"), F.lit(""))), ["case"], ["day", "decision"], ["member"]).withColumnRenamed("member", "last_member")
    told = once.join(last, "case", "left").withColumn("member", F.coalesce(named, "last_member"))
    opens, closes = F.col("event") == "pedido_de_vista", F.col("event") == "devolvido_vista"
    dated = once.where("date is not null").withColumn("late", closes.cast("int"))
    days = greedy_durations(dated, ["case"], ["date", "late"], "date", opens, closes).select("case", F.col("opened").alias("date"), F.lit("pedido_de_vista").alias("event"), "days")
    identity = F.concat_ws(":", F.col("case").cast("string"), F.coalesce(F.col("date").cast("string"), F.lit("None")), "event")
    return told.join(days, ["case", "date", "event"], "left").select(stable_id("se_", identity).alias("event_id"), "case", "movement", "session", "event", "date", "member", "days")
