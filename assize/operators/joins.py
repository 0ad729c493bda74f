"""Joins beyond a plain equality: latest per key, windows in time, pairs through hubs, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by ``order``; one partial maximum a task, no sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*by).agg(last.alias("last")).select(*by, *[F.col(f"last.{c}").alias(c) for c in columns])


def first_wins(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ingest order."""
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_turn = 1").drop("_turn")


def within_days(left: DataFrame, right: DataFrame, by: list[str], left_date: str, right_date: str, days: int = 60) -> DataFrame:
    """Each left row with the right rows of its key in the ``days`` after it; unmatched left rows stay, once.

    Dates are cut into spans of ``days``: a match lies in the left row's span or the next, so every right row
    takes part in two spans, a hot key is split by time, and one outer join does it all.
    """
    span = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    spans = left.withColumn("_span", span(left_date))
    values = [c for c in right.columns if c not in by]
    other = right.select(*[F.col(c).alias(f"_{c}") for c in by], *values, F.explode(F.array(span(right_date), span(right_date) - 1)).alias("_at"))
    gap = F.datediff(F.col(right_date), F.col(left_date))
    same = (F.col("_span") == F.col("_at")) & (gap > 0) & (gap <= days)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return spans.join(other, same, "left").withColumn("gap_days", gap).select(*left.columns, *values, "gap_days")


def gap_bucket(days: Column) -> Column:
    """1-7, 8-14, 15-30, 31-60 days, or none."""
    return F.when(days.isNull(), "none").when(days <= 7, "d07").when(days <= 14, "d14").when(days <= 30, "d30").when(days <= 60, "d60").otherwise("none")


def not_followed(df: DataFrame, by: list[str], date: str, this: Column, that: Column, days: int = 90, ties: list[str] | None = None) -> DataFrame:
    """Rows of one kind that no row of another kind of the same key follows within ``days``.

    Rows of equal time are put in order by ``ties``. The next such row is found by one window over the key, so nothing is joined.
    """
    ahead = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in (date, *(ties or []))]).rowsBetween(W.unboundedPreceding, -1)
    following = F.last(F.when(that, F.col(date)), ignorenulls=True).over(ahead)
    rows = df.withColumn("next_other", following)
    return rows.where(this & (F.col("next_other").isNull() | (F.datediff("next_other", date) > days)))


def shared_pairs(links: DataFrame, member: str, hub: str, least: int = 2, hub_limit: int = 50) -> DataFrame:
    """Pairs of members with ``least`` or more hubs in common; hubs of more than ``hub_limit`` members say nothing and are left out.

    The limit is part of the meaning, and bounds the pairs of a hub.
    """
    rows = links.select(member, hub).where(F.col(member).isNotNull() & F.col(hub).isNotNull()).distinct()
    small = rows.withColumn("_n", F.count("*").over(W.partitionBy(hub))).where(F.col("_n").between(2, hub_limit)).select(hub, F.col(member).alias("a"))
    pairs = small.join(small.select(hub, F.col("a").alias("b")), hub).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def clients_of(member_links: DataFrame, client_links: DataFrame, bridge: str, member: str, client: str) -> DataFrame:
    """Distinct (member, client) through a bridge such as a case."""
    return member_links.select(bridge, member).distinct().join(client_links.select(bridge, client).distinct(), bridge).select(member, client).distinct()


def multi_path(paths: list[tuple[str, DataFrame, list[str]]], target: DataFrame, key: str) -> DataFrame:
    """A left side joined to ``target`` by several keys in turn, labelled by the path; each (source, target) under its first path."""
    parts = [df.join(target, df[column] == target[key]).select(df["source_id"], target["target_id"], F.lit(n).alias("_turn"), F.lit(name).alias("basis")) for n, (name, df, (column,)) in enumerate(paths)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("source_id", "target_id").agg(F.min_by("basis", "_turn").alias("basis"))


def propagate(direct: DataFrame, bridge: DataFrame, source: str, target: str) -> DataFrame:
    """What a source has, passed to the targets it is linked to, but for those that have it themselves."""
    passed = direct.join(bridge, source).select(F.col(target).alias("holder"), "signal").distinct()
    own = direct.select(F.col(source).alias("holder"), "signal").distinct()
    return own.withColumn("via", F.lit("direct")).unionByName(passed.join(own, ["holder", "signal"], "left_anti").withColumn("via", F.lit("linked")))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
