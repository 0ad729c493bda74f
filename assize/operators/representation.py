"""Who acts for whom: activity on edges, windows of a case, roles, profiles of clients, donors that were matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: list[str], value: str, n: str | None = None, name: str = "distribution") -> DataFrame:
    """Per key the counts of a value as text ``a=2,b=1``, sorted; nulls are left out. A text is as long as there are values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(n) if n else F.count("*")).alias("_n"))
    pair = F.concat_ws("=", F.col(value).cast("string"), F.col("_n").cast("string"))
    return counts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias(name))


def edge_activity(edges: DataFrame, events: DataFrame, edge: str, case: str, side: str, member: str, kind: str, date: str) -> DataFrame:
    """Per edge: events, their kinds, first and last day and the days between, and how many other edges stand on its side of the case.

    An edge without a member is no companion, but has all members of its side for companions; a side that is not known is a side of its own.
    Companions are the side's members less the edge's own: two counts, no pairs, so a crowded side is no larger than its rows.
    """
    seen = events.groupBy(edge).agg(F.count("*").alias("events"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    kinds = distribution(events, [edge], kind, name="kinds")
    known = edges.where(F.col(member).isNotNull()).select(F.col(case).alias("_case"), F.col(side).alias("_side"), F.col(member).alias("_member"))
    own = known.groupBy("_case", "_side", "_member").agg(F.count("*").alias("_own"))
    every = own.groupBy("_case", "_side").agg(F.sum("_own").alias("_every"))
    here = lambda t: (F.col(case) == F.col(f"{t}._case")) & F.col(side).eqNullSafe(F.col(f"{t}._side"))
    out = edges.join(seen, edge, "left").join(kinds, edge, "left")
    out = out.join(every.alias("e"), here("e"), "left").join(own.alias("o"), here("o") & (F.col(member) == F.col("o._member")), "left")
    return out.select(
        edge, member, F.coalesce("events", F.lit(0)).alias("events"), "kinds", "first_day", "last_day",
        F.coalesce(F.datediff("last_day", "first_day"), F.lit(0)).alias("span_days"), (F.coalesce("_every", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("companions"),
    )


def window_rollup(links: DataFrame, events: DataFrame, member: str, case: str, window: str, date: str) -> DataFrame:
    """Per member and window: events, cases, first and last day; an event without a member counts for all members of its case.

    Events outside every window are left out. They are summed by case and window before they meet the members.
    """
    span = lambda df, by: df.groupBy(*by, window).agg(F.count("*").alias("_n"), F.min(date).alias("_from"), F.max(date).alias("_to"))
    known = events.where(F.col(window).isNotNull())
    own = span(known.where(F.col(member).isNotNull()), [member, case])
    shared = span(known.where(F.col(member).isNull()), [case]).join(links.select(case, member).where(F.col(member).isNotNull()).distinct(), case)
    both = own.unionByName(shared).groupBy(member, window, case).agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return both.groupBy(member, window).agg(F.sum("_n").alias("events"), F.count("*").alias("cases"), F.min("_from").alias("first_day"), F.max("_to").alias("last_day"))


def role_network(edges: DataFrame, briefs: DataFrame, contexts: DataFrame, member: str, case: str, start: str, end: str, dims: list[str]) -> DataFrame:
    """Per member of a role: cases by edges or briefs, edges, first and last day of the edges, and the cases' distribution by each dimension.

    ``contexts`` has one row a case.
    """
    of_edges = edges.where(F.col(member).isNotNull())
    spans = of_edges.groupBy(member).agg(F.count("*").alias("edges"), F.least(F.min(start), F.min(end)).alias("first_day"), F.greatest(F.max(start), F.max(end)).alias("last_day"))
    cases = of_edges.select(member, case).unionByName(briefs.where(F.col(member).isNotNull()).select(member, case)).distinct()
    known = cases.join(contexts.select(case, *dims), case, "left")
    out = known.groupBy(member).agg(F.count("*").alias("cases")).join(spans, member, "left")
    for dim in dims:
        out = out.join(distribution(known, [member], dim, name=f"by_{dim}"), member, "left")
    return out.select(member, "cases", F.coalesce("edges", F.lit(0)).alias("edges"), "first_day", "last_day", *[f"by_{d}" for d in dims])


def client_profiles(clients: DataFrame, entries: DataFrame, flagged: DataFrame, member: str, client: str, case: str, fav: str, delta: float = 0.15, least: int = 3) -> DataFrame:
    """Per member with a flagged client: clients, flagged ones, the favourable rate of these and of all, and whether it stands out.

    It does where the rate of flagged clients is more than ``delta`` above that of all, over ``least`` or more of their cases.
    ``fav`` is 1, 0 or null (not classified), by the client's role. Clients are summed once, however many members have them.
    """
    sums = entries.groupBy(client).agg(F.sum(fav).alias("_fav"), F.count(fav).alias("_n"))
    pairs = clients.select(member, client).distinct().join(flagged.select(F.col(client), F.lit(True).alias("_flag")).distinct(), client, "left").join(sums, client, "left")
    on = F.col("_flag")
    rates = pairs.groupBy(member).agg(
        F.count("*").alias("clients"), F.count(F.when(on, 1)).alias("flagged"), F.sum("_fav").alias("_f"), F.sum("_n").alias("_c"),
        F.sum(F.when(on, F.col("_fav"))).alias("_ff"), F.sum(F.when(on, F.col("_n"))).alias("_fc"),
    ).where("flagged > 0")
    met = pairs.where(on).select(member, client).join(entries.select(client, case).distinct(), client).groupBy(member).agg(F.count_distinct(case).alias("_cases"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = rates.join(met, member, "left").withColumn("_fr", rate("_ff", "_fc")).withColumn("_or", rate("_f", "_c"))
    stands_out = F.coalesce((F.col("_fr") > F.col("_or") + delta) & (F.col("_cases") >= least), F.lit(False))
    return out.select(member, "clients", "flagged", F.bround("_fr", 6).alias("flagged_rate"), F.bround("_or", 6).alias("overall_rate"), stands_out.alias("stands_out"))


def matched_donors(donations: DataFrame, matched: DataFrame, key: str, year: str, amount: str, strata: list[str]) -> DataFrame:
    """Donations of matched donors alone: sum, number, mean, years, their span, largest shares, and whether one falls in the last two years.

    The last two years are those of all donations. A blank stratum has no share, nor has a donor whose sum is not above zero.
    """
    last = donations.where(F.col(year).isNotNull()).select(year).distinct().orderBy(F.desc(year)).limit(2).agg(F.min(year).alias("_since"))
    own = donations.join(matched.select(key).distinct(), key, "left_semi")
    out = own.groupBy(key).agg(
        F.sum(amount).alias("_sum"), F.count("*").alias("donations"), F.count_distinct(year).alias("years"), F.min(year).alias("_from"), F.max(year).alias("_to"),
    )
    value = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.nullif(F.trim(F.col(s).cast("string")), F.lit("")).alias("value")) for s in strata])).alias("s")
    parts = own.select(key, F.col(amount).alias("_amount"), value).where("s.value is not null").groupBy(key, "s.stratum", "s.value").agg(F.sum("_amount").alias("_part"))
    tops = parts.groupBy(key).pivot("stratum", strata).agg(F.max("_part")).select(key, *[F.col(s).alias(f"_top_{s}") for s in strata])
    share = lambda s: F.when(F.col("_sum") > 0, F.bround(F.col(f"_top_{s}") / F.col("_sum"), 4)).alias(f"top_share_{s}")
    out = out.join(tops, key, "left").join(F.broadcast(last))
    return out.select(
        key, F.bround("_sum", 2).alias("total"), "donations", F.bround(F.col("_sum") / F.col("donations"), 2).alias("mean"), "years",
        (F.col("_to") - F.col("_from") + 1).alias("year_span"), F.coalesce(F.col("_to") >= F.col("_since"), F.lit(False)).alias("recent"), *[share(s) for s in strata],
    )


def favourable(fav: Column, passive: Column) -> Column:
    """An outcome from a party's side: what favours the active party is against the passive one."""
    return F.when(passive, 1 - fav).otherwise(fav)
