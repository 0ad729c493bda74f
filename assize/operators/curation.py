"""Curated records and the rules of the query surface: events, coverage, qualification, provenance, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.text import blank_to_null, entity_name, stable_id, tax_id, valid_company_id, valid_person_id


def decision_events(rows: DataFrame, texts: DataFrame, key: str, number: str, date: str, file: str) -> DataFrame:
    """Decision rows as events: a stable id, year and month, and of the texts (number, date, doc_id) of their case and day the first.

    Rows without a case number are left out; a row without a text has none.
    """
    first = texts.groupBy("number", "date").agg(F.min("doc_id").alias("doc_id"))
    day = F.date_format(date, "yyyy-MM-dd")
    named = rows.withColumn("_number", blank_to_null(F.col(number))).where("_number is not null")
    ids = stable_id("de_", F.concat_ws(":", F.lit(file), F.col(key).cast("string"), F.col("_number")))
    events = named.select(ids.alias("event_id"), stable_id("proc_", F.col("_number")).alias("process_id"), F.col("_number"), day.alias("_day"), F.year(date).alias("decision_year"), F.date_format(date, "yyyy-MM").alias("time_bucket"))
    met = events.join(first, (F.col("_number") == F.col("number")) & (F.col("_day") == F.col("date")), "left")
    return met.select("event_id", "process_id", "decision_year", "time_bucket", "doc_id")


def month_coverage(df: DataFrame, by: list[str], date: str, recess: tuple[int, ...] = (1, 7)) -> DataFrame:
    """Per key and month: active days over business days as a tier, and whether it looks like leave or a gap in publication.

    Leave: outside recess, fewer than 5 active days after three months (recess left out) with 15 on average.
    A gap: a ratio below 0.3 after three months or more with over 0.5 on average.
    """
    days = df.select(*by, F.to_date(date).alias("day")).distinct()
    months = days.groupBy(*by, F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("days"))
    months = months.withColumn("workdays", F.size(F.filter(F.sequence("month", F.last_day("month")), lambda d: F.weekday(d) < 5))).withColumn("exact", F.col("days") / F.col("workdays")).withColumn("recess", F.month("month").isin(*recess))
    order = W.partitionBy(*by).orderBy("month")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    open_ = F.when(~F.col("recess"), F.col("days"))
    turns = months.withColumn("turn", F.coalesce(F.sum((~F.col("recess")).cast("int")).over(before), F.lit(0))).withColumn("upto", F.coalesce(F.sum(open_).over(before), F.lit(0)))
    known = turns.where("not recess").select(*by, F.col("turn").alias("t"), F.col("upto").alias("u"))
    back = turns.join(known.select(*[F.col(c).alias(f"_{c}") for c in by], "t", "u"), [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("t") == F.col("turn") - 3], "left")
    leave = ~F.col("recess") & (F.col("turn") >= 3) & ((F.col("upto") - F.col("u")) / 3 >= 15) & (F.col("days") < 5)
    prior = F.avg("exact").over(before)
    gap = (F.count("*").over(before) >= 3) & (F.col("exact") < 0.3) & (prior > 0.5)
    tier = F.when(F.col("exact") >= 0.6, "high").when(F.col("exact") >= 0.3, "medium").otherwise("low")
    return back.select(*by, "month", "days", "workdays", F.bround("exact", 4).alias("ratio"), "recess", F.coalesce(leave, F.lit(False)).alias("leave"), F.coalesce(gap, F.lit(False)).alias("gap"), tier.alias("tier"))


def qualifies(substantive: Column, flag: Column, has_substantive: Column) -> Column:
    """Whether a row counts as a signal: where the substantive flag is there it alone decides, even if null."""
    return F.when(has_substantive, F.coalesce(substantive, F.lit(False))).otherwise(F.coalesce(flag, F.lit(False)))


def institutional(df: DataFrame, name: str, structural: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """``df`` with ``basis``: structural if the name is in ``structural`` (name), else by prefix, else private."""
    known = structural.select(F.upper("name").alias("_known")).distinct()
    upper = F.upper(name)
    by_prefix = F.lit(False)
    for p in prefixes:
        by_prefix = by_prefix | F.startswith(upper, F.lit(p))
    basis = F.when(F.col("_known").isNotNull(), "structural").when(by_prefix, "fallback:name_prefix").otherwise("private")
    return df.join(known, upper == F.col("_known"), "left").withColumn("basis", basis).drop("_known")


def co_members(links: DataFrame, case: list[str], member: str) -> DataFrame:
    """Per member: how many sides of cases it is on, and how many other members it shares one with. A side that is not known is a side of its own."""
    rows = links.where(F.col(member).isNotNull()).select(*case, member).distinct()
    other = rows.toDF(*[f"_{c}" for c in case], "_other")
    same = F.col(member) != F.col("_other")
    for c in case:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pairs = rows.join(other, same)
    with_ = pairs.groupBy(member).agg(F.count_distinct("_other").alias("others"))
    return rows.groupBy(member).agg(F.count("*").alias("cases")).join(with_, member, "left").select(member, "cases", F.coalesce("others", F.lit(0)).alias("others"))


def two_pass_years(df: DataFrame, key: str, year: str, amount: str) -> DataFrame:
    """Sums by key and year first, so that a year may be added alone, then by key: years, rows, total, and the largest year's share."""
    yearly = df.groupBy(key, year).agg(F.count("*").alias("rows"), F.sum(amount).alias("part"))
    out = yearly.groupBy(key).agg(F.count("*").alias("years"), F.sum("rows").alias("rows"), F.sum("part").alias("total"), F.max_by(year, F.struct("part", year)).alias("top_year"), F.max("part").alias("top"))
    return out.select(key, "years", "rows", F.bround("total", 2).alias("total"), "top_year", F.bround(F.col("top") / F.col("total"), 6).alias("top_share"))


def signal_frequency(rows: DataFrame, signals: str, names: list[str]) -> DataFrame:
    """(signal, pairs): in how many rows each named signal is."""
    found = rows.select(F.explode(F.array_distinct(signals)).alias("signal")).groupBy("signal").agg(F.count("*").alias("pairs"))
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "signal string")
    return every.join(found, "signal", "left").select("signal", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def adjusted_delta(delta: Column, with_partner: Column, degree: Column) -> Column:
    """A difference of rates, doubled where a partner is near, and halved for each step of a link beyond the second."""
    return delta * F.when(with_partner, 2.0).otherwise(1.0) * F.when(degree > 2, F.pow(F.lit(0.5), degree - 2)).otherwise(1.0)


def top_value(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """The likeliest value of each key and its share; of equal ones the one that sorts last."""
    w = W.partitionBy(*by)
    shares = counts.withColumn("_p", F.col(n) / F.sum(n).over(w))
    best = shares.groupBy(*by).agg(F.max(F.struct("_p", value)).alias("b"))
    return best.select(*by, F.col(f"b.{value}").alias("expected"), F.bround("b._p", 6).alias("probability"))


def occurrence_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``occurrence``: 0, 1, 2 and so on for rows of equal keys, in order."""
    return df.withColumn("occurrence", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def largest_group(df: DataFrame, key: str, keys_array: str, groups: DataFrame) -> DataFrame:
    """Of the groups (member, group_id, members) that hold any element of an array, the one of most members, then of the smallest id."""
    each = df.select(key, F.explode(keys_array).alias("member")).distinct().join(groups, "member")
    return each.groupBy(key).agg(F.min(F.struct((-F.col("members")).alias("m"), "group_id")).alias("g")).select(key, F.col("g.group_id").alias("group_id"), (-F.col("g.m")).alias("members"))


def capped_by_reason(df: DataFrame, reason: str, order: list[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows, omitted): the first ``most`` rows of each reason, as the report asks, and how many were left out."""
    turn = df.withColumn("_turn", F.row_number().over(W.partitionBy(reason).orderBy(*order)))
    omitted = df.groupBy(reason).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return turn.where(F.col("_turn") <= most).drop("_turn"), omitted


def union_with_provenance(parts: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """The distinct keys of several tables, each with the sorted names of the tables that have it."""
    every = None
    for name, df in parts:
        rows = df.select(*keys, F.lit(name).alias("_from")).distinct()
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_from")), ",").alias("sources"))


def identifier(value: Column) -> Column:
    """(kind, quality, normalized) of an identifier: validated numbers, then other numbers of 8 digits or more, then names."""
    text = blank_to_null(value)
    digits = F.regexp_replace(text, r"[.\-/\s]", "")
    number = digits.rlike(r"^[0-9]{8,}$")
    answer = lambda kind, quality, c: F.struct(F.lit(kind).alias("kind"), F.lit(quality).alias("quality"), c.alias("normalized"))
    out = F.when(text.isNull(), answer("name_raw", "blocked", F.lit(""))).when(text.rlike(r"^\*{2,3}[0-9]{6}\*{2}$"), answer("tax_id_masked", "blocked", text))
    out = out.when(number & valid_company_id(text), answer("cnpj_validated", "deterministic", tax_id(text))).when(number & valid_person_id(text), answer("cpf_validated", "deterministic", tax_id(text)))
    return out.when(number, answer("tax_id_unvalidated", "medium", tax_id(text))).otherwise(answer("name_normalized", "medium", entity_name(text)))


def subject_separators(c: Column) -> Column:
    """Numbered items on lines of their own are set apart by bars; other line ends become spaces; one space stands around bars."""
    text = F.regexp_replace(F.regexp_replace(c, r"\s*\n\s*(?=\d+ - )", " | "), r"\s*\n\s*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\|\|\s*", " || "), r"(?<!\|)\s*\|\s*(?!\|)", " | "))


def page(df: DataFrame, order: list, number: int, size: int, most: int = 100) -> DataFrame:
    """One page of ordered rows: numbers below 1 count as 1, sizes are brought into 1 to ``most``."""
    number, size = max(1, number), min(max(1, size), most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def resolved_filters(asked: DataFrame, options: DataFrame) -> DataFrame:
    """(id, period, body, kind) of filters asked for: a value that no row has falls back to none, a period to the latest; ``__all__`` stays.

    ``options`` (name, value) lists what there is.
    """
    latest = options.where("name = 'period'").agg(F.max("value").alias("latest"))
    has = lambda name: options.where(F.col("name") == name).select(F.col("value").alias(f"known_{name}")).distinct()
    rows = asked.join(has("period"), F.col("period") == F.col("known_period"), "left").join(has("body"), F.col("body") == F.col("known_body"), "left").join(F.broadcast(latest))
    period = F.when(F.col("period") == "__all__", "__all__").otherwise(F.coalesce("known_period", "latest"))
    kind = F.when(F.col("kind").isin("all", "colegiado", "monocratico"), F.col("kind")).otherwise("all")
    return rows.select("id", period.alias("period"), F.col("known_body").alias("body"), kind.alias("kind"))
