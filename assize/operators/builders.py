"""Curated tables: folding files, first records, links, merged entities, checks, evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.text import canonical_name, stable_id


def fold(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: of each column the first value that is set, in ingest order; how many rows it had."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*first, F.count("*").alias("source_rows"))


def named_entities(df: DataFrame, names: str, order: list[str], prefix: str) -> DataFrame:
    """Entities of an array of names: the first spelling of each canonical name, with a stable id."""
    each = df.select(*order, F.posexplode(names).alias("_at", "name")).withColumn("canonical", canonical_name(F.col("name"))).where("canonical is not null")
    first = each.groupBy("canonical").agg(F.min_by("name", F.struct(*order, "_at")).alias("name"), F.count("*").alias("mentions"))
    return first.select(stable_id(prefix, F.col("canonical")).alias("entity_id"), "name", "canonical", "mentions")


def sided_links(links: DataFrame, pair: list[str], side: str) -> DataFrame:
    """Distinct links; those without a side go where the pair has one with a side."""
    rows = links.select(*pair, side).distinct()
    sided = F.max(F.col(side).isNotNull()).over(W.partitionBy(*pair))
    return rows.withColumn("_sided", sided).where(F.col(side).isNotNull() | ~F.col("_sided")).drop("_sided")


def merged_entities(df: DataFrame, name: str, better: list[str], columns: list[str]) -> DataFrame:
    """Records of one canonical name as one: each column from the best record that has it, sources gathered."""
    rows = df.withColumn("canonical", canonical_name(F.col(name))).where("canonical is not null")
    best = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*better, c))).alias(c) for c in columns]
    return rows.groupBy("canonical").agg(*best, F.count("*").alias("records"))


def validate(df: DataFrame, required: list[str], key: list[str], dates: list[str]) -> DataFrame:
    """One row: rows, rows that lack a required field, rows of repeated keys, dates that are not ISO."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    odd = F.lit(False)
    for c in dates:
        odd = odd | (F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}"))
    one = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(lacking).alias("lacking"), F.count_if(odd).alias("odd"))
    return one.agg(F.sum("n").alias("rows"), F.sum("lacking").alias("lacking"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"), F.sum("odd").alias("odd_dates"))


def conflicting_keys(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ in content: how many rows and contents."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct(digest).alias("contents")).where("contents > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; a missing or repeated key is an error when it is read."""
    twice = F.count("*").over(W.partitionBy(key)) > 1
    bad = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is missing"))).when(twice, F.raise_error(F.concat(F.lit(f"{key} is repeated: "), F.col(key).cast("string"))))
    return df.withColumn("_bad", bad.cast("string")).where("_bad is null").drop("_bad")


def evidence(alerts: DataFrame, events: DataFrame, groups: DataFrame, event: str, group: list[str]) -> DataFrame:
    """Each alert with its event and its group's figures."""
    return alerts.join(events, event).join(groups, group, "left")


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, bundle): every row as one JSON text of its columns in order of name."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("bundle"))


def every_nth(df: DataFrame, order: list[str], step: int, by: str) -> DataFrame:
    """Every n-th row of each part in order, from the first."""
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1).where(F.col("_turn") % step == 0).drop("_turn")


def _isolation(values: np.ndarray, fitted: np.ndarray, trees: int, size: int, seed: int) -> np.ndarray:
    """How soon random cuts, drawn on ``fitted``, set each row of ``values`` apart, as a score between 0 and 1: higher is rarer."""
    rng = np.random.default_rng(seed)
    size = min(size, len(fitted))
    depth = np.zeros(len(values))
    expected = lambda m: 2 * (np.log(max(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)

    def walk(sample: np.ndarray, rows: np.ndarray, level: int) -> None:
        spread = [k for k in range(fitted.shape[1]) if len(sample) > 1 and fitted[sample, k].min() < fitted[sample, k].max()]
        if not spread or level >= np.ceil(np.log2(max(size, 2))):
            depth[rows] += level + expected(len(sample))
            return
        k = int(rng.choice(spread))
        cut = rng.uniform(fitted[sample, k].min(), fitted[sample, k].max())
        for low in (True, False):
            # every branch is grown, whether rows come to it or not: the forest is the same for all parts
            walk(sample[(fitted[sample, k] < cut) == low], rows[(values[rows, k] < cut) == low], level + 1)

    for _ in range(trees):
        walk(rng.choice(len(fitted), size, replace=False), np.arange(len(values)), 0)
    return 2.0 ** (-depth / trees / max(expected(size), 1e-9))


def isolation_rarity(df: DataFrame, key: str, group: list[str], fields: list[str], least: int = 30, trees: int = 100, size: int = 256, seed: int = 42, fit_rows: int = 4_096, rows_a_task: int = 50_000) -> DataFrame:
    """An isolation forest per group over the fields' relative frequencies: (key, group, rarity), rarity scaled to 0..1 in its group.

    Groups below ``least`` rows are left out. A group's forest is fitted on the ``fit_rows`` rows with the
    smallest hash of their key, at most, and scores all its rows; a large group is dealt over tasks that each
    grow the same forest.
    """
    w = W.partitionBy(*group)
    rows = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    shares = [(F.count("*").over(W.partitionBy(*group, f)) / F.col("_n")).alias(f"_s{k}") for k, f in enumerate(fields)]
    names = [f"_s{k}" for k in range(len(fields))]
    parts = F.ceil(F.col("_n") / rows_a_task).cast("int")
    encoded = rows.select(key, *group, parts.alias("_parts"), *shares)
    dealt = encoded.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    turn = F.row_number().over(w.orderBy(F.xxhash64(key), key))
    fitted = encoded.withColumn("_turn", turn).where(F.col("_turn") <= fit_rows)
    fitted = fitted.select(*[F.col(c).alias(f"{c}_") for c in group], "_turn", *[F.col(n).alias(f"{n}_") for n in names], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part_"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(key, *group).schema) + ", raw double"

    def score(pdf: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("_turn")
        looks, which = np.unique(pdf[names].to_numpy(float), axis=0, return_inverse=True)
        return pdf[[key, *group]].assign(raw=_isolation(looks, sample[[f"{n}_" for n in names]].to_numpy(float), trees, size, seed)[which.ravel()])

    scored = dealt.groupBy(*group, "_part").cogroup(fitted.groupBy(*[f"{c}_" for c in group], "_part_")).applyInPandas(score, schema)
    ends = {"_lo": F.min("raw").over(w), "_hi": F.max("raw").over(w)}
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return scored.withColumns(ends).select(key, *group, F.round(scaled, 6).alias("rarity"))
