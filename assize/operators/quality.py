"""Data quality: missing references, overlaps, duplicates, profiles, coverage, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.functions.rules import ladder


def reference_check(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: rows, rows without a key, rows whose key has no parent."""
    known = parent.select(F.col(parent_key).alias("_p")).where("_p is not null").distinct()
    joined = child.select(F.col(key).alias("_k")).join(known, F.col("_k") == F.col("_p"), "left")
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col("_k").isNull()).alias("no_key"), F.count_if(F.col("_k").isNotNull() & F.col("_p").isNull()).alias("orphans"))


def coverage(df: DataFrame) -> DataFrame:
    """Filled rows per column: (column, rows, filled, share). One pass over the table."""
    filled = [F.count(F.when(F.col(c).cast("string") != "", 1)).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("_rows"), *filled)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns])).alias("p")
    return one.select(pairs, F.col("_rows").alias("rows")).select("p.column", "rows", "p.filled", F.bround(F.col("p.filled") / F.col("rows"), 6).alias("share"))


def overlap(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that pairs of tables share: (left, right, common). Each key's tables are gathered once."""
    every = None
    for name, df in parts.items():
        tagged = df.select(F.col(key).alias("key"), F.lit(name).alias("part")).where("key is not null").distinct()
        every = tagged if every is None else every.unionByName(tagged)
    sets = every.groupBy("key").agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)
    pairs = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("common"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, and how many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Per column: nulls, distinct values, longest text, its commonest values and what they look like.

    All columns are turned into rows of (column, value) and counted together, so one shuffle serves all.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counted = df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    shape = ladder([(F.col("value").rlike(r"^-?\d+$"), "integer"), (F.col("value").rlike(r"^-?\d+\.\d+(E-?\d+)?$"), "decimal"), (F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"), "date")], "text")
    rows = counted.withColumn("shape", F.when(F.col("value").isNotNull(), shape))
    most = F.slice(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), "value")))), 1, top)
    ranked = rows.withColumn("place", F.row_number().over(_by_count())).where(f"place <= {top} or value is null").groupBy("column").agg(most.alias("most"))
    shapes = rows.where("shape is not null").groupBy("column", "shape").agg(F.sum("n").alias("n")).groupBy("column").agg(F.max_by("shape", F.struct("n", "shape")).alias("looks_like"))
    sums = rows.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct_values"), F.max(F.length("value")).alias("longest"))
    return sums.join(ranked, "column").join(shapes, "column", "left").select("column", "nulls", "distinct_values", "longest", F.array_join(F.transform("most", lambda x: x["value"]), "|").alias("commonest"), "looks_like")


def _by_count():
    from pyspark.sql import Window as W

    return W.partitionBy("column").orderBy(F.col("value").isNull(), F.desc("n"), "value")


def hashed_sample(df: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """The ``size`` rows of each stratum with the smallest digest of their key: the same on every run."""
    from pyspark.sql import Window as W

    turn = F.row_number().over(W.partitionBy(stratum).orderBy("digest", key))
    return df.withColumn("digest", F.sha2(F.col(key).cast("string"), 256)).withColumn("turn", turn).where(F.col("turn") <= size).drop("digest")
