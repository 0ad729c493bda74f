"""Joins in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are met through a broadcast at most.
HOT_KEYS = 5_000
#: Keys of fewer rows than this are never called hot.
HOT_ROWS = 10_000


def meet(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, total: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined (inner or left) to ``table``, in which ``key`` is unique.

    ``sizes`` (key, n) counts the rows of each key and ``total`` is no less than their sum. A key of more than
    ``total / HOT_KEYS`` rows, of which there are fewer than ``HOT_KEYS`` whatever the input, is met through a
    broadcast, so its rows stay where they are; all others are met by shuffle, none with more rows than that.
    """
    bar = max(hot_rows, total // HOT_KEYS)
    if total <= bar:
        return rows.join(table, key, how)
    hot = sizes.where(F.col("n") > bar).select(key).join(table, key, how).withColumn("_hot", F.lit(True))
    flagged = rows.join(F.broadcast(hot), key, "left")
    values = [c for c in table.columns if c != key]
    cold = flagged.where("_hot is null").drop("_hot", *values).join(table, key, how)
    return cold.unionByName(flagged.where("_hot").drop("_hot"))
