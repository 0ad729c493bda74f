"""Work that goes on where it stopped: a ledger of finished units beside the data, batches that replace themselves, and a watch for stalls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_LEDGER = "unit string, rows long, finished timestamp"


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, rows, finished): what the ledger of ``folder`` says is done; the last entry of a unit counts."""
    try:
        rows = spark.read.schema(_LEDGER).json(f"{folder}/_ledger")
    except AnalysisException as missing:  # nothing was finished yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _LEDGER)
    return rows.groupBy("unit").agg(F.max_by(F.struct("rows", "finished"), "finished").alias("e")).select("unit", "e.rows", "e.finished")


def run_units(spark: SparkSession, folder: str, units: Iterable[str], make: Callable[[str], DataFrame]) -> list[str]:
    """Make every unit that is not in the ledger, in order, and write it to ``folder/data/unit=<unit>``; returns those made now.

    A unit's rows are written whole before its entry is. A run that ends between the two makes the unit again and replaces what
    it left, so a broken run that is taken up gives what an unbroken one does. Units are names of files, days or pages: a list of the caller's.
    """
    done = {r["unit"] for r in finished(spark, folder).select("unit").collect()}
    made = []
    for unit in units:
        if unit in done:
            continue
        place = f"{folder}/data/unit={unit}"
        make(unit).write.mode("overwrite").parquet(place)
        rows = spark.read.parquet(place).count()
        entry = spark.range(1).select(F.lit(unit).alias("unit"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("finished"))
        entry.write.mode("append").json(f"{folder}/_ledger")
        made.append(unit)
    return made


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of finished units alone, with their unit."""
    return spark.read.parquet(f"{folder}/data").withColumn("unit", F.col("unit").cast("string")).join(F.broadcast(finished(spark, folder).select("unit")), "unit", "left_semi")


def replacing(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes every batch to a place of its own and replaces it, so that a batch seen again counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


class Watch(StreamingQueryListener):
    """What streams have done lately; a query that took no rows for a while is stalled."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.rows: dict[str, int] = {}
        self.moved: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows[str(event.id)], self.moved[str(event.id)] = 0, self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key, rows = str(event.progress.id), event.progress.numInputRows
        self.rows[key] = self.rows.get(key, 0) + rows
        if rows or key not in self.moved:
            self.moved[key] = self.clock()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing new to read is no progress."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.moved.pop(str(event.id), None)

    def stalled(self, seconds: float) -> list[str]:
        """Running queries that took no rows for ``seconds`` or longer."""
        now = self.clock()
        return sorted(key for key, at in self.moved.items() if now - at >= seconds)
