"""Runs that break and are taken up give what unbroken runs give."""

import time

import pytest
from pyspark.sql import functions as F

from assize.streaming import ledger


class Killed(Exception):
    pass


def test_taken_up_between_units(spark, folder, tmp_path):
    orders = spark.read.parquet(f"{folder}/orders.parquet").withColumn("day", F.date_format("o_orderdate", "yyyy"))
    units = sorted(r["day"] for r in orders.select("day").distinct().collect())
    make = lambda unit: orders.where(F.col("day") == unit)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    assert ledger.run_units(spark, whole, units, make) == units
    calls = []

    def dying(unit):
        calls.append(unit)
        if len(calls) == 3:
            raise Killed
        return make(unit)

    with pytest.raises(Killed):
        ledger.run_units(spark, broken, units, dying)
    # a unit that was written, but not entered: half of it, as a killed writer leaves it
    make(units[2]).limit(5).write.parquet(f"{broken}/data/unit={units[2]}")
    assert {r["unit"] for r in ledger.read_units(spark, broken).select("unit").distinct().collect()} == set(units[:2])
    assert ledger.run_units(spark, broken, units, make) == units[2:]
    assert ledger.run_units(spark, broken, units, make) == []
    rows = lambda place: sorted(map(str, ledger.read_units(spark, place).drop("unit").select(sorted(orders.columns)).collect()))
    assert rows(broken) == rows(whole) and len(rows(whole)) == orders.count()
    assert ledger.finished(spark, broken).agg(F.sum("rows")).first()[0] == orders.count()


def test_replayed_batches_count_once(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    write = ledger.replacing(str(tmp_path / "out"))
    for number, part in ((0, events.where("event_id % 2 = 0")), (1, events.where("event_id % 2 = 1")), (1, events.where("event_id % 2 = 1"))):
        write(part, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_stream_and_stall(spark, folder, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(str(source))
    now = [0.0]
    watch = ledger.Watch(lambda: now[0])
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.schema(events.schema).parquet(str(source))
        query = stream.writeStream.foreachBatch(ledger.replacing(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        for _ in range(50):
            if watch.rows.get(str(query.id)) == events.count():
                break
            time.sleep(0.2)
        assert watch.rows[str(query.id)] == events.count()
        assert watch.stalled(60) == []
        now[0] = 61.0
        assert watch.stalled(60) == [str(query.id)]
        query.stop()
    finally:
        spark.streams.removeListener(watch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
