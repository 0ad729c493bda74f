"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows are placed on a ring by a hash of their key, every shard by hashes of many virtual nodes. A row
belongs to the next virtual node clockwise; if that shard is full, it goes on clockwise to the next one
that is not. A shard is full once it holds (1 + slack) times the mean bytes, so no shard is above that
by more than one row, and a row leaves its own shard only by overflow.

The ring is cut into arcs. Bytes are summed by arc, and the sums, whose number is a parameter, are placed
on the driver; an arc in which a shard fills up is cut there. Rows then find their shard by their arc and
their running bytes in it, and their slot by counts of arcs. No step gathers rows of more than one arc.

Defined results: null texts have size one and crc32 zero; null keys are placed by their text's hash;
repeated rows lie on the same arc, in turn; an empty table gives an empty table; a text larger than a
shard's load makes that shard larger. Extra columns are ignored by ``place`` and kept by ``apply``, where
every row goes to a shard of its own, also if others have its id.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.llm.names import free
from assize.session import cut

SHARDS = 8
VIRTUAL_NODES = 64
SLACK = 0.01
#: Arcs of the ring, a power of two. So many sums reach the driver.
ARCS = 1 << 13


def _mix(x: int) -> int:
    """A 64-bit finaliser: spreads small numbers over the ring."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, nodes: int, arcs: int) -> list[list[int]]:
    """For every arc the shards in the order in which its rows meet them clockwise."""
    points = sorted((_mix((shard << 20) | k) % arcs, shard) for shard in range(shards) for k in range(nodes))
    places = [p for p, _ in points]
    out = []
    for arc in range(arcs):
        start = bisect.bisect_left(places, arc)
        out.append(list(dict.fromkeys(points[(start + k) % len(points)][1] for k in range(len(points)))))
    return out


def fill(loads: dict[int, int], shards: int, nodes: int, arcs: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which running bytes of an arc go to which shard.

    In turn k every piece without a place meets the k-th shard on its way. A shard takes pieces clockwise
    until it is full; the piece that fills it is cut, and the rest goes on.
    """
    order = ring(shards, nodes, arcs)
    room = dict.fromkeys(range(shards), int(sum(loads.values()) * (1 + slack) / shards) + 1)
    waiting = [(arc, 0, size) for arc, size in sorted(loads.items())]
    placed = []
    for turn in range(shards):
        later = []
        for arc, start, stop in waiting:
            shard = order[arc][turn]
            take = min(room[shard], stop - start)
            if take:
                room[shard] -= take
                placed.append((arc, start, start + take, shard))
            if start + take < stop:
                later.append((arc, start + take, stop))
        waiting = later
    return placed


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, nodes: int = VIRTUAL_NODES, slack: float = SLACK, arcs: int = ARCS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spot = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.lit("ring"), F.col(id_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), spot.alias("spot"))
    shift = 64 - (arcs.bit_length() - 1)
    rows = cut(rows.withColumn("arc", F.shiftrightunsigned("spot", shift)))
    loads = {r["arc"]: r["bytes"] for r in rows.groupBy("arc").agg(F.sum("size").alias("bytes")).collect()}
    pieces = fill(loads, shards, nodes, arcs, slack)
    spark = docs.sparkSession
    table = spark.createDataFrame(pieces or [(0, 0, 0, 0)], "arc long, start long, stop long, shard int")
    # at most arcs + shards * shards pieces: a piece is made by an arc or by a shard that fills up in a turn
    ways = F.broadcast(table.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("start", "shard"))).alias("way")))
    within = W.partitionBy("arc").orderBy("spot", "id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    running = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    shard = F.expr("element_at(filter(way, x -> x.start <= before), -1).shard")
    found = cut(running.join(ways, "arc").select("id", "size", "text_crc32", "spot", "arc", shard.alias("shard")))
    counts = found.groupBy("shard", "arc").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "arc", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    turn = F.row_number().over(W.partitionBy("arc", "shard").orderBy("spot", "id", "size", "text_crc32"))
    slots = found.withColumn("turn", turn).join(F.broadcast(offsets), ["shard", "arc"])
    return slots.select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("turn") - 1).cast("long").alias("slot"))


def apply(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` to ``folder``, a subfolder a shard; returns the placement, row by row that of the files.

    Rows of equal id, size and text are told apart by their turn. The subfolders are named ``shard=``, with
    underscores at the end of the name if the table has such a column.
    """
    found = cut(place(docs, id_col, text_col, shards))
    name, key, size, crc, turn = free(docs, "shard", "shard_id", "shard_size", "shard_crc32", "shard_turn")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("*", F.col(id_col).alias(key), (F.octet_length(text) + 1).cast("long").alias(size), F.crc32(text.cast("binary")).alias(crc))
    rows = rows.withColumn(turn, F.row_number().over(W.partitionBy(key, size, crc).orderBy(F.xxhash64(*docs.columns))))
    placed = found.select("id", F.col("size").alias("n_bytes"), F.col("text_crc32").alias("crc"), "shard", F.row_number().over(W.partitionBy("id", "size", "text_crc32").orderBy("shard", "slot")).alias("nth"))
    left, right = rows.alias("rows"), placed.select(F.col("id"), "n_bytes", "crc", "nth", F.col("shard").alias("place")).alias("placed")
    on = F.col(f"rows.{key}").eqNullSafe(F.col("placed.id")) & (F.col(f"rows.{size}") == F.col("placed.n_bytes")) & (F.col(f"rows.{crc}") == F.col("placed.crc")) & (F.col(f"rows.{turn}") == F.col("placed.nth"))
    out = left.join(right, on).select(*[F.col(f"rows.`{c}`") for c in docs.columns], F.col("placed.place").alias(name))
    out.write.partitionBy(name).parquet(folder)
    return found


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its shard and slot; the law is ``bytes``, so nothing is said of a grown ring."""
    found = place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
