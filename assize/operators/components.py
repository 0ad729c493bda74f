"""Connected components of graphs of any size: spanning stars of partitions, then alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.operators.skew import HOT_ROWS, meet
from assize.session import cut

#: Edges a task takes, and tasks at least; what a round shuffles is small long before the edges' own table is.
TASK_ROWS, LEAST_TASKS = 50_000, 8
#: Graphs of no more edges than this are settled in one task.
ONE_TASK = 100_000
#: Edges that a task reduces at once.
REDUCED_AT_ONCE = 1 << 18


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, hot_rows: int = HOT_ROWS, one_task: int = ONE_TASK) -> DataFrame:
    """Map every node of ``edges`` to the smallest node it can reach.

    Returns (node, component); nodes are numbers or strings. Self-loops keep their node; rows with a
    null end are ignored. Every partition first reduces its edges to stars around the smallest nodes, so that a dense
    graph leaves no more edges than it has nodes a partition. ``one_task`` edges or fewer are settled so. While there
    are more, each round points the larger neighbours of every node at its smallest
    neighbour, then the node and its smaller neighbours likewise. Minima are aggregated before they are
    shuffled, and the neighbours of a hub learn its minimum where they are, so a hub is never gathered in
    one task. Only two numbers a round reach the driver. Tasks are as many as the edges left ask for: a graph
    of few edges is not spread over as many partitions as the tables that it comes from.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    state = cut(_stars(pairs))
    left = state.count()
    if left <= one_task:
        return _stars(state.coalesce(1)).toDF("node", "component")
    alone = state.where("u = v").select(F.col("u").alias("node")).distinct()
    state = cut(state.where("u <> v").distinct())
    loops = cut(alone.join(state.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_anti"))
    mark = _mark(state)
    for _ in range(max_rounds):
        tasks = max(LEAST_TASKS, mark[0] // TASK_ROWS)
        state = state.coalesce(tasks)
        both = state.union(state.select("v", "u")).toDF("u", "v")
        large = _with_least(both, both.where("v > u"), 2 * mark[0], hot_rows).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        large = cut(large) if mark[0] > hot_rows else large  # both steps read it several times then
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, large, mark[0], hot_rows)
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        state = cut(after.coalesce(tasks).distinct().coalesce(tasks))
        before, mark = mark, _mark(state)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    state = state.coalesce(max(LEAST_TASKS, mark[0] // TASK_ROWS))
    roots = state.select(F.col("v").alias("node")).distinct()
    return (
        state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
        .union(loops.select("node", F.col("node").alias("component")))
    )


def reduced(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), ascending, and the smallest node that each can reach by them."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v): every node of a partition's edges once, and the smallest node that it can reach within the partition."""
    field = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size, schema = (None, None), [], 0, None

        def settle() -> tuple[np.ndarray, np.ndarray]:
            ends = [np.concatenate([*([held[k]] if held[k] is not None else []), *(w[k] for w in waiting)]) for k in (0, 1)]
            return reduced(*ends)

        for batch in batches:
            schema = batch.schema
            waiting.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            size += batch.num_rows
            if size >= max(REDUCED_AT_ONCE, 0 if held[0] is None else len(held[0])):
                held, waiting, size = settle(), [], 0
        if size:
            held = settle()
        if held[0] is not None:
            kind = schema.field(0).type
            for k in range(0, len(held[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 10_000], kind) for x in held], names=["u", "v"])

    return pairs.mapInArrow(run, f"u {field}, v {field}")


def _with_least(every: DataFrame, rows: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """``rows`` with ``m``, the least neighbour that ``every`` has of their node u."""
    least = every.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return meet(rows, least.select("u", "m"), "u", least.select("u", "n"), total, hot_rows=hot_rows)


def _mark(state: DataFrame) -> tuple:
    row = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
