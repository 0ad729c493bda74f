"""Gates before results are served: sources and modules, counts and keys, rows kept, nodes and edges of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.functions.text import stable_id


def module_availability(modules: DataFrame, counts: DataFrame) -> DataFrame:
    """(module, rows, status) of modules (module, source, found) by their rows (module, rows).

    Available with rows; empty after the build where the source was found; else the source is missing.
    """
    rows = F.coalesce("rows", F.lit(0))
    status = F.when(rows > 0, "available").when(F.col("source").isNotNull() & F.col("found"), "empty_after_build").otherwise("missing_source")
    return modules.join(counts, "module", "left").select("module", rows.alias("rows"), status.alias("status"))


def audit_gates(groups: DataFrame, links: DataFrame, alerts: DataFrame, group: str, event: str, size: str) -> DataFrame:
    """(gate, faults, status): links without group, groups whose size is not that of their links, links told twice, alerts without link."""
    told = links.groupBy(group).agg(F.count("*").alias("_n"))
    again = links.groupBy(group, event).agg(F.count("*").alias("_n")).where("_n > 1")
    checks = {
        "link_without_group": links.join(groups.select(group), group, "left_anti"),
        "size_differs": groups.join(told, group, "left").where(F.col(size) != F.coalesce("_n", F.lit(0))),
        "link_repeated": again,
        "alert_without_link": alerts.join(links.select(group, event), [group, event], "left_anti"),
    }
    out = None
    for gate, rows in checks.items():
        one = rows.agg(F.count("*").alias("faults")).select(F.lit(gate).alias("gate"), "faults", F.when(F.col("faults") > 0, "fail").otherwise("ok").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def rows_preserved(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose number of rows a cleaning step changed: rows before, rows after."""
    counts = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    met = counts(before, "before").join(counts(after, "after"), by, "full").select(*by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return met.where("before != after")


def graph_nodes(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(node_id, kind, label) of sources (key, label), in order: of one kind's equal keys the first source and then the smallest label win."""
    every = None
    for turn, (kind, df) in enumerate(parts):
        rows = df.where("key is not null").select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.col("label"), F.lit(turn).alias("_turn"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("kind", "key").agg(F.min(F.struct("_turn", "label")).alias("b"))
    return best.select(stable_id("gn_", F.concat_ws(":", "kind", "key")).alias("node_id"), "kind", F.col("b.label").alias("label"))


def risk_paths(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(path_id, start, finish, kind) of one step along edges (src, dst, kind) that carry risk; a path that several kinds give is told once."""
    rows = edges.where(F.col("kind").isin(kinds)).groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    return rows.select(stable_id("gp_", F.concat_ws(":", "src", "dst")).alias("path_id"), F.col("src").alias("start"), F.col("dst").alias("finish"), "kind")
