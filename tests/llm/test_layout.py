"""Mixing, sharding and the pipeline."""

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from assize.llm import mixing, queries, sharding

from .conftest import table


def water_fill(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Shares by weight, capped, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def test_targets(spark):
    sizes = {"a": 10.0, "b": 400.0, "c": 300.0, "d": 5.0, "e": 900.0, None: 100.0, "f": 0.0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size double")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = water_fill(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix(spark, folder, odd, odd_rows, empty):
    rows = mixing.op7_mixing(spark, folder).collect()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op7_mixing"])
    place = [want.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r[k] for k in place) for r in want.fetchall())
    assert Counter(rows) == Counter(mixing.op7_mixing(spark, folder).repartition(2).collect())
    plan = mixing.plan(odd).collect()
    assert len(plan) == len(odd_rows) and all(r["taken"] == r["size"] * r["times"] <= 3 * r["size"] for r in plan)
    assert {r["times"] for r in plan if r["id"] in (2, 3, 4)} == {0}
    mixed = mixing.apply(odd)
    assert mixed.columns == odd.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in plan)
    assert mixing.plan(empty).count() == 0 and mixing.apply(empty).count() == 0


def test_epochs_precede_selection(spark):
    rows = [(k, "word " * (k % 7 + 1), "small" if k < 40 else "zlarge") for k in range(400)]
    by = defaultdict(list)
    for r in mixing.plan(table(spark, rows)).collect():
        by[r["source"]].append(r)
    for found in by.values():
        epochs = int(found[0]["target"] // found[0]["source_size"])
        assert {r["times"] for r in found} <= {epochs, epochs + 1}
        assert 0 <= found[0]["target"] - sum(r["taken"] for r in found) < 1


def test_targets_are_met(spark):
    """Every source's words come within 2 % of its target, whatever its documents; good documents come first."""
    folder = "/root/testdata/sf0.01"
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in mixing.op7_mixing(spark, folder).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    rows = [(k, "word " * 10 if k % 2 else "longerwords " * 10, "a" if k < 400 else "b") for k in range(500)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)], "id long, label int")
    once = [r for r in mixing.plan(table(spark, rows), labels=labels, weights=(1.0, 9.0)).collect() if r["source"] == "a" and r["times"]]
    assert sum(r["id"] % 2 for r in once) > 0.8 * len(once)
    assert sorted(mixing.plan(table(spark, rows), labels=labels, bin_rows=3).collect()) == sorted(mixing.plan(table(spark, rows), labels=labels).collect())


def test_shards(spark, odd, odd_rows, empty, tmp_path):
    rows = [(k, "x" * (k * 37 % 500)) for k in range(3000)]
    found = sharding.place(table(spark, rows), shards=8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) <= 1.01 * mean + 502
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r["id"]: r["shard"] for r in sharding.place(table(spark, rows), shards=9).collect()}
    assert sum(grown[r["id"]] != r["shard"] for r in found) < 0.45 * len(rows)
    import zlib

    strange = sharding.place(odd).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in strange) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert sharding.place(empty).count() == 0
    out = sharding.apply(odd, str(tmp_path / "shards")).collect()
    written = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert set(written[0].asDict()) == {*odd.columns, "shard_"}
    assert Counter((r["doc_id"], r["shard_"]) for r in written) == Counter((r["id"], r["shard"]) for r in out)


def brute_ring(rows, shards, slack=sharding.SLACK, arcs=sharding.ARCS, nodes=sharding.VIRTUAL_NODES):
    """(id, shard) by a walk: rows in order of the ring go clockwise past full shards, turn by turn."""
    mean = sum(r["size"] for r in rows) * (1 + slack) / shards
    points = sorted((sharding._mix((s << 20) | k) % arcs, s) for s in range(shards) for k in range(nodes))
    by_arc = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["arc"], r["spot"], r["id"])):
        by_arc[r["arc"]].append(r)
    pieces, room = {arc: [(0, sum(r["size"] for r in found))] for arc, found in by_arc.items()}, dict.fromkeys(range(shards), int(mean) + 1)
    ways = {}
    for arc in by_arc:
        later = [s for p, s in points if p >= arc] + [s for p, s in points if p < arc]
        ways[arc] = list(dict.fromkeys(later))
    cuts = defaultdict(list)
    for turn in range(shards):
        for arc in sorted(pieces):
            left = []
            for start, stop in pieces[arc]:
                shard = ways[arc][turn]
                take = min(room[shard], stop - start)
                room[shard] -= take
                if take:
                    cuts[arc].append((start, shard))
                if start + take < stop:
                    left.append((start + take, stop))
            pieces[arc] = left
    placed = {}
    for arc, found in by_arc.items():
        before = 0
        for r in found:
            placed[r["id"]] = max(c for c in cuts[arc] if c[0] <= before)[1]
            before += r["size"]
    return placed


def test_ring_against_a_walk(spark):
    """Shards and slots of every row are those of a walk round the ring, shard by shard and row by row."""
    rows = [(k, "x" * (k * 37 % 500)) for k in range(2500)]
    docs = table(spark, rows)
    spots = docs.select(F.col("doc_id").alias("id"), (F.length("text") + 1).alias("size"), F.xxhash64(F.lit("ring"), F.col("doc_id").cast("string")).alias("spot"))
    told = spots.withColumn("arc", F.shiftrightunsigned("spot", 64 - 13)).collect()
    want = brute_ring(told, 8)
    got = sharding.place(docs).collect()
    assert {r["id"]: r["shard"] for r in got} == want
    place = {r["id"]: (r["arc"], r["spot"]) for r in told}
    for shard in range(8):
        mine = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [place[r["id"]] for r in mine] == sorted(place[r["id"]] for r in mine)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, folder)
        seen = spark.createDataFrame(seen.collect(), seen.schema)
        assert seen.columns == docs.columns, name
        counts.append(seen.count())
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] == counts[1]
    final = corpus_pipeline.STAGES[-1][1](spark, seen, folder)
    assert final.count() == counts[3] and final.where("not lossless").count() == 0


def test_pipeline_on_odd_rows(spark, odd, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, folder).count() > 0
        assert stage(spark, empty, folder).count() == 0


def test_stages_keep_clashing_columns(spark, odd, folder):
    """A column named as an operator's own comes through every stage as it was."""
    names = ["piece_ids", "lossless", "piece_seed", "mix_size", "mix_times", "mix_copy", "mix_turn", "pii_id", "pii_hash", "pii_spans", "_text_hash", "kept_id", "first"]
    docs = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        assert set(docs.columns) - {"text"} <= set(out.columns), name
        assert out.count() and all(r[n] == n for r in out.select(*names).collect() for n in names), name


def test_bins_of_keys_are_even(spark):
    """With weights a hundred times apart no bin of keys holds much more than others, the last ones least of all."""
    from math import exp

    weights = [0.02, 0.05, 0.5, 0.9, 0.9, 2.0]
    u = (F.rand(3) * 0.999999 + 5e-7).alias("u")
    rows = spark.range(60_000).select(u, F.element_at(F.lit(weights), (F.col("id") % len(weights) + 1).cast("int")).alias("weight")).withColumn("key", -F.log("u") / F.col("weight"))
    masses = [(r["weight"], r["n"]) for r in rows.groupBy("weight").agg(F.count("*").alias("n")).collect()]
    counted = rows.groupBy(mixing._bin(masses, 300).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("bin").collect()
    assert len(counted) > 290 and max(r["n"] for r in counted) < 2 * 200
    assert all(x["b"] < y["a"] for x, y in zip(counted, counted[1:]))
    assert exp(-counted[-1]["a"] * 0.02) < 0.1


def test_sql_is_text_of_known_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and all(isinstance(v, str) for v in queries.ORACLE_SQL.values())
