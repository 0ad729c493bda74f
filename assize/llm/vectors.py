"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one and equal ones become one class. In every table a class falls into the
bucket of its quantised random projections, floor((a.x + b) / w). What is shuffled by bucket is a class's
number and a sketch of 64 signs, not its vector. Classes that share a bucket and have near sketches are
candidates; a pair is kept once, under the least of its buckets, so the vectors travel to few buckets only,
where the exact cosine is taken in double precision. Links are summed up and edges reduced to a spanning
forest by bucket, so pairs are not written.

A bucket of more than ``LIMIT`` classes is not expanded into candidates: its vectors are compared block by
block, and a pair counts in the first of the large buckets that it shares. Candidates of small buckets that
also share a large one are left to that.

The number of projections grows with the logarithm of the number of classes, so that unrelated vectors
(distance 1.41) fill a bucket with some eight classes at any size; the number of tables grows with it, so
that a pair at the threshold (cosine 0.9, distance 0.447) shares a bucket with probability 0.93, a closer
one with more: at 0.95 with 0.999. 50,000 classes take 13 projections and 33 tables.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links
and a class of their own; vectors of other lengths never link; repeated rows link with each other; an
empty table gives an empty table; labels and extra columns are ignored; null ids link, but never name a
class that has another id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.operators.components import connected_components
from assize.operators.skew import meet
from assize.session import cut

COSINE, RECALL, WIDTH = 0.9, 0.93, 2.0
#: Unrelated classes in a bucket, on average.
OCCUPANCY = 8
SEED = 17
#: Buckets of more classes than this are compared by blocks.
LIMIT = 128
BLOCK = 1_024
#: Candidates checked together, on average.
PAIRS = 2_048
#: Rows of a block compared at once.
TILE = 512
#: Cosines this near the threshold are taken again in a fixed order of summation.
ROUNDING = 1e-9


def collision(distance: float, width: float) -> float:
    """How likely one projection puts two vectors of this distance into one cell."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(classes: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections) for a number of classes."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(classes, 1) / OCCUPANCY + 1) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**projections))), projections


def hyperplanes(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    return rng.standard_normal((size, tables * projections)), rng.uniform(0, width, tables * projections)


def signatures(unit: np.ndarray, tables: int, projections: int, width: float = WIDTH) -> np.ndarray:
    """For every unit vector a 64-bit bucket number a table."""
    planes, offsets = hyperplanes(unit.shape[1], tables, projections, width)
    cells = np.floor((unit @ planes + offsets) / width).astype(np.int64).reshape(len(unit), tables, projections)
    mixed = np.broadcast_to((np.arange(tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), cells.shape[:2]) ^ np.uint64(unit.shape[1])
    for k in range(projections):
        mixed = (mixed ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def sketches(unit: np.ndarray) -> np.ndarray:
    """The signs of 64 random projections of every unit vector."""
    planes = np.random.default_rng([SEED + 1, unit.shape[1]]).standard_normal((unit.shape[1], 64))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)[:, 0]


def sketch_bits(cosine: float) -> int:
    """How many of 64 signs may differ: 4.5 deviations above what a pair at the threshold has."""
    share = math.acos(cosine) / math.pi
    return math.ceil(64 * share + 4.5 * math.sqrt(64 * share * (1 - share)))


def unit_vectors(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return unit_vectors(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size))


def _bucketed(tables: int, projections: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for k in range(0, part.num_rows, 2_000):
                    some = part.slice(k, 2_000)
                    unit = _matrix(some.column("v"), int(size))
                    listed = pa.FixedSizeListArray.from_arrays(pa.array(signatures(unit, tables, projections, width).ravel()), tables).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column("cid"), pa.array(sketches(unit)), listed], names=["cid", "sketch", "keys"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """A spanning forest of edges."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    kept: tuple[list, list] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


_OUT = "cid long, links long, other long"
_OUT_SCHEMA = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _emit(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.Table:
    """Of pairs of classes (a, b) with their numbers of rows: the links that each class gains, and the edges of a forest (with no links), in one table."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    gained = np.bincount(place, np.concatenate([nb, na]), len(ids)).astype(np.int64)
    ea, eb = _forest(a, b)
    cid = pa.array(np.concatenate([ids, np.array(ea, np.int64)]), pa.int64())
    links = pa.array(np.concatenate([gained, np.zeros(len(ea), np.int64)]), pa.int64())
    return pa.Table.from_arrays([cid, links, pa.array([None] * len(ids) + eb, pa.int64())], schema=_OUT_SCHEMA)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1)


def _large_keys(table: pa.Table) -> list[frozenset]:
    return [frozenset(x or ()) for x in table.column("large").to_pylist()]


def _verified(cosine: float):
    """Checks the candidates of some small buckets on the vectors that came to them."""

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids, n, large = rows.column("cid").to_numpy(), rows.column("n").to_numpy(), _large_keys(rows)
        order = np.argsort(ids)
        i, j = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())] for c in ("a", "b"))
        keep = np.array([not (large[x] & large[y]) for x, y in zip(i.tolist(), j.tolist())], bool)
        dims, found = rows.column("dim").to_numpy(), [_OUT_SCHEMA.empty_table()]
        for size in np.unique(dims):
            at = np.nonzero(dims == size)[0]
            unit = _matrix(rows.column("v").combine_chunks().take(pa.array(at)), int(size))
            row = np.full(len(ids), -1)
            row[at] = np.arange(len(at))
            some = keep & (row[i] >= 0) & (row[j] >= 0)
            p, q = i[some], j[some]
            near = _cosines(unit[row[p]], unit[row[q]]) >= cosine
            found.append(_emit(ids[p[near]], ids[q[near]], n[p[near]], n[q[near]]))
        return pa.concat_tables(found)

    return run


def _blocks(cosine: float):
    """Compares two blocks of a large bucket, tile by tile."""

    def run(batch: pa.Table) -> pa.Table:
        key, low, high = (batch.column(c)[0].as_py() for c in ("key", "low", "high"))
        ids, n, block, dims = (batch.column(c).to_numpy() for c in ("cid", "n", "block", "dim"))
        large = _large_keys(batch)
        found = [_OUT_SCHEMA.empty_table()]
        for size in np.unique(dims):
            left, right = (np.nonzero((dims == size) & (block == b))[0] for b in (low, high))
            unit = {b: _matrix(batch.column("v").combine_chunks().take(pa.array(at)), int(size)) for b, at in ((low, left), (high, right)) if len(at)}
            if len(left) == 0 or len(right) == 0:
                continue
            for k in range(0, len(left), TILE):
                # in a block with itself a pair is met once, from its earlier row
                start = k if low == high else 0
                x, y = unit[low][k : k + TILE], unit[high][start:]
                cosines = x @ y.T
                i, j = np.nonzero(cosines >= cosine - ROUNDING)
                if low == high:
                    i, j = i[i < j], j[i < j]
                sure = cosines[i, j] > cosine + ROUNDING
                if not sure.all():
                    sure[~sure] = _cosines(x[i[~sure]], y[j[~sure]]) >= cosine
                p, q = left[k : k + TILE][i[sure]], right[start:][j[sure]]
                first = np.array([min(large[a] & large[b]) == key for a, b in zip(p.tolist(), q.tolist())], bool) if any(len(v) > 1 for v in large) else np.ones(len(p), bool)
                p, q = p[first], q[first]
                found.append(_emit(ids[p], ids[q], n[p], n[q]))
        return pa.concat_tables(found)

    return run


def links(classes: DataFrame, cosine: float = COSINE, width: float = WIDTH, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(cid, links, other) of distinct vectors (cid, n, dim, v): rows with links add up to a class's number of linked vectors; rows with an other are edges."""
    number = classes.count()
    tables, projections = shape(number, cosine, width)
    marked = classes.select("cid", "dim", "v").mapInArrow(_bucketed(tables, projections, width), "cid long, sketch long, keys array<long>")
    narrow = marked.select("cid", "sketch", F.explode("keys").alias("key"))
    counted = narrow.groupBy("key").agg(F.count("*").alias("n"))
    met = cut(meet(narrow, counted.where("n > 1").withColumnRenamed("n", "rows"), "key", counted, number * tables))
    few = met.where(F.col("rows") <= limit).select("key", "cid", "sketch")
    other = few.select("key", F.col("cid").alias("cid2"), F.col("sketch").alias("sketch2"))
    near = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) <= sketch_bits(cosine)
    pairs = few.join(other, "key").where((F.col("cid") < F.col("cid2")) & near)
    pairs = cut(pairs.groupBy(F.col("cid").alias("a"), F.col("cid2").alias("b")).agg(F.min("key").alias("key")))
    many = met.where(F.col("rows") > limit).select("cid", "key", "rows")
    # a class has at most one large bucket a table
    large = many.groupBy("cid").agg(F.array_sort(F.collect_set("key")).alias("large"))
    known = classes.join(large, "cid", "left")
    # whole buckets, some together, so that a vector comes once for all candidates it has in them
    chunks = -(-pairs.count() // PAIRS) or 1
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")
    members = pairs.select(chunk.alias("together"), F.explode(F.array("a", "b")).alias("cid")).distinct().join(known, "cid")
    small = pairs.groupBy(chunk.alias("chunk")).cogroup(members.groupBy("together")).applyInArrow(_verified(cosine), _OUT)
    placed = many.join(known, "cid").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    dealt = placed.select("key", "cid", "n", "dim", "v", "large", "block", F.explode(both).alias("p")).select("*", "p.low", "p.high").drop("p")
    return small.union(dealt.groupBy("key", "low", "high").applyInArrow(_blocks(cosine), _OUT))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id) of every row."""
    kept = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if kept else F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = rows.select(F.col(id_col).alias("id"), vector.alias("v")).withColumn("usable", usable)
    # equal vectors share a digest of 128 bits; zero and minus zero hash alike
    digest = F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit("second"), "v").alias("y"))
    known = plain.select("id", F.when(F.col("usable"), digest).alias("digest"), F.when(F.col("usable"), F.col("v")).alias("v"))
    classes = known.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    # numbers of the rows as they are stored: none occurs twice
    classes = cut(classes.select("digest", "n", "least", F.size("v").alias("dim"), "v", F.monotonically_increasing_id().alias("cid")))
    found = cut(links(classes.select("cid", "n", "dim", "v"), cosine))
    roots = connected_components(found.where("other is not null"), "cid", "other").toDF("cid", "root")
    gained = found.groupBy("cid").agg(F.sum("links").alias("gained"))
    rooted = classes.select("digest", "n", "least", "cid").join(gained, "cid", "left").join(roots, "cid", "left")
    rooted = cut(rooted.select("digest", "n", (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "cid").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    per_class = meet(rooted.drop("n"), named.select("root", "component_id"), "root", named.select("root", "n"), classes.count()).select("digest", "n_links", "component_id")
    out = meet(known.where("digest is not null").select("id", "digest"), per_class, "digest", rooted.select("digest", "n"), rows.count())
    alone = known.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` with its number of links, its class and whether it names the class; odd vectors as the module says."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
