"""Near-duplicate documents by the Jaccard similarity of their sets of five-word shingles.

Every set has a 64-bit SimHash fingerprint; those that differ in at most three bits make their sets candidates. Sets of a
similarity of 0.8 mostly differ in more bits, so MinHash adds what fingerprints do not meet, and all candidates are
verified. Every set is dealt to 504 bins by hash and each bin keeps its least value (one-permutation MinHash, empty bins
filled by a fixed order of other bins). Further candidates meet under one of 36 bands of seven bins each. A sketch of one
bit a bin estimates the similarity of candidates where they meet, so that only pairs near the bound or above it
are verified on the whole sets. A pair of similarity 0.8 shares no band with a chance of 2 in 10,000.

A band of more than ``PAIR_LIMIT`` sets is first held against three of them. What then lies outside its largest class
is held against the whole band in blocks of bounded size. Pairs inside a class have nothing to add, so every set is
verified against its likeliest candidate first, by rounds, and only pairs that are across classes after these are verified
one and all. Sets are compared by 32 bits of each hash.

Defined results: words are split at white space, in lower case; a text of fewer than five words is one
shingle; null, empty and blank texts are alike; equal sets are one node; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.llm import simhash
from assize.llm.memory import returning
from assize.llm.simhash import keep_first, named
from assize.operators.components import TASK_ROWS, connected_components
from assize.operators.skew import meet
from assize.session import cut

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 36, 7
#: Bins of a sketch; the bands take the first of them.
BINS, LONGS = 504, 8
#: Bands with more sets than this are not expanded into all pairs.
PAIR_LIMIT = 16
#: Sets of a large band that all its sets are held against at first.
HUBS = 3
#: Sets of a large band that meet in a task are those of two blocks of so many, with so many hashes.
BLOCK, BLOCK_HASHES = 1024, 4_000_000
#: Rounds in which every set is verified against its likeliest candidate only.
ROUNDS = 2
#: Texts described at once.
BATCH = 500

_RNG = np.random.default_rng(42)
_PROBES = _RNG.integers(0, BINS, (32, BINS))
_RANK = _RNG.random((BINS, BINS))
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(0, 1 << 63, BINS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's set of shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))}), np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of least values, one a bin, for every set; an empty bin takes that of the first bin in an order of its own that has one."""
    least, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for k, found in enumerate(sets):
        if len(found):
            at = ((found >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            least[k, at[starts]] = np.minimum.reduceat(found & np.uint64(0xFFFFFFFF), starts) + np.uint64(1)
            full[k, at[starts]] = True
    flat, filled = least.ravel(), full.ravel()
    empty = np.flatnonzero(~full & full.any(axis=1)[:, None])
    first, bin_ = empty - empty % BINS, empty % BINS
    for probe in _PROBES:
        source = first + probe[bin_]
        hit = filled[source]
        flat[first[hit] + bin_[hit]] = flat[source[hit]]
        first, bin_ = first[~hit], bin_[~hit]
    row = first // BINS
    for k, ends in zip(*np.unique(row, return_index=True)) if len(row) else ():
        empty, some = bin_[ends : np.searchsorted(row, k, "right")], np.flatnonzero(full[k])
        least[k, empty] = least[k, some[_RANK[np.ix_(empty, some)].argmin(axis=1)]]
    return least


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of keys, one a band, and of bits, one a bin, for every set; sets of equal minima in a band have equal keys."""
    least = minima(sets)
    keys = (least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * _MIX).sum(axis=2, dtype=np.uint64)
    bits = np.zeros((len(sets), LONGS * 64), np.uint8)
    bits[:, :BINS] = least * _TURN >> np.uint64(63)
    return ((keys ^ (keys >> np.uint64(29))) * _MIX[:, 0]).view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.int64()))


def sketches(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, node, size, fp, bits, bands) of (row, text): the hash of the text's set, its size, its fingerprint, its sketch and its keys."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                sets = [shingles(x.as_py(), width) for x in part.column(1)]
                keys, bits = sketch(sets)
                prints = pa.array(np.array([simhash.of_hashes(x) for x in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), prints, _lists(bits), _lists(keys)], names=["row", "node", "size", "fp", "bits", "bands"])

    return rows.mapInArrow(returning(described), f"row {rows.schema['row'].dataType.simpleString()}, node long, size int, fp long, bits array<long>, bands array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of texts; a hash is cut to 32 bits."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, hashes, held = [], [], 0
            for x in batch.column(0):
                found = shingles(x.as_py(), width)
                nodes.append(_node(found))
                hashes.append((found >> np.uint64(32)).astype(np.uint32).view(np.int32))
                held += len(found)
                if held > 1 << 20:
                    yield _listed(nodes, hashes)
                    nodes, hashes, held = [], [], 0
            if nodes:
                yield _listed(nodes, hashes)

    return texts.mapInArrow(returning(listed), "node long, hashes array<int>")


def _listed(nodes: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.list_(pa.int32()))], names=["node", "hashes"])


def _wanted(nodes: DataFrame, rows: DataFrame, sketched: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of ``nodes``, made again from one text each, so that every node comes once."""
    chosen = sketched.join(nodes.distinct(), "node").groupBy("node").agg(F.min("row").alias("row")).select(F.col("row.id").alias("chosen_id"), F.col("row.text_hash").alias("chosen_hash"))
    texts = rows.select("row.id", "row.text_hash", "text").join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash")), "left_semi")
    return cut(_sets(texts.dropDuplicates(["id", "text_hash"]).select("text"), width))


def _fits(x: str, y: str, least: float) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


def _likely(least: float, alike):
    """Whether sets of ``alike`` equal bits may be similar enough; the estimate's deviation is 0.03 at most, three of which are allowed for."""
    return alike * (2 / BINS) - 1 >= least - 0.1


def _alike(x: str, y: str) -> F.Column:
    """Equal bits of two sketches."""
    return F.lit(BINS) - sum(F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(LONGS))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _settled(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b, alike) that connect what all similar ones do.

    In each round every set is verified against the likeliest candidate that is not in its class yet; rounds end when they
    find nothing. All pairs that are left across classes are then verified.
    """
    left, edges = pairs, None
    for _ in range(ROUNDS):
        if edges is not None:
            left = _apart(left, edges)
        best = left.select(F.explode(F.array(F.struct("a", "b", "alike", F.col("a").alias("of")), F.struct("a", "b", "alike", F.col("b").alias("of")))).alias("p")).select("p.*")
        best = best.groupBy("of").agg(F.max(F.struct("alike", F.xxhash64("a", "b").alias("turn"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        found, count = _few(_verified(best, sets, least))
        edges = found if edges is None else edges.union(found)
        if not count:
            break
    return edges.union(_few(_verified(_apart(left, edges), sets, least))[0])


def _few(edges: DataFrame) -> tuple[DataFrame, int]:
    """``edges``, stored, in as many partitions as their number asks for, and their number."""
    stored = cut(edges)
    count = stored.count()
    return stored.coalesce(max(1, -(-count // TASK_ROWS))), count


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` that are not in one class of ``edges``."""
    roots = cut(connected_components(edges, "a", "b"))
    named = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return cut(named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns))


def _across(many: DataFrame, edges: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) across the classes of ``edges`` in a band: what is outside a band's largest class is held against all of the band.

    A band of several classes is cut into blocks of a bounded number of sets and of hashes; a task has two of them, with sketches and sets,
    and gives edges alone. A set that is found to be similar to one of a class is not held against its others.
    """
    roots = connected_components(edges, "a", "b").toDF("node", "root")
    rooted = cut(many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    major = per_root.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    open_ = meet(rooted.select("key", "node", "size", "root"), major.where("roots > 1"), "key", major.select("key", "n"), rooted.count())
    # a set of block i meets those of block j in the task of (i, j)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = open_.withColumn("own", own).withColumn("other", other).select("key", "node", "size", "root", (F.col("root") != F.col("major")).alias("minor"), "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def linked(group: pa.Table) -> pa.Table:
        node, size, root, minor, own = (group.column(c).to_numpy() for c in ("node", "size", "root", "minor", "own"))
        bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
        hashes = group.column("hashes").combine_chunks()
        values, ends = hashes.flatten().to_numpy(), np.cumsum([0, *hashes.value_lengths().to_numpy()])
        crossing = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        class_, found = root.copy(), []
        for i in np.flatnonzero(minor):
            at = np.flatnonzero((class_ != class_[i]) & ((own != own[i]) if crossing else True) & (~minor | (node > node[i])))
            at = at[np.minimum(size[at], size[i]) >= least * np.maximum(size[at], size[i])]
            alike = BINS - np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            mine = values[ends[i] : ends[i + 1]]
            for j in at[np.argsort(-alike)][: int(_likely(least, alike).sum())].tolist():
                if class_[j] == class_[i]:
                    continue
                theirs = values[ends[j] : ends[j + 1]]
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                if shared >= least * (len(mine) + len(theirs) - shared):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    class_[class_ == class_[j]] = class_[i]
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate("ab")})

    dealt = placed.join(nodes.select("node", "bits").join(sets, "node"), "node")
    return _few(dealt.groupBy("key", "low", "high").applyInArrow(linked, "a long, b long").distinct())[0]


def _by_fingerprint(nodes: DataFrame, least: float, total: int) -> DataFrame:
    """Candidates (a, b) that connect the ``nodes`` whose fingerprints differ in at most three bits."""
    first = F.min(F.struct("node", "size")).alias("first")
    firsts = cut(nodes.groupBy("fp").agg(first, F.count("*").alias("n")))
    ends = lambda c, name: firsts.select(F.col("fp").alias(c), F.col("first").alias(name))
    near = simhash.links(firsts.select("fp")).join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    shared = firsts.where("n > 1")
    equal = meet(nodes.select("fp", "node", "size"), shared.select("fp", "first"), "fp", shared.select("fp", "n"), total).select(F.struct("node", "size").alias("x"), F.col("first").alias("y"))
    fit = near.union(equal).where((F.col("x.node") != F.col("y.node")) & _fits("x.size", "y.size", least))
    return fit.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def links(rows: DataFrame, sketched: DataFrame, least: float = LEAST, width: int = WIDTH, limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``sketched`` as all pairs of similarity ``least`` or more do."""
    nodes = cut(sketched.dropDuplicates(["node"]).select("node", "size", "fp", "bits", "bands"))
    count = nodes.count()
    total = count * BANDS
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    counted = cut(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(meet(keyed, counted, "key", counted, total))
    few, many = met.where(F.col("n") <= limit).select("key", "node", "size"), met.where(F.col("n") > limit)
    other = few.toDF("key", "node2", "size2")
    close = few.join(other, (few.key == other.key) & (F.col("node") < F.col("node2")) & _fits("size", "size2", least)).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    turn = F.struct(F.col("node").alias("node2"), F.col("size").alias("size2"))
    ranked = many.groupBy("key").agg(*[F.min_by(turn, F.xxhash64("node", F.lit(k))).alias(f"hub{k}") for k in range(HUBS)], F.count("*").alias("n"))
    hubs = cut(ranked.select("key", "n", F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("hubs")))
    starred = meet(many.drop("n"), hubs.select("key", "hubs"), "key", hubs.select("key", "n"), total)
    stars = starred.select("node", "size", F.explode("hubs").alias("hub")).select("node", "size", "hub.*").where((F.col("node") != F.col("node2")) & _fits("size", "size2", least))
    pairs = close.union(stars.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))).union(_by_fingerprint(nodes, least, count)).distinct()
    bits = nodes.select("node", "bits")
    alike = _alike("x", "y").cast("int")
    pairs = cut(pairs.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b").select("a", "b", alike.alias("alike")).where(_likely(least, F.col("alike"))))
    crowded = bool(many.limit(1).count())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = _wanted(wanted.union(many.select("node")) if crowded else wanted, rows, sketched, width)
    edges = _settled(pairs, sets, least)
    return edges.union(_across(many.select("key", "node", "size"), edges, nodes, sets, least)) if crowded else edges


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, width: int = WIDTH, limit: int = PAIR_LIMIT) -> DataFrame:
    """(row, root): every row's id and text hash, and its class of near-duplicates."""
    rows = named(docs, id_col, text_col)
    sketched = cut(sketches(rows, width))
    roots = connected_components(links(rows, sketched, least, width, limit), "a", "b").toDF("node", "root")
    return sketched.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of every class of near-duplicates: that of the smallest id."""
    return keep_first(docs, cut(classes(docs, id_col, text_col, least, width)), id_col, text_col)
