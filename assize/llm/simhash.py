"""Near-duplicate documents by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Fingerprints that differ in at most three bits agree, but
for one bit at most, on one half. Every fingerprint is therefore indexed under each half as it is and
under each half with one bit wiped out; an equality join on these keys meets every close pair, and the
full distance is verified. A key that gathers many fingerprints is refined by the same rule on the
other half, and what is still large by wiping out all remaining bits that may differ, which leaves
groups of a few fingerprints; so no pair is lost and no group is expanded into all its pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like
any other; repeated rows and equal texts share a class; an empty table gives an empty table; null ids
link, but never name a class that has another id. Extra columns are ignored by ``components`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.llm.names import free
from assize.operators.components import connected_components
from assize.operators.skew import meet
from assize.session import cut

WORDS_PER_SHINGLE = 3
SEED = 42
#: Keys with more fingerprints than this are refined instead of paired.
PAIR_LIMIT = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    cells = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _COLUMN
    return (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def of_hashes(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes."""
    ones = sum((_ones(hashes[k : k + BLOCK]) for k in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
    return int(sum(1 << int(k) for k in np.nonzero(ones * 2 > len(hashes))[0]))


def fingerprint(text: bytes | None, width: int = WORDS_PER_SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 ``text`` over its word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    if len(words) < width:
        width = len(words)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[:count] - [len(w) + 1 for w in words[:count]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, count, BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK])], np.uint64)
        ones += _ones(hashes)
    return int(sum(1 << int(k) for k in np.nonzero(ones * 2 > count)[0]))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        signed = pa.array(np.array(values, np.uint64).astype(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _key(part: int, wiped: int, value: F.Column) -> F.Column:
    """One long for a part, the bit wiped out of it (-1: none) and its value."""
    if wiped >= 0:
        value = value.bitwiseAND(F.lit(~(1 << wiped)))
    return value.bitwiseOR(F.lit((part << 40) | ((wiped + 1) << 33)))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("n", F.count("*").over(W.partitionBy(*keys))).where("n > 1")


def _pairs(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Pairs that meet under a key of at most ``limit`` fingerprints and are close."""
    small = rows.where(F.col("n") <= limit).select(*keys, "fp")
    other = small.withColumnRenamed("fp", "fp2")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 3
    return small.join(other, keys).where((F.col("fp") < F.col("fp2")) & close).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def links(prints: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in ``prints.fp`` as all pairs within three bits do."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    variants = [_key(part, bit, half) for part, half in ((0, low), (1, high)) for bit in range(-1, 32)]
    first = cut(_counted(prints.select("fp", F.explode(F.array(*variants)).alias("key")), "key"))

    half = F.when(F.shiftright("key", 40) == 0, high).otherwise(low)
    parts = [(0, F.col("rest").bitwiseAND(F.lit(0xFFFF))), (1, F.shiftright("rest", 16))]
    finer = [_key(part, bit, value) for part, value in parts for bit in range(-1, 16)]
    large = first.where(F.col("n") > limit).select("key", "fp", half.alias("rest"))
    second = cut(_counted(large.select("key", "fp", "rest", F.explode(F.array(*finer)).alias("key2")), "key", "key2"))

    free = F.when(F.shiftright("key2", 40) == 0, F.shiftright("rest", 16)).otherwise(F.col("rest").bitwiseAND(F.lit(0xFFFF)))
    wiped = sum((F.shiftright(k, 33).bitwiseAND(F.lit(63)) > 0).cast("int") for k in ("key", "key2"))
    masks = [F.array(*[F.lit(sum(1 << b for b in bits)) for bits in combinations(range(16), 3 - w)]) for w in range(3)]
    chosen = F.when(F.col("wiped") == 0, masks[0]).when(F.col("wiped") == 1, masks[1]).otherwise(masks[2])
    dense = second.where(F.col("n") > limit).select("key", "key2", "fp", free.cast("int").alias("free"), wiped.alias("wiped"))
    hubs = dense.select("key", "key2", "fp", "free", F.explode(chosen).alias("mask")).withColumn("kept", F.expr("free & ~mask"))
    least = F.min("fp").over(W.partitionBy("key", "key2", "mask", "kept"))
    stars = hubs.select(least.alias("a"), F.col("fp").alias("b")).where("a < b")
    return _pairs(first, ["key"], limit).union(_pairs(second, ["key", "key2"], limit)).union(stars).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable by links of at most three bits."""
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(classes.select("fp")), "a", "b").toDF("fp", "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return meet(prints, names, "fp", classes.select("fp", "n"), prints.count()).select("id", "fp", "component_id")


def _text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.col(text_col))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class in ``found`` (row, root), where ``row`` is that of ``named``: the smallest id, null last."""
    first = F.min(F.struct(F.col("row.id").isNull().alias("null"), F.col("row.id").alias("id"), F.col("row.text_hash").alias("text_hash")))
    kept = cut(found.groupBy("root").agg(first.alias("first")).select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("hash")))
    (digest,) = free(docs, "text_hash")
    numbered = docs.withColumn(digest, _text_hash(text_col)).alias("docs")
    rows = numbered.join(kept.alias("kept"), F.col(f"docs.{id_col}").eqNullSafe(F.col("kept.id")) & (F.col(f"docs.{digest}") == F.col("kept.hash")), "left_semi")
    repeated = found.groupBy("row").count().where("count > 1").limit(1).count()
    return (rows.dropDuplicates([id_col, digest]) if repeated else rows).select(*docs.columns)


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text): texts under their id and text hash, which together tell rows apart but for equal ones."""
    return docs.select(F.struct(F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash")).alias("row"), F.col(text_col).alias("text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class of near-duplicates: that of the smallest id, whatever else has this id."""
    prints = cut(fingerprints(named(docs, id_col, text_col), "row", "text"))
    roots = connected_components(links(prints.select("fp").distinct()), "a", "b").toDF("fp", "root")
    found = prints.join(roots, "fp", "left").select(F.col("id").alias("row"), F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, cut(found), id_col, text_col)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and the smallest doc_id of its class; null texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return components(docs).select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
