"""How the sources of a language differ from each other, by the terms they use: dense tiles of counts, groups by terms.

A term is a run of letters or of any signs beyond ASCII; only A to Z are lower-cased. A language keeps the terms that
stand in at least ``least_docs`` of its documents. A group is a (lang, source). With N a group's occurrences of kept
terms and V the language's number of kept terms, a term of n occurrences has the share
p = 1 + floor(10^9 (n + 1) / (N + V)), and f = floor((p - q)^2 / q) measures p against q. Part ``pair`` sums f over all
kept terms, with q from another source of the language; part ``term`` lists the terms that a source uses and whose p is
above the q of the whole language, best first, ``top`` of them.

Every task counts its own documents first, so a source or a term that holds most rows reaches the shuffle as an entry a
task; entries travel packed, a row for each group and block of terms. Terms are dealt to blocks by hash, as many as the
texts' bytes ask for. A block of a language is one dense tile of
int64, groups by terms: all pairs of groups are compared by broadcasting, a bounded number of cells at a time. Blocks
give partial matrices of pairs, which are summed, and the best terms of every group, which are merged. All arithmetic is
exact: products stay below 2^63 as long as no term occurs 9 x 10^15 times. A language's groups stand together in a tile,
as every pair of them is a row of the result.

Defined results: null text, lang and source are empty strings; a group without terms has its pairs, with N = 0; a
language without kept terms has pairs of value 0; repeated rows count each; ties are ranked by the item's UTF-8 bytes;
an empty table gives an empty table; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.session import cut

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Distinct (group, term) that a task counts before it hands them on; bytes of text a block stands for; cells compared at once.
HELD, BLOCK_BYTES, CELLS = 500_000, 8_000_000, 1 << 20

#: ASCII letters in lower case and all bytes beyond ASCII stay; any other byte parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = "lang string, block int, source string, terms binary, numbers binary"
_TILE = "lang string, block int, sources array<string>, totals array<long>, kept long, terms binary, counts binary"
_OUT = "lang string, source string, part string, item string, value long"
_OUT_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 ``text``, in order."""
    return text.translate(_TERM_BYTES).split()


def _counted(blocks: int):
    """(lang, block, source, terms, numbers) of batches of (lang, source, text), summed within the task; numbers are occurrences, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                at = np.array([zlib.crc32(t) for t in counts], np.int64) % blocks
                order = np.argsort(at, kind="stable")
                listed, packed = list(counts), np.array(list(counts.values()), np.int64)
                ends = np.flatnonzero(np.diff(at[order], append=-1)) + 1
                rows = []
                for x, y in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    some = order[x:y]
                    numbers = np.concatenate([packed[some] >> 31, packed[some] & 0x7FFFFFFF])
                    rows.append((int(at[some[0]]), zlib.compress(b" ".join([listed[k] for k in some.tolist()]), 1), zlib.compress(numbers.tobytes(), 1)))
                columns = [pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([source] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "block", "source", "terms", "numbers"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts = held.setdefault((lang, source), {})
                before = len(counts)
                # occurrences and documents in one number
                for term, n in Counter(terms(text.as_buffer().to_pybytes())).items():
                    counts[term] = counts.get(term, 0) + (n << 31) + 1
                size += len(counts) - before
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return run


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (counts + 1) / totals), exactly; SCALE is taken in three steps so that products stay small."""
    out, left = np.zeros(counts.shape, np.int64), counts + 1
    for _ in range(3):
        part, left = np.divmod(left * 1000, totals)
        out = out * 1000 + part
    return out + 1


def _measured(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Sums over the terms of f, row against row; ``p`` is groups by terms."""
    groups, size = p.shape
    sums = np.zeros((groups, groups), np.int64)
    rows = max(1, min(groups, CELLS // max(groups, 1)))
    width = max(1, CELLS // max(rows * groups, 1))
    for k in range(0, size, width):
        part = p[:, k : k + width]
        for g in range(0, groups, rows):
            sums[g : g + rows] += _measured(part[g : g + rows, None, :], part[None, :, :]).sum(axis=2)
    return sums


def _tile(least_docs: int):
    """Entries of a block as one dense tile of the terms that are kept."""

    def run(group: pa.Table) -> pa.Table:
        names, place = group.column("source").combine_chunks().dictionary_encode(), {}
        parts = []
        for source, raw, numbers in zip(names.indices.to_pylist(), group.column("terms"), group.column("numbers")):
            listed = zlib.decompress(raw.as_buffer()).split(b" ")
            at = np.array([place.setdefault(t, len(place)) for t in listed])
            parts.append((source, at, np.frombuffer(zlib.decompress(numbers.as_buffer()), np.int64).reshape(2, -1)))
        counts, docs = np.zeros((len(names.dictionary), len(place)), np.int64), np.zeros(len(place), np.int64)
        for source, at, numbers in parts:
            counts[source, at] += numbers[0]
            docs[at] += numbers[1]
        kept = docs >= least_docs
        counts = counts[:, kept]
        listed = b" ".join([t for t, k in zip(place, kept.tolist()) if k])
        row = {"lang": group.column("lang")[0].as_py(), "block": group.column("block")[0].as_py(), "sources": names.dictionary.to_pylist(), "totals": counts.sum(axis=1).tolist(), "kept": counts.shape[1], "terms": zlib.compress(listed, 1), "counts": zlib.compress(counts.tobytes(), 1)}
        return pa.Table.from_pylist([row], _TILE_SCHEMA)

    return run


_TILE_SCHEMA = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("kept", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])


def _compared(top: int):
    """A tile's partial sums of pairs, and the best terms of its groups; a language without a tile there gives zeros."""

    def run(tiles: pa.Table, groups: pa.Table) -> pa.Table:
        lang, kept_terms = groups.column("at_lang")[0].as_py(), groups.column("all_kept")[0].as_py()
        sources = [g["source"] for g in groups.column("groups")[0].as_py()]
        totals = np.array([g["total"] for g in groups.column("groups")[0].as_py()], np.int64)
        names, size = [], 0
        if tiles.num_rows:
            names, size = zlib.decompress(tiles.column("terms")[0].as_buffer()).split(), tiles.column("kept")[0].as_py()
        counts = np.zeros((len(sources), size), np.int64)
        if size:
            place = {s: k for k, s in enumerate(sources)}
            rows = [place[s] for s in tiles.column("sources")[0].as_py()]
            counts[rows] = np.frombuffer(zlib.decompress(tiles.column("counts")[0].as_buffer()), np.int64).reshape(len(rows), size)
        p, q = shares(counts, totals[:, None] + kept_terms), shares(counts.sum(axis=0), totals.sum() + kept_terms)
        sums = pair_sums(p)
        out: list[tuple] = [(s, "pair", t, int(sums[g, h])) for g, s in enumerate(sources) for h, t in enumerate(sources) if g != h]
        for g, s in enumerate(sources):
            at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            f = _measured(p[g, at], q[at])
            if len(at) > top:  # what is below the last value that can be among the first goes
                strong = f >= np.partition(f, len(f) - top)[len(f) - top]
                at, f = at[strong], f[strong]
            best = heapq.nsmallest(top, zip((-f).tolist(), (names[k] for k in at)))
            out += [(s, "term", t.decode(), -v) for v, t in best]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array(c, _OUT_SCHEMA.field(k + 1).type) for k, c in enumerate(columns))], schema=_OUT_SCHEMA)

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``; see the module."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    tiles = cut(rows.mapInArrow(_counted(blocks), _COUNTS).groupBy("lang", "block").applyInArrow(_tile(least_docs), _TILE))
    found = tiles.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("g")).select("lang", "g.sources", "g.totals")
    every = rows.select("lang", F.col("source").alias("sources")).distinct().withColumn("totals", F.lit(0).cast("long"))
    totals = found.union(every).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("totals").alias("total"))
    kept = tiles.groupBy("lang").agg(F.sum("kept").alias("kept"))
    by_lang = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")).join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    spread = by_lang.select(F.col("lang").alias("at_lang"), "groups", F.col("kept").alias("all_kept"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at_block"))
    parts = cut(tiles.groupBy("lang", "block").cogroup(spread.groupBy("at_lang", "at_block")).applyInArrow(_compared(top), _OUT))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(ranked)).union(parts.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the others of its language, and its terms against the language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), w AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, w.source, w.term
), gn AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (gn.total + v.v)::HUGEINT AS p
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)::HUGEINT) // (t.total + v.v)::HUGEINT AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) t USING (lang) GROUP BY c.lang, c.term, t.total, v.v
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
