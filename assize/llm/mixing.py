"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, but at most ``most`` times its own size; what a
source cannot take is shared out again by weight. A source whose target holds its size several times is
taken whole that often; the rest of the target is filled in order of the keys -ln(u) / w, where u is a
number in (0, 1) from a digest of the row and w the document's quality weight, up to the word budget: every
document that ends within it is taken. What is left is filled again, in the same order, with documents that
are no larger than it, ``FILLS`` times in all, so a source misses its target by less than a small document.

A document's quality weight is the smoothed share of good ones among the labelled documents of its kind,
which is told by its numbers of words and of letters a word; without labels all weights are one half.

Prefix sums run in two steps: rows are binned by their key, bins are summed and the sums accumulated, and
only within a bin rows are put in order. The share of keys below a key is known from the weights and how many rows have
each, so bins hold as many rows as others whatever the weights; their number grows with the table, so a source that
holds most rows spreads over many tasks. Rows of equal id and text share a key, and so a bin. The sources themselves are
put in order in one task, a row each.

Defined results: null and empty texts have size zero, are never taken and keep taken = 0; a null source
is a source of its own, the last; keys are drawn by id and text, so rows that share an id or have none have
keys of their own; repeated rows are put in order by id and then by content, so reruns agree; an empty table
gives an empty table; a source without words has target zero; labels of unknown ids and null labels count for
nothing, and of several labels of an id the largest counts. Extra columns are ignored by ``plan`` and kept
by ``apply``. No text is cut.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.llm.names import free
from assize.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Rows in a bin of keys, on average.
BIN_ROWS = 20_000
FILLS = 4
SEED = "mix"
#: Cells a doubling of the key in which the share of keys is drawn as a line, and the powers of two between which keys lie.
CELLS, LOWEST, HIGHEST = 16, -50, 24


def _kind(size: Column, n_chars: Column) -> Column:
    """A document's kind: the binary digits of its number of words, at most 20, and its whole letters a word, at most 15."""
    digits = F.length(F.bin(size))
    letters = F.floor(n_chars / F.greatest(size, F.lit(1)))
    return (F.least(digits, F.lit(20)) * 16 + F.least(letters, F.lit(15))).cast("int")


def _described(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, n_chars, weight, key): sizes in words, and the keys of the sampling."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")
    seeded = F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.length(text).alias("n_chars"), F.md5(seeded).alias("digest"))
    rows = cut(rows.withColumn("kind", _kind(F.col("size"), F.col("n_chars"))))
    weight = F.lit(0.5)
    if labels is not None:
        marked = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
        # at most 320 kinds exist
        shares = rows.join(marked, "id").groupBy("kind").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("share"))
        rows = rows.join(F.broadcast(shares), "kind", "left")
        weight = F.coalesce("share", F.lit(0.5))
    u = (F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return rows.select("id", "source", "size", "n_chars", weight.alias("weight"), (-F.log(u) / weight).alias("key"))


def _bin(masses: list[tuple[float, int]], bins: int) -> Column:
    """The bin of a key: the share of keys below it, where ``masses`` (weight, rows) tell how keys are spread, times ``bins``."""
    total = sum(n for _, n in masses)
    edges = [2.0 ** (k / CELLS) for k in range(LOWEST * CELLS, HIGHEST * CELLS + 1)]
    below = [sum(n * (1 - exp(-w * x)) for w, n in masses) / total for x in edges] if total else [0.0] * len(edges)
    cell = F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), F.floor(F.log2("key") * CELLS) - LOWEST * CELLS)).cast("int")
    table = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")  # noqa: E731  one literal, not one a value
    at = lambda values, k: F.element_at(table(values), cell + k)
    low, high = at(below, 1), at(below, 2)
    share = low + (high - low) * (F.col("key") - at(edges, 1)) / (at(edges, 2) - at(edges, 1))
    return F.floor(F.greatest(low, F.least(high, share)) * F.lit(bins - 1e-6))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight, capped at ``most`` times the size.

    Capped sources are those of the smallest size per weight. In that order the level at which the rest
    would share rises up to the first source that is not capped, and is the right one there. The table
    has a row a source.
    """
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", cycle).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    free = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("ratio") > F.col("level"), F.col("w") * F.coalesce(free, F.lit(0.0))).otherwise(F.col("cap"))
    return weighed.withColumn("level", level).select("source", "source_size", target.alias("target"))


def _ends(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """``rows`` with ``end``: the words up to and with the row, in order of keys within its source. ``bins`` (source, bin, offset)."""
    within = W.partitionBy("source", "bin").orderBy("key", "id", "size", "n_chars").rowsBetween(W.unboundedPreceding, 0)
    table = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "offset")
    placed = rows.withColumn("within", F.sum("size").over(within))
    joined = placed.join(table, placed["source"].eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    return joined.withColumn("end", F.col("offset") + F.col("within")).drop("s", "b", "offset", "within")


def _bins(rows: DataFrame) -> DataFrame:
    """(source, bin, bin_size, offset): the words of each bin, and those before it in its source."""
    earlier = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    return sums.withColumn("offset", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))


def _chosen(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rows`` with ``chosen``: whether they end within their source's gap, in order of keys. ``gaps`` (source, gap)."""
    limits = gaps.select(F.col("source").alias("g_source"), "gap")
    ended = _ends(rows, _bins(rows))
    met = ended.join(limits, ended["source"].eqNullSafe(F.col("g_source")))
    return met.withColumn("chosen", F.col("end") <= F.col("gap")).drop("g_source", "end", "gap")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", labels: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, fills: int = FILLS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(id, source, size, source_size, target, epochs, times, taken) of every row. ``labels`` (id, label) mark good documents with 1."""
    keyed = cut(_described(docs, labels, id_col, text_col, source_col))
    bins = max(64, -(-keyed.count() // bin_rows))
    # a weight is that of a kind, of which there are 320 at most
    masses = [(r["weight"], r["n"]) for r in keyed.groupBy("weight").agg(F.count("*").alias("n")).collect()]
    rows = cut(keyed.select("id", "source", "size", "n_chars", "key", _bin(masses, bins).alias("bin")))
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    totals = cut(totals.withColumn("epochs", epochs.cast("int")).withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size")))
    gaps = totals.select("source", "gap")
    open_, taken = rows.where("size > 0"), rows.where("size = 0").withColumn("chosen", F.lit(False))
    for fill in range(fills):
        limits = gaps.select(F.col("source").alias("g"), F.col("gap").alias("at_most"))
        fits = open_.join(limits, open_["source"].eqNullSafe(F.col("g"))).withColumn("fits", F.col("size") <= F.col("at_most")).drop("g", "at_most")
        taken = taken.union(fits.where("not fits").drop("fits").withColumn("chosen", F.lit(False)))
        met = cut(_chosen(fits.where("fits").drop("fits"), gaps))
        taken = taken.union(met.where("chosen"))
        open_ = met.where("not chosen").drop("chosen")
        used = met.where("chosen").groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "u_source")
        gaps = gaps.join(used, gaps["source"].eqNullSafe(F.col("u_source")), "left").select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        gaps = cut(gaps) if fill + 1 < fills else gaps
    every = taken.union(open_.withColumn("chosen", F.lit(False)))
    table = totals.select(F.col("source").alias("t_source"), "source_size", "target", "epochs")
    joined = every.join(table, every["source"].eqNullSafe(F.col("t_source")))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("chosen").cast("int")).otherwise(0).cast("int")
    return joined.select("id", "source", "size", "n_chars", "source_size", "target", "epochs", times.alias("times")).withColumn("taken", F.col("size") * F.col("times"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", labels: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``docs`` as mixed: every row as often as the mix takes it.

    Rows of equal id, source, words and letters are told apart by their turn.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = free(docs, "mix_size", "mix_chars", "mix_turn", "mix_times", "mix_copy")
    size, chars, turn, times, copy = names
    counted = docs.select("*", F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias(size), F.length(text).alias(chars))
    counted = counted.withColumn(turn, F.row_number().over(W.partitionBy(id_col, source_col, size, chars).orderBy(F.xxhash64(*docs.columns))))
    chosen = plan(docs, id_col, text_col, source_col, labels, weights, most).where("times > 0")
    chosen = chosen.withColumn("turn", F.row_number().over(W.partitionBy("id", "source", "size", "n_chars").orderBy(F.desc("times"))))
    left, right = counted.alias("rows"), chosen.alias("mix")
    pairs = [(id_col, "id"), (source_col, "source"), (size, "size"), (chars, "n_chars"), (turn, "turn")]
    on = F.lit(True)
    for a, b in pairs:
        on = on & F.col(f"rows.`{a}`").eqNullSafe(F.col(f"mix.{b}"))
    met = left.join(right, on).select(*[F.col(f"rows.`{c}`") for c in docs.columns], F.col("mix.times").alias(times))
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(times)))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it; quality weights are learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    mix = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=labels)
    return mix.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))


def _fill_sql(fills: int = FILLS) -> str:
    """The fills one after another: (f0 to f_n) rows still open, with whether they are chosen."""
    parts = ["o0 AS (SELECT rid, source, size, key, doc_id, n_chars, gap FROM p WHERE size > 0)"]
    for k in range(fills):
        parts.append(f"""c{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, n_chars, rid ROWS UNBOUNDED PRECEDING) <= gap AS chosen FROM o{k} WHERE size <= gap)""")
        parts.append(f"""u{k} AS (SELECT source, sum(size) AS used FROM c{k} WHERE chosen GROUP BY source)""")
        parts.append(f"""o{k + 1} AS (SELECT c.rid, c.source, c.size, c.key, c.doc_id, c.n_chars, c.gap - coalesce(u.used, 0) AS gap FROM c{k} c LEFT JOIN u{k} u ON c.source IS NOT DISTINCT FROM u.source WHERE NOT c.chosen)""")
    parts.append("ch AS (" + " UNION ALL ".join(f"SELECT rid FROM c{k} WHERE chosen" for k in range(fills)) + ")")
    return ",\n".join(parts)


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), r AS (
  SELECT rid, doc_id, source, len(regexp_extract_all(t, '[^ \t-\r]+')) AS size, length(t) AS n_chars,
         (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM d
), g AS (
  SELECT *, least(length(bin(size::BIGINT)), 20) * 16 + least(floor(n_chars / greatest(size, 1)), 15)::INT AS kind FROM r
), l AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT kind, (sum(q) + 1)::DOUBLE / (count(*) + 2) AS share FROM g JOIN l USING (doc_id) GROUP BY kind
), k AS (
  SELECT g.*, -ln(u) / coalesce(share, 0.5) AS key FROM g LEFT JOIN w USING (kind)
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM k GROUP BY source
), o AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN w * max(CASE WHEN ratio > level THEN level END) OVER () ELSE cap END AS target FROM o
), p AS (
  SELECT k.*, t.source_size, t.target, e.epochs, t.target - e.epochs * t.source_size AS gap
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  JOIN (SELECT source, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t) e ON k.source IS NOT DISTINCT FROM e.source
), """ + _fill_sql() + r"""
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * (epochs + CASE WHEN ch.rid IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN ch USING (rid)
"""
