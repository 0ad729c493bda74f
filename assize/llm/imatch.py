"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies within a band. Several random subsets of the
lexicon, of different sizes so that short and long texts meet one that suits them, are drawn by hashing;
for every subset a text's distinct terms in it are sorted and hashed. Two texts are alike by the share of
subsets, of those that hold a term of either, in which the hashes are equal.

Document frequency is counted over distinct texts, so copies do not move a text's terms out of the band.
A term is in at least ``low`` of these, so the lexicon has at most (mean distinct terms of a text) /
low entries, whatever the number of texts; its size is still checked before it is broadcast, and beyond
the check the terms are joined by shuffle.

Defined results: null texts count as empty; a text without terms in the lexicon has the hash of all its
terms as its fingerprint and is like a text of the same fingerprint only; repeated rows and equal texts
have equal fingerprints; rows of one id are put in order by their text's hash; ids may be of any type that
has an order, null ids come first; an empty table gives an empty table; extra columns are ignored.

The next document is found on ids alone, by ranges of them; of the texts only the part that a document
borrows moves to it. Rows of equal id and text are worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.session import cut

LOW, HIGH = 0.0005, 0.1
#: Subset k keeps one in RATES[k % len(RATES)] terms.
RATES = (8, 32, 128, 512)
SUBSETS = 32
#: Lexicon entries that are broadcast at most, of 16 bytes.
BROADCAST_LIMIT = 1_000_000
#: Copies of a row that are written at once.
COPIES = 1_000


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term_hash) of the terms in the band of document frequency, counted over all distinct texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    n = texts.select("text_hash").distinct().count()
    hashes = texts.dropDuplicates(["text_hash"]).select(F.explode(terms(F.col("text"))).alias("term")).select(F.xxhash64("term").alias("term_hash"))
    counts = hashes.groupBy("term_hash").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term_hash")


def _key(id_col: Column, text_hash: Column) -> Column:
    """One text for an id, null or not, and a text's hash."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), id_col.cast("string")), F.lit("n")), F.hex(text_hash))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, rows, n_chars, next_key, before_key, before_chars) of every distinct (id, text), in a circle by ascending id.

    Ids are sorted by ranges. A range's first and last rows, two a partition, go over the driver to its neighbours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("n_chars"))
    known = rows.groupBy("id", "text_hash").agg(F.count("*").alias("rows"), F.first("n_chars").alias("n_chars"))
    known = known.select(F.struct(F.col("id").isNotNull().alias("set"), F.col("id"), "text_hash").alias("at"), _key(F.col("id"), F.col("text_hash")).alias("key"), "rows", "n_chars")
    ranged = cut(known.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    me = F.struct("at", "key", "n_chars")
    ends = sorted((r["part"], r["first"]["key"], r["last"]["key"], r["last"]["n_chars"]) for r in ranged.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last")).collect())
    around = [(part, ends[(k + 1) % len(ends)][1], *ends[k - 1][2:]) for k, (part, *_) in enumerate(ends)]
    edges = docs.sparkSession.createDataFrame(around, "part int, first_after string, last_before string, last_chars int")
    order = W.partitionBy("part").orderBy("at")
    linked = ranged.withColumns({"next": F.lead("key").over(order), "before": F.lag(F.struct("key", "n_chars")).over(order)}).join(F.broadcast(edges), "part")
    before = F.coalesce("before", F.struct(F.col("last_before").alias("key"), F.col("last_chars").alias("n_chars")))
    return linked.select("key", F.col("at.id").alias("id"), "rows", "n_chars", F.coalesce("next", "first_after").alias("next_key"), before["key"].alias("before_key"), before["n_chars"].alias("before_chars"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, copies, n_chars, text, edited, next_key, same) of every distinct row.

    ``edited`` has its last half from the start of the next document. Of several equal rows all but the last have
    themselves as the next; these are a row of their own here, with ``same`` true. ``copies`` is how many rows it stands for.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    links = cut(successors(docs, id_col, text_col))
    # of the same columns wherever it is read, so the texts are shuffled once
    texts = docs.select(_key(F.col(id_col), F.xxhash64(text)).alias("key"), text.alias("text")).dropDuplicates(["key"]).join(links, "key")
    half = lambda n: F.floor(n / 2).cast("int")
    lent = texts.select(F.col("before_key").alias("to"), F.substring(F.col("text"), F.lit(1), half(F.col("before_chars"))).alias("borrowed"))
    met = texts.join(lent, F.col("key") == F.col("to"))
    own = F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half(F.col("n_chars")))
    version = lambda borrowed, same, copies: F.struct(F.concat(own, borrowed).alias("edited"), F.lit(same).alias("same"), copies.alias("copies"))
    itself = F.when(F.col("rows") > 1, version(F.substring(F.col("text"), F.lit(1), half(F.col("n_chars"))), True, F.col("rows") - 1))
    versions = F.array_compact(F.array(version(F.col("borrowed"), False, F.lit(1).cast("long")), itself))
    return met.select("key", "id", "n_chars", "text", "next_key", F.explode(versions).alias("v")).select("key", "id", "n_chars", "text", "next_key", "v.edited", "v.same", "v.copies")


def _hashes(found: Column, rates: tuple[int, ...], subsets: int) -> Column:
    """For every subset the hash of the sorted terms in it; zero if there are none."""

    def one(k: int) -> Column:
        inside = F.filter("sorted_terms", lambda t: F.pmod(F.xxhash64(t, F.lit(k)), F.lit(rates[k % len(rates)])) == 0)
        return inside

    listed = F.array(*[one(k) for k in range(subsets)])
    return F.transform(listed, lambda x: F.when(F.size(x) > 0, F.xxhash64(x)).otherwise(F.lit(0).cast("long")))


def _digits(hashes: Column, whole: Column) -> Column:
    """A fingerprint's text: eight hex digits a subset, or those of the hash of all terms."""
    parts = F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return F.when(F.exists(hashes, lambda h: h != 0), F.array_join(parts, "")).otherwise(F.lower(F.lpad(F.hex(whole), 16, "0")))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """The share of subsets with equal hashes, of those in which either text has a term."""
    used = F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), (x == y).cast("int")))
    used = F.array_compact(used)
    share = F.aggregate(used, F.lit(0), lambda s, x: s + x) / F.size(used)
    return F.when(F.size(used) > 0, share).otherwise((whole_a == whole_b).cast("double"))


def fingerprints(rows: DataFrame, texts: list[str], words: DataFrame, keys: list[str], rates: tuple[int, ...] = RATES, subsets: int = SUBSETS) -> DataFrame:
    """For every row of ``keys`` and every text column k: arrays ``hashes_k`` and ``whole_k``, the hash of all its terms.

    Terms are met with the lexicon ``words`` by an equality join. Columns other than the texts are kept.
    """
    kept = [c for c in rows.columns if c not in texts]
    split = rows.select(*kept, *[terms(F.col(t)).alias(f"terms_{k}") for k, t in enumerate(texts)])
    sized = split.select(*kept, *[F.xxhash64(F.array_sort(f"terms_{k}")).alias(f"whole_{k}") for k in range(len(texts))], F.array(*[F.size(f"terms_{k}") for k in range(len(texts))]).alias("sizes"), F.concat(*[f"terms_{k}" for k in range(len(texts))]).alias("every"))
    wholes = [f"whole_{k}" for k in range(len(texts))]
    each = sized.select(*kept, *wholes, "sizes", F.posexplode_outer("every").alias("at", "term"))
    side, bound = F.lit(len(texts) - 1), F.lit(0)
    for k in range(len(texts) - 1):
        bound = bound + F.get("sizes", F.lit(k))
        side = F.when((F.col("at") < bound) & (side == len(texts) - 1), k).otherwise(side)
    hashed = each.select(*kept, *wholes, side.alias("side"), F.xxhash64("term").alias("term_hash"))
    few = words.count() <= BROADCAST_LIMIT
    met = hashed.join(F.broadcast(words) if few else words, hashed["term_hash"] == words["term_hash"], "left")
    others = [c for c in kept + wholes if c not in keys]
    sets = [F.array_sort(F.collect_set(F.when(F.col("side") == k, words["term_hash"]))).alias(f"set_{k}") for k in range(len(texts))]
    out = met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others], *sets)
    for k in range(len(texts)):
        out = out.withColumn("sorted_terms", F.col(f"set_{k}")).withColumn(f"hashes_{k}", _hashes(F.col("sorted_terms"), rates, subsets)).drop("sorted_terms", f"set_{k}")
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(id, fingerprint) of the distinct rows of ``docs``."""
    words = cut(lexicon(docs, text_col, low, high))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    found = fingerprints(rows, ["t"], words, ["id", "text_hash"])
    return found.select("id", _digits(F.col("hashes_0"), F.col("whole_0")).alias("fingerprint"))


def likened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    words = cut(lexicon(docs, text_col, low, high))
    rows = edited(docs, id_col, text_col).withColumn("edited_sha256", F.sha2("edited", 256))
    found = cut(fingerprints(rows, ["text", "edited"], words, ["key", "same"]))
    after = found.where("not same").select(F.col("key").alias("next_key"), F.col("hashes_0").alias("next_hashes"), F.col("whole_0").alias("next_whole"))
    met = found.join(after, "next_key")
    near_next = F.when(F.col("same"), 1.0).otherwise(likeness(F.col("hashes_0"), F.col("next_hashes"), F.col("whole_0"), F.col("next_whole")))
    told = met.select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "copies",
        _digits(F.col("hashes_0"), F.col("whole_0")).alias("fingerprint"), _digits(F.col("hashes_1"), F.col("whole_1")).alias("edited_fingerprint"),
        likeness(F.col("hashes_0"), F.col("hashes_1"), F.col("whole_0"), F.col("whole_1")).alias("near_edited"), near_next.alias("near_next"),
    )
    left = F.col("copies") - (F.col("turn") - 1) * COPIES
    many = told.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("copies") / COPIES)))).withColumn("each", F.explode(F.array_repeat(F.lit(True), F.least(left, F.lit(COPIES)).cast("int"))))
    return many.drop("copies", "turn", "each")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint, that of its edited text, and their likenesses; null texts count as empty."""
    return likened(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
