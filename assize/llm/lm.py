"""Scores of whole texts under a language model that is trained here, and under the counts of its training texts.

Tokens are words in lower case and one end a text. Every task counts the words of its training texts before they are
shuffled. The model (``gru``) is a gated recurrent network: the most frequent words stand for themselves, in classes; rarer
words are classes by their number of bytes, and a word's share of its class is that of its count less ``DISCOUNT``; what
the discounts of a class leave is the share of words not seen, as one. So all counts of the corpus are part of the model,
whatever its size, and probabilities add up to one over the words seen and one unseen of each class.

It learns from every token of every training text, by truncated backpropagation that carries the state from a text's first
token to its last: trainers of ``TRAINER_ROWS`` texts each go on from the same weights for a share of their texts, their
weights are averaged by the tokens they learned from, and the next of ``ROUNDS`` rounds goes on from there, with other texts;
after all rounds each text was learned from once. Only weights, whose number is fixed, and the most frequent words reach the
driver.

Scoring carries the state from the first token of a text to its last; the texts of a task run side by side in lanes.
What counts of rarer words add is looked up by batch: a batch asks once for each of its distinct words.

Defined results: null, empty and blank texts are one end; repeated rows have a row each and count each; an empty table
gives an empty table; without training texts counts are zero; a null id is of no remainder, so it is learned from; extra
columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.llm import gru
from assize.session import cut, ensure_checkpoint_dir

#: Rounds of averaging; texts a trainer takes, on average; tasks whose weights are averaged at once.
ROUNDS, TRAINER_ROWS, FAN = 4, 8_000, 256
#: Words that a task counts before it hands them on; tokens scored and learned from side by side, at ``WORD_BYTES`` each; weights in a row of the averaging.
HELD, SLICE_TOKENS, TRAINED_TOKENS, CHUNK = 500_000, 2_000_000, 1_000_000, 1 << 14
WORD_BYTES = 5
END = b""
#: What is taken off the counts of rarer words for those not seen.
DISCOUNT = 0.75

_LONGS, _INTS, _WORDS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())


def _kind(word: bytes) -> int:
    return gru.HEAD + min(len(word), gru.KINDS) - 1


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all ``texts`` in lower case, A-Z alone, one text after another, and the number of words of each."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()))))
    words = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0)
    if pc.any(blank).as_py():  # a text without words splits into an empty one
        sizes[np.repeat(np.arange(len(sizes)), sizes)[blank.to_numpy(zero_copy_only=False)]] = 0
        words = words.filter(pc.invert(blank))
    return words.dictionary_encode(), sizes


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` of some ``most`` tokens at a time, each a copy: Arrow's kernels for ASCII go wrong on arrays with an offset."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // WORD_BYTES + 1)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
    return (texts.take(pa.array(np.arange(a, b))) for a, b in zip(cuts, cuts[1:]) if b > a)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (word, n) of a task's texts."""
    held, size = [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        merged = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
        held.clear()
        yield from merged.to_batches(50_000)

    for batch in batches:
        for texts in _slices(batch.column(0), SLICE_TOKENS):
            words, _ = _words(texts)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held.append(pa.table({"word": pa.concat_arrays([_binary(words.dictionary), pa.array([END], pa.binary())]), "n": pa.array(np.append(n, len(texts)), pa.int64())}))
            size += len(n)
            if size > HELD:
                yield from flushed()
                size = 0
    if held:
        yield from flushed()


def _binary(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_binary()).cast(pa.binary())


def _numbered(texts: pa.Array, ids: dict[bytes, int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Slices of some ``most`` tokens of ``texts`` as numbers of their tokens, one text after another, and the number of tokens of each: words in ``ids`` and after them the other words as they come, which are listed."""
    head = pa.array(list(ids), pa.binary())
    for some in _slices(texts, most):
        words, sizes = _words(some)
        listed = _binary(words.dictionary)
        number = pc.index_in(listed, head).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = number < 0
        number[rare] = len(ids) + np.arange(rare.sum())
        ends = np.cumsum(sizes + 1)
        out = np.full(ends[-1], ids[END], np.int32)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = number[words.indices.to_numpy()]
        yield out, sizes + 1, listed.filter(pa.array(rare))


def _kinds(ids: dict[bytes, int], rare: pa.Array) -> np.ndarray:
    """The model's tokens by number."""
    sizes = pc.binary_length(rare).to_numpy(zero_copy_only=False)
    return np.concatenate([np.arange(len(ids)), gru.HEAD + np.minimum(sizes, gru.KINDS) - 1]).astype(np.int32)


def _averaged(weights: DataFrame) -> np.ndarray:
    """The mean, by tokens, of weights (task, chunk, tokens, values); at most ``FAN`` rows of a chunk meet in a task at first."""

    def mean(group: pa.Table) -> pa.Table:
        n = group.column("tokens").to_numpy()
        values = group.column("values").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        total = n.sum()
        mixed = (values * (n / max(total, 1))[:, None]).sum(axis=0).astype(np.float32)
        return pa.table({"task": [group.column("task")[0].as_py() // FAN], "chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "tokens": [int(total)], "values": pa.array([mixed], pa.list_(pa.float32()))})

    schema = "task long, chunk int, tokens long, values array<float>"
    some = weights.groupBy((F.col("task") / FAN).cast("long").alias("_some"), "chunk").applyInArrow(mean, schema)
    rows = some.groupBy("chunk").applyInArrow(mean, schema).select("chunk", "values").orderBy("chunk").collect()
    return np.concatenate([np.array(r["values"], np.float32) for r in rows])


def train(texts: DataFrame, total: int, ids: dict[bytes, int], counts: np.ndarray, rounds: int = ROUNDS, trainer_rows: int = TRAINER_ROWS) -> gru.Weights:
    """The model of ``total`` rows (text), all of whose tokens are learned from once; ``counts`` are those of the head's and the kinds' tokens."""
    weights = gru.started(counts)
    if not total:
        return weights
    # a row's place in its file, so that rounds share no text and leave none out
    dealt = texts.withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(rounds)))
    trainers = max(1, min(texts.rdd.getNumPartitions(), total // trainer_rows))

    def learn(start: gru.Weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gru.one_thread()
            numbered = (x for batch in batches for x in _numbered(batch.column(0), ids, TRAINED_TOKENS))
            slices = (np.split(_kinds(ids, rare)[found], np.cumsum(sizes)[:-1]) for found, sizes, rare in numbered)
            found, seen = gru.trained(start, slices)
            if seen:
                values = gru.flat(found)
                parts = [values[k : k + CHUNK] for k in range(0, len(values), CHUNK)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float32()))], names=["task", "chunk", "tokens", "values"])

        return run

    for turn in range(rounds):
        found = dealt.where(F.col("turn") == turn).select("text").coalesce(trainers).mapInArrow(learn(weights), "task long, chunk int, tokens long, values array<float>")
        if values := _mean_or_none(found):
            weights = gru.shaped(values[0], weights)
    return weights


def _mean_or_none(found: DataFrame) -> tuple[np.ndarray] | None:
    kept = cut(found)
    return (_averaged(kept),) if kept.limit(1).count() else None


_PART = "batch long, ids array<long>, sizes array<long>, known array<long>, base array<double>, model array<double>, place array<int>, ends array<int>, words array<binary>"
_DOUBLES = pa.list_(pa.float64())
_PART_SCHEMA = pa.schema([("batch", pa.int64()), ("ids", _LONGS), ("sizes", _LONGS), ("known", _LONGS), ("base", _DOUBLES), ("model", _DOUBLES), ("place", _INTS), ("ends", _INTS), ("words", _WORDS)])


def _scores(weights: gru.Weights, ids: dict[bytes, int], head: np.ndarray, rest: np.ndarray):
    """Batches of (id, text): what the head and the classes say of every text, and the rarer words that it has.

    ``head`` are counts of the head, ``rest`` log10 of what a rarer word's count is divided by, by kind.
    """
    logs = np.concatenate([np.log10(head + 1.0), np.zeros(gru.KINDS)])
    known = np.concatenate([head > 0, np.zeros(gru.KINDS, bool)])
    shares = np.concatenate([np.zeros(gru.HEAD), rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru.one_thread()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            k = 0
            for found, sizes, rare in _numbered(batch.column(1), ids, SLICE_TOKENS):
                first, every = len(ids), _kinds(ids, rare)[found]
                starts = np.cumsum(sizes) - sizes
                ends = np.cumsum(np.add.reduceat((found >= first).astype(np.int32), starts), dtype=np.int32)
                model = gru.scored(weights, np.split(every, starts[1:])) / log(10)
                sums = [np.add.reduceat(x[every], starts) for x in (known.astype(np.int64), logs, shares)]
                listed = [(batch.column(0).slice(k, len(sizes)), _LONGS), (sizes, _LONGS), (sums[0], _LONGS), (sums[1], _DOUBLES), (model - sums[2], _DOUBLES), (found[found >= first] - first, _INTS), (ends, _INTS), (rare, _WORDS)]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, of.value_type)).cast(of) for x, of in listed]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], schema=_PART_SCHEMA)
                number, k = number + 1, k + len(sizes)

    return run


_SCORES = "id long, n_tokens long, n_known long, base double, model double"


def _summed(unseen: np.ndarray):
    """The texts of a batch; ``counts`` (pos, c, kind) are those of its rarer words, ``unseen`` what stands for c of one not seen, by kind."""

    def run(parts: pa.Table, counts: pa.Table) -> pa.Table:
        row = {c: parts.column(c)[0].values for c in parts.column_names if c != "batch"}
        c, kind = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        pos = counts.column("pos").to_numpy()
        c[pos], kind[pos] = counts.column("c").to_numpy(), counts.column("kind").to_numpy()
        place, ends = row["place"].to_numpy(), row["ends"].to_numpy()
        sums = []
        for each in ((c > 0).astype(np.int64), np.log10(c + 1.0), np.log10(np.where(c > 0, c - DISCOUNT, unseen[kind]))):
            running = np.concatenate([[0], np.cumsum(each[place])]) if len(place) else np.zeros(1, each.dtype)
            sums.append(np.diff(running[ends], prepend=0))
        known, base, model = (row[k].to_numpy() + s for k, s in zip(("known", "base", "model"), sums))
        return pa.table([row["ids"], row["sizes"], *map(pa.array, (known.astype(np.int64), base, model))], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, by counts and a model of the texts of ``learned``."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/lm-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    texts = learned.select(text)
    counts = cut(texts.mapInArrow(_gathered, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = [r["c"] for r in counts.where(F.col("word") == F.lit(END)).collect()]
    frequent = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(gru.HEAD - 1).collect()
    ids = {END: gru.END} | {bytes(r["word"]): k + 1 for k, r in enumerate(frequent)}
    head = np.zeros(gru.HEAD, np.int64)
    head[: len(ids)] = [*(ends or [0]), *(r["c"] for r in frequent)]
    kind = F.least(F.octet_length("word"), F.lit(gru.KINDS)).alias("kind")
    kinds = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy(kind).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    mass, types = (np.array([kinds.get(k + 1, (0, 0))[j] for k in range(gru.KINDS)], np.int64) for j in (0, 1))
    for r in frequent:
        mass[_kind(bytes(r["word"])) - gru.HEAD] -= r["c"]
        types[_kind(bytes(r["word"])) - gru.HEAD] -= 1
    weights = train(texts, sum(ends), ids, np.concatenate([head, mass]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text)
    rows.mapInArrow(_scores(weights, ids, head, np.log10(np.maximum(mass, 1))), _PART).write.parquet(folder)
    parts = spark.read.parquet(folder)
    asked = parts.select("batch", F.posexplode("words").alias("pos", "word"))
    found = asked.join(counts, "word", "left").select(F.col("batch").alias("of"), "pos", F.coalesce("c", F.lit(0)).alias("c"), (F.least(F.octet_length("word"), F.lit(gru.KINDS)) - 1).alias("kind"))
    summed = parts.drop("words").groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(_summed(np.where(mass > 0, DISCOUNT * types, 1.0)), _SCORES)
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    return summed.select("id", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("model").alias("score"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its log10 probability, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) % 7 == 2
    found = score(docs, docs.where(~held_out("doc_id")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
