"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut before every run of spaces; no piece of the vocabulary crosses such a cut. Within a unit all
pieces form a lattice. The forward pass sums the weights of all ways to every place; going back from the
end, each piece is drawn in proportion to its share of the sum, so a segmentation is drawn in exact
proportion to its weight. The draws are a hash of the row key, so runs agree, whatever the partitions.

The vocabulary is a merge list, whose scores are ranks. A piece of rank r weighs 1 / (r + 100), as
frequencies fall with rank, to the power ``alpha``. A character outside the vocabulary is encoded as its
UTF-8 bytes. Decoding joins the pieces and drops the space put before the text.

The lattice of a unit is made once a task and looked up after that; a bounded number is kept. All units of
a batch are sampled together, one piece of each at a time.

Defined results: a null text has null pieces and decodes to null; an empty text has the pieces of one
space; repeated rows with one key have the same pieces; an empty table gives an empty table; extra columns
are ignored by ``encode`` and kept by ``with_pieces``, but for those of its own names. Texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.llm.memory import give_back, returning
from assize.llm.names import free

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.3
SHIFT = 100.0
#: Nodes of lattices kept at most; characters sampled at once; characters of new units learned at once. They bound a worker's memory and change no result.
KEPT_NODES, CHARS, LEARNED = 1_500_000, 250_000, 50_000
#: The log weight of a character spelled in bytes.
UNKNOWN = -10.0

_UNIT = re.compile(r" +[^ ]*")


class Vocabulary:
    """Pieces and their log weights; a space stands for the space sign of the model."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.text: list[str | None] = [None] * sp.get_piece_size()
        self.id: dict[str, int] = {}
        self.weight: dict[str, tuple[int, float]] = {}
        for k in plain:
            piece = sp.id_to_piece(k).replace("▁", " ")
            if re.search(r"[^ ] ", piece):
                raise ValueError(f"a piece crosses a cut: {piece!r}")
            self.text[k] = piece
            self.id[piece] = k
            self.weight[piece] = (k, -alpha * log(-sp.get_score(k) + SHIFT))
        self.bytes = {int(sp.id_to_piece(k)[3:5], 16): k for k in range(sp.get_piece_size()) if sp.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.raw = [bytes((self.byte_of[k],)) if k in self.byte_of else (piece or "").encode() for k, piece in enumerate(self.text)]
        self.longest = max(map(len, self.weight))

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the space put before it."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Trie:
    """The pieces as a trie whose steps are looked up for many places at once."""

    def __init__(self, pieces: dict[str, int]):
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, number in pieces.items():
            state = 0
            for c in piece:
                key = (state << 21) | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = number
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def matches(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (first place, last place, piece) in ``codes``; what begins at a place ends before ``stop`` of it."""
        start, state, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        at = start
        while len(at):
            key = (state << 21) | codes[at]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[found] == key
            start, at, state = start[fits], at[fits], self.next[found[fits]]
            piece = self.ends[state]
            whole = piece >= 0
            out.append((start[whole], at[whole], piece[whole]))
            at = at + 1
            more = at < stop[start]
            start, at, state = start[more], at[more], state[more]
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


class Sampler:
    """Samples the units of many rows at once; keeps the lattices of units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = Trie(vocabulary.id)
        self.weight = np.zeros(len(vocabulary.text))
        for number, weight in vocabulary.weight.values():
            self.weight[number] = weight
        self.clear()

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(1 << 16, np.int32)  # the first edge of every node
        self.bound = np.zeros(1 << 16)  # for every edge the shares of its node up to it
        self.source = np.zeros(1 << 16, np.int32)  # the node it comes from; -1 at a unit's start
        self.piece = np.zeros(1 << 16, np.int32)  # its piece, or -1 - (where its bytes are listed)
        self.spelled: list[tuple[int, ...]] = []
        self.spelling: dict[int, int] = {}

    def _spell(self, code: int) -> int:
        """The piece of a character's bytes, or where they are listed."""
        if (found := self.spelling.get(code)) is None:
            ids = tuple(self.vocabulary.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass"))
            if len(ids) > 1:
                self.spelled.append(ids)
            found = self.spelling[code] = ids[0] if len(ids) == 1 else -len(self.spelled)
        return found

    def learn(self, units: list[str]) -> None:
        """The forward pass over new units, a character of each at a time."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes)
        begin = np.repeat(ends - sizes, sizes)
        start, last, piece = self.trie.matches(codes, np.repeat(ends, sizes))
        weight = self.weight[piece]
        single = np.zeros(len(codes), bool)
        single[start[start == last]] = True
        odd = np.nonzero(~single)[0]
        if len(odd):
            spelled = [self._spell(c) for c in codes[odd].tolist()]
            start, last = np.concatenate([start, odd]), np.concatenate([last, odd])
            piece, weight = np.concatenate([piece, spelled]), np.concatenate([weight, np.full(len(odd), UNKNOWN)])
        # edges by the place in the unit where they end, then by that place overall
        depth = last - begin[last]
        order = np.argsort(depth * len(codes) + last, kind="stable")
        start, last, piece, weight, depth = start[order], last[order], piece[order], weight[order], depth[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        before = np.where(start == begin[start], len(codes), start - 1)
        sums = np.zeros(len(codes) + 1)
        share = np.zeros(len(start))
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1]
            value, node = sums[before[a:b]] + weight[a:b], last[a:b]
            heads = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1])
            runs = np.diff(np.concatenate([heads, [b - a]]))
            top = np.maximum.reduceat(value, heads)
            grown = np.exp(value - np.repeat(top, runs))
            total = np.add.reduceat(grown, heads)
            share[a:b] = grown / np.repeat(total, runs)
            sums[node[heads]] = top + np.log(total)
        order = np.argsort(last, kind="stable")
        last, share = last[order], share[order]
        heads = np.concatenate([[0], np.nonzero(last[1:] != last[:-1])[0] + 1])
        runs = np.diff(np.concatenate([heads, [len(last)]]))
        up_to = np.cumsum(share)
        up_to -= np.repeat(up_to[heads] - share[heads], runs)
        up_to[heads + runs - 1] = 1.0
        source = np.where(before[order] == len(codes), -1, before[order] + self.nodes)
        stop = self.edges + len(last)
        for name, start, values in (("bound", self.edges, up_to), ("source", self.edges, source), ("piece", self.edges, piece[order]), ("first", self.nodes, heads + self.edges)):
            array = _grown(getattr(self, name), start + len(values))
            array[start : start + len(values)] = values
            setattr(self, name, array)
        self.end.update(zip(units, (ends - 1 + self.nodes).tolist()))
        self.edges, self.nodes = stop, self.nodes + len(codes)

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' pieces in one array, and the number of each row."""
        if self.nodes > KEPT_NODES:
            self.clear()
        split = [_UNIT.findall(" " + text) for text in texts]
        counts = [len(units) for units in split]
        every = list(chain.from_iterable(split))
        ends = list(map(self.end.get, every))
        if None in ends:
            new = list(dict.fromkeys(unit for unit, at in zip(every, ends) if at is None))
            for start, stop in _parts(map(len, new), LEARNED):
                self.learn(new[start:stop])
            ends = list(map(self.end.__getitem__, every))
        row = np.repeat(np.arange(len(texts)), counts)
        at = np.array(ends, np.int64)
        # draws are numbered by the unit within its row and the step within the unit
        unit_no = np.arange(len(at), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
        base = _mix(seeds[row] ^ _mix(unit_no))
        live, steps = np.arange(len(at)), []
        while len(live):
            u = (_mix(base[live] + np.uint64(len(steps) + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[at[live]]
            behind = np.nonzero(self.bound[edge] <= u)[0]
            while len(behind):  # the last share of a node is one, above any draw
                edge[behind] += 1
                behind = behind[self.bound[edge[behind]] <= u[behind]]
            steps.append((live, edge))
            at[live] = self.source[edge]
            live = live[at[live] >= 0]
        size = np.zeros(len(row), np.int64)
        for units, edge in steps:
            size[units] += 1
        place = np.cumsum(size) - 1
        out = np.zeros(int(size.sum()), np.int64)
        for step, (units, edge) in enumerate(steps):
            out[place[units] - step] = self.piece[edge]
        piece_row = np.repeat(row, size)
        spelled = np.nonzero(out < 0)[0]
        if len(spelled):
            lists = [self.spelled[-1 - k] for k in out[spelled].tolist()]
            times = np.ones(len(out), np.int64)
            times[spelled] = [len(x) for x in lists]
            start = np.cumsum(times) - times
            out, piece_row = np.repeat(out, times), np.repeat(piece_row, times)
            for k, ids in zip(start[spelled].tolist(), lists):
                out[k : k + len(ids)] = ids
        return out, np.bincount(piece_row, minlength=len(texts))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def load(path: str = MODEL) -> bytes:
    """The model file, read by the driver; executors get its bytes."""
    with open(path, "rb") as file:
        return file.read()


def _parts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a list whose members have ``sizes``, each ended by the member that makes it ``most`` or more."""
    start = stop = held = 0
    for stop, size in enumerate(sizes, 1):
        held += size
        if held >= most:
            yield start, stop
            start, held = stop, 0
    if stop > start:
        yield start, stop


def with_pieces(rows: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: bytes | None = None, alpha: float = ALPHA) -> DataFrame:
    """``rows`` with ``piece_ids`` and ``lossless``, whether they decode to the very text; seeds are hashes of the key.

    If the table has columns of these names, the new ones have underscores at the end of theirs.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model or load())
    ids_name, same_name, seed_name = free(rows, "piece_ids", "lossless", "piece_seed")
    seeded = rows.withColumn(seed_name, F.xxhash64(F.lit("pieces"), F.col(key_col).cast("string")))
    place = seeded.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType())), T.StructField(same_name, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shipped.value, alpha)
        sampler = Sampler(vocabulary)
        for batch in batches:
            texts = batch.column(place)
            seeds = np.asarray(batch.column(seed_name)).view(np.uint64)
            for start, stop in _parts(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), CHARS):
                some = texts.slice(start, stop - start).to_pylist()
                ids, sizes = sampler.sample([x or "" for x in some], seeds[start:stop])
                ends = np.cumsum(sizes)
                listed = ids.tolist()
                same = [None if x is None else vocabulary.decode(listed[b - n : b]) == x for x, b, n in zip(some, ends.tolist(), sizes.tolist())]
                missing = np.array([x is None for x in some])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                pieces = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)), mask=pa.array(missing))
                part = batch.slice(start, stop - start)
                columns = [part.column(k) for k, name in enumerate(part.schema.names) if name != seed_name]
                yield pa.RecordBatch.from_arrays([*columns, pieces, pa.array(same, pa.bool_())], names=schema.names)
                give_back()

    return seeded.mapInArrow(returning(run), schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None, alpha: float = ALPHA) -> DataFrame:
    """(id, piece_ids) of every row."""
    pieces = with_pieces(docs.select(id_col, text_col), id_col, text_col, model, alpha)
    return pieces.select(F.col(id_col).alias("id"), "piece_ids")


def decode(rows: DataFrame, ids_col: str = "piece_ids", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """``rows`` with the text of their pieces in ``text_col``."""
    shipped = rows.sparkSession.sparkContext.broadcast(model or load())
    rows = rows.drop(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shipped.value)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its sampled pieces, their number, and whether they decode to the text; null texts have null pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_pieces(docs).select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")
