"""Resampling by digests: how often a row is drawn in a turn hangs on MD5 of its key and the turn, worked out for many rows at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64)]
_WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one block of MD5 holds beside its mark and length.
_BLOCK = 55
#: Digests worked out side by side.
_AT_ONCE = 16_384


def _bars() -> list[int]:
    """The numbers of 48 bits from which a row is drawn once, twice and so on up to 8 times: sums of Poisson of mean 1."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(1, 9):
        total += term
        term /= k
        out.append(math.ceil(total * (1 << 48)))  # a double scaled by a power of two is exact
    return out


BARS = _bars()


def digests(words: np.ndarray, length: int, suffixes: list[bytes]) -> np.ndarray:
    """The first 48 bits of MD5 of every key with every suffix behind it, a row a suffix.

    ``words`` (16, keys) are keys of ``length`` bytes, zero behind them; the suffixes are of equal length.
    """
    tail = np.zeros((len(suffixes), 64), np.uint8)
    size = length + len(suffixes[0])
    tail[:, length:size] = np.frombuffer(b"".join(suffixes), np.uint8).reshape(len(suffixes), -1)
    tail[:, size] = 0x80
    tail[:, 56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    fixed = tail.view("<u4")
    varied = {k: words[k] | fixed[:, k : k + 1] for k in range((size + 3) // 4)}
    shape = len(suffixes), words.shape[1]
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        g = _WORDS[k]
        if g in varied:
            np.add(a, varied[g], out=a)
            np.add(a, np.uint32(_ADDED[k]), out=a)
        else:
            np.add(a, np.uint32((_ADDED[k] + int(fixed[0, g])) & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(_SHIFTS[k]), out=t), np.right_shift(a, np.uint32(32 - _SHIFTS[k]), out=a)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    first, second = (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()
    return (first.astype(np.uint64) << np.uint64(16)) | (second >> np.uint32(16)).astype(np.uint64)


def weights(keys: list[bytes], turns: int) -> np.ndarray:
    """How often each key is drawn in each turn from 1: (turns, keys). Few keys of a length take several turns at a time."""
    out = np.zeros((turns, len(keys)), np.int8)
    for length, (rows, words) in pack(keys).items():
        by_size = [[t for t in range(1, turns + 1) if len(str(t)) == n] for n in range(1, len(str(turns)) + 1)]
        for same in by_size:
            step = max(1, _AT_ONCE // len(rows))
            for part in (same[k : k + step] for k in range(0, len(same), step)):
                suffixes = [str(t).encode() for t in part]
                if length + len(suffixes[0]) <= _BLOCK:
                    u = digests(words, length, suffixes)
                else:
                    u = np.array([[int(hashlib.md5(keys[r] + s).hexdigest()[:12], 16) for r in rows] for s in suffixes], np.uint64)
                drawn = np.zeros(u.shape, np.int8)
                for bar in BARS:
                    drawn += (u >= np.uint64(bar)).view(np.int8)
                out[part[0] - 1 : part[-1], rows] = drawn
    return out


def pack(keys: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys by length: their places, and their bytes as the 16 words of a block, a row a word."""
    lengths, out = np.array([len(k) for k in keys]), {}
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        block = np.zeros((len(rows), 64), np.uint8)
        if 0 < length <= _BLOCK:
            block[:, :length] = np.frombuffer(b"".join(keys[r] for r in rows), np.uint8).reshape(len(rows), length)
        out[int(length)] = rows, np.ascontiguousarray(block.view("<u4").T)
    return out


def drawn_counts(df: DataFrame, x: Column, is_pos: Column, key: Column, turns: int) -> DataFrame:
    """(turn, x, pos, neg): the weights of each turn's rows by value and side, counted where the rows lie; turn 0 takes each row once.

    A row's key and turn are written as text with a colon between them; a key that is null is left out, colon and all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [k.encode() for k in batch.column(2).to_pylist()]
            side = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            values, codes = np.unique(np.where(missing, 0.0, batch.column(0).fill_null(0.0).to_numpy(zero_copy_only=False)), return_inverse=True)
            cells, n = np.where(missing, len(values), codes) * 2 + side, 2 * len(values) + 2
            each = np.vstack([np.ones((1, len(keys)), np.int8), weights(keys, turns)])
            sums = np.stack([np.bincount(cells, w, n) for w in each]).astype(np.int64).reshape(turns + 1, -1, 2)
            turn, kept = np.nonzero(sums.sum(axis=2))
            told = pa.array(np.append(values, 0.0)[kept], pa.float64(), mask=kept == len(values))
            yield pa.RecordBatch.from_arrays([pa.array(turn.astype(np.int32)), told, pa.array(sums[turn, kept, 1]), pa.array(sums[turn, kept, 0])], ["turn", "x", "pos", "neg"])

    rows = df.select(x.cast("double").alias("x"), is_pos.alias("is_pos"), F.coalesce(F.concat(key.cast("string"), F.lit(":")), F.lit("")).alias("key"))
    parts = rows.mapInArrow(count, "turn int, x double, pos long, neg long")
    return parts.groupBy("turn", "x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
