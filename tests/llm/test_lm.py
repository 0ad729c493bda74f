"""The language model: gradients, whole probabilities, carried states; counts against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from assize.llm import gru, lm

from .conftest import table


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(1)
    found = gru.started(rng.integers(0, 50, gru.HEAD + gru.KINDS).astype(float))
    return {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in found.items()}


def test_probabilities_are_whole(weights):
    """Over all tokens of the head and all kinds they add up to one."""
    states = np.random.default_rng(2).normal(0, 1, (3, gru.HIDDEN))
    every = np.arange(gru.HEAD + gru.KINDS)
    for state in states:
        logs = gru.log_probabilities(weights, np.repeat(state[None], len(every), axis=0), every)
        assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-6)


def test_gradients(weights):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, gru.HEAD + gru.KINDS, (2, 5, 3))
    x[1, 0] = x[2, 0] = x[0, 1]
    y[4, 2] = -1
    keep = np.ones((5, 3))
    keep[0, 1] = keep[3, 2] = 0
    h = rng.normal(0, 1, (3, gru.HIDDEN))

    def loss(w):
        states = np.array(h)
        total = 0.0
        for t in range(5):
            states = gru.steps(w, x[t : t + 1], keep[t : t + 1], states)[0].astype(np.float64)
            real = y[t] >= 0
            total -= gru.log_probabilities(w, states[real], y[t][real]).sum()
        return total

    grown, rows, _, found = gru.gradients(weights, x, keep, y, h)
    sparse, grown["E"] = grown["E"], np.zeros_like(weights["E"])
    grown["E"][rows] = sparse
    assert found == pytest.approx(loss(weights), rel=1e-5)
    for name, g in grown.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += 1e-3
            up = loss(moved)
            moved[name][at] -= 2e-3
            assert (up - loss(moved)) / 2e-3 == pytest.approx(g[at], rel=0.02, abs=0.02)


def test_state_is_carried_to_the_end():
    """A text's score does not hang on windows, lanes or its neighbours."""
    rng = np.random.default_rng(4)
    w = gru.started(rng.integers(0, 50, gru.HEAD + gru.KINDS).astype(float))
    w["C"] += rng.normal(0, 0.3, w["C"].shape).astype(np.float32)
    sequences = [rng.integers(0, gru.HEAD + gru.KINDS, n).astype(np.int32) for n in (1, 700, 3, 64, 65, 1, 200)]
    together = gru.scored(w, sequences, width=3, window=16)
    for s, found in zip(sequences, together):
        assert gru.scored(w, [s], window=1000)[0] == pytest.approx(found, rel=1e-4)
    assert gru.scored(w, [sequences[1][:400]])[0] != pytest.approx(together[1], rel=0.01)


def brute(rows, learned):
    words = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in _split(t or "")] + [None]
    counts = Counter(w for t in learned for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for key, text in rows:
        found = words(text)
        out[key] = (len(found), sum(w in counts for w in found), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in found))
    return out


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_op12(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 5_000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    want = brute(rows, [t for k, t in rows if not held[k]])
    got = lm.op12_lm(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        size, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], size, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    # the model says more of unseen texts than their counts do
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_odd_tables(spark, odd, odd_rows, empty):
    found = lm.score(odd, odd).collect()
    want = brute([(k, t) for k, (_, t, *_) in enumerate(odd_rows)], [r[1] for r in odd_rows])
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found) == sorted((a, b, round(d, 4)) for a, b, _, d in want.values())
    assert lm.score(empty, empty).count() == 0
    unlearned = lm.score(odd, empty).collect()
    assert len(unlearned) == len(odd_rows) and all(r["base_score"] == 0 and r["n_known"] == 0 for r in unlearned)


def test_averages_by_tokens(spark):
    rows = [(task, chunk, 1 + task, [float(task), 2.0]) for task in range(600) for chunk in (0, 1)]
    mean = lm._averaged(spark.createDataFrame(rows, "task long, chunk int, tokens long, values array<float>"))
    expected = sum(t * (1 + t) for t in range(600)) / sum(1 + t for t in range(600))
    assert mean.tolist() == pytest.approx([expected, 2.0, expected, 2.0], rel=1e-5)


def test_learns_from_every_token(spark, monkeypatch):
    """A word's place within a long text does not matter: trainers meet every token of every text once, in order."""
    texts = [" ".join(f"w{(k * 7 + j) % 300}" for j in range(size)) for k, size in enumerate((1, 3, 60, 400, 2500, 90, 200, 33))] + ["", None]
    rows = table(spark, list(enumerate(texts, 1))).repartition(2)
    ids = {lm.END: gru.END} | {b"w%d" % k: k + 1 for k in range(300)}
    kept = lm.F.coalesce("text", lm.F.lit("")).alias("text")
    real = []
    monkeypatch.setattr(lm, "_mean_or_none", lambda found: real.append({(r["task"], r["tokens"]) for r in found.collect()}))
    monkeypatch.setattr(lm, "TRAINED_TOKENS", 500)
    lm.train(rows.select(kept), len(texts), ids, np.ones(gru.HEAD + gru.KINDS), rounds=3, trainer_rows=4)
    assert sum(n for found in real for _, n in found) == sum(len((t or "").split()) + 1 for t in texts)


def test_state_goes_on_while_learning():
    """What follows far into a text is learned with what came before it in other windows, and lanes beside a long text do not fill memory."""
    rng = np.random.default_rng(5)
    w = gru.started(rng.integers(1, 50, gru.HEAD + gru.KINDS).astype(float))
    sequences = [rng.integers(0, 40, n).astype(np.int32) for n in (3000, 5, 5, 5, 5, 5, 5, 5, 5)]
    found, seen = gru.trained(w, [sequences[:1], sequences[1:]])
    assert seen == sum(map(len, sequences))
    assert gru.scored(found, sequences[:1])[0] > gru.scored(w, sequences[:1])[0]
    met = []
    kept = gru.gradients
    try:
        gru.gradients = lambda weights, x, keep, y, h: (met.append((y.shape, bool(keep[0, 0]), float(np.abs(h).sum()))), kept(weights, x, keep, y, h))[1]
        gru.trained(w, [sequences])
    finally:
        gru.gradients = kept
    assert sum(shape[0] * shape[1] for shape, *_ in met) < 2 * seen
    assert not met[0][1] and all(going and state > 0 for _, going, state in met[1:])


def test_words_are_numbered_whole():
    """Slices of any texts, cut or with an offset, have the tokens that plain Python splits them into, and the same counts."""
    texts = ["", " \t", "One two\x0btwo\x1cthree ONE", "é É x \x00y\n", "a b c", *(f"w{k} W{k % 7} w1" for k in range(40))]
    ids = {lm.END: gru.END, b"one": 1, b"w1": 2}
    column = lm.pa.array(["left out", *texts], lm.pa.string()).slice(1)
    found = []
    for numbers, sizes, rare in lm._numbered(column, ids, 20):
        listed = [*ids, *rare.to_pylist()]
        assert len(set(listed)) == len(listed)
        found += [[listed[n] for n in part] for part in np.split(numbers, np.cumsum(sizes)[:-1])]
    assert found == [[*t.encode().lower().split(), lm.END] for t in texts]
    counts = Counter()
    for batch in lm._gathered(iter([lm.pa.RecordBatch.from_arrays([column], names=["text"])] * 2)):
        counts.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert counts == Counter(w for words in found * 2 for w in words)
