"""Toxicity, quality and pieces: held-out accuracy, restored words, exact round trips."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assize.llm import pieces, quality, toxicity

from .conftest import table


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held), len(held)


@pytest.mark.parametrize("query,label,least", [(toxicity.op4_toxicity, "toxic", 0.93), (quality.op5_quality, "quality", 0.95)])
def test_held_out(spark, query, label, least):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    share, n = accuracy(rows, truth)
    assert n > 50 and share >= least


def test_restored(docs):
    restorer = toxicity.Restorer(toxicity.char_model(docs))
    assert [restorer.restore(x) for x in ("the", "été", "th3", "t.h.e", "t h e", "theee", "12345", "")] == ["the", "été", "the", "the", "the", "the", "12345", ""]
    assert list(toxicity.tokens("a i d i o t, x The!! $$$ ok###")) == ["a i d i o t x", "The", "ok"]


def exhaustive(token, model, breaks):
    """The cheapest form of a token by a walk over all paths of its lattice."""
    lattice, best = toxicity.edges(token, breaks), [np.inf, ""]

    def walk(k, state, cost, form):
        if cost > best[0]:
            return
        if k == len(token):
            total = cost + model.cost(state + "$")
            if total < best[0] - 1e-12:
                best[:] = [total, form]
            return
        for stop, letters, price in lattice[k]:
            total, last = cost + price, state
            if letters == toxicity.BREAK:
                walk(stop, "^^", total + model.cost(state + "$"), form + (letters if state != "^^" else ""))
                continue
            for x in letters:
                total, last = total + model.cost(last + x), last[1] + x
            walk(stop, last, total, form + letters)

    walk(0, "^^", 0.0, "")
    return best[1]


def test_viterbi_against_all_paths(monkeypatch):
    """The best path is that of an exhaustive search, however often decided stretches are let go; rare letters are one class."""
    model = toxicity.CharModel(toxicity.trigrams([("idiot", 50), ("the", 500), ("assess", 30), ("you", 200), (f"h{toxicity.RARE}ll", 80)]))
    rng = random.Random(1)
    for traced in (512, 3):
        monkeypatch.setattr(toxicity, "TRACED", traced)
        for _ in range(150):
            token = "".join(rng.choice("id1!0ot.- aas$$5he3ëж") for _ in range(rng.randrange(1, 9)))
            for breaks in (False, True):
                assert toxicity.viterbi(token, model, breaks) == exhaustive(token, model, breaks), token
    assert model.cost("hжl") == model.cost("hël") == model.cost(f"h{toxicity.RARE}l")


def test_long_tokens_are_one_lattice():
    """A token far beyond any block is decoded as one: words at every place come out whole."""
    model = toxicity.CharModel(toxicity.trigrams([("idiot", 500), ("the", 50), ("you", 50)]))
    for times in (1, 40, 3000):
        assert toxicity.viterbi(" ".join("id1ot" * times), model) == "idiot" * times
        assert toxicity.viterbi("-".join(["1d!ot"] * times), model, True).split(toxicity.BREAK) == ["idiot"] * times
    assert len(toxicity.viterbi("9" * 100_000 + "a", model)) == 2


def test_equal_texts_of_unlike_labels(spark):
    """Equal texts are one example, toxic if one of them is; order and number of rows change nothing."""
    rows = [(k, f"plain words number {k} here") for k in range(60)] + [(100 + k, "you are an idiot today") for k in range(10)]
    labels = [(k, 0) for k in range(60)] + [(100 + k, k % 2) for k in range(10)]
    docs = table(spark, rows + [(200 + k, f"an idiot said {k}") for k in range(5)])
    marks = spark.createDataFrame(labels + [(200 + k, 1) for k in range(5)], "id long, label int")
    chars = toxicity.char_model(docs)
    one, two = (toxicity.fit(d, marks, chars) for d in (docs, docs.repartition(5).orderBy(F.desc("doc_id"))))
    assert one.weights == two.weights and one.intercept == two.intercept and one.weights.get("=idiot", 0) > 0


def test_words_within_tokens(spark):
    """Every word of a token that joins several is a feature, and signs at edges may be letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    restorer = toxicity.Restorer(toxicity.char_model(docs.select("text").unionByName(docs.limit(1).selectExpr("repeat('you are an idiot and an ass ', 200) as text"))))
    for text in ("you-idiot", "the,idiot", "end.idiot", "so(idiot)", "you-!diot", "!diot", "|diot", "|d!ot!!", "! d i o t", "a i d i o t, x", "i d i o t"):
        assert "=idiot" in restorer.features(text), text
    found = {word for k in ("y o u i d i o t", "y.o.u-i.d.i.o.t") for word in restorer.broken(k)}
    assert {"idiot", "you"} <= found, found
    assert {"=idiot", "=you"} <= restorer.features("y.o.u-i.d.i.o.t")
    plain = toxicity.Restorer(toxicity.CharModel(toxicity.trigrams([("ass", 200), ("the", 500), ("an", 300)])))
    assert "=ass" in plain.features("a$$") and "=ass" in plain.features("a$$!")
    assert restorer.features("plain words, here.") == restorer.features("plain words here")


def test_odd_rows_are_scored(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 0), (8, 0), (None, 1), (3, None)], "id long, label int")
    chars = toxicity.char_model(odd)
    model = toxicity.fit(odd, labels, chars)
    scored = toxicity.scores(odd, model).collect()
    assert len(scored) == len(odd_rows) and len({r["score"] for r in scored if r["id"] in (2, 3, 4)}) == 1
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() <= len(odd_rows)
    bare = toxicity.fit(odd, labels.where("false"), toxicity.char_model(empty))
    assert all(r["score"] < 1e-9 for r in toxicity.scores(odd, bare).collect()) and toxicity.scores(empty, bare).count() == 0
    rules = quality.trained(odd, labels)
    stats = quality.described(odd, ["doc_id"]).select("doc_id", rules.column().alias("s")).collect()
    assert len(stats) == len(odd_rows) and all(0 < r["s"] < 1 for r in stats)
    assert quality.trained(empty, labels).rules == () and quality.described(empty, ["doc_id"]).count() == 0


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (600, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    model = quality.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [r[0] for r in df.select(model.column()).collect()]
    want = [1 / (1 + np.exp(-model.intercept - sum(w * quality._holds(rule, row[None])[0] for rule, w in model.rules))) for row in x[:50]]
    assert np.allclose(got, want) and np.mean((np.array(got) > 0.5) == (y[:50] > 0.5)) > 0.95


def test_round_trip(spark, odd, odd_rows, empty):
    rows = pieces.with_pieces(odd)
    found = rows.collect()
    assert all(r["lossless"] for r in found if r["text"] is not None)
    assert [(r["piece_ids"], r["lossless"]) for r in found if r["doc_id"] == 2] == [(None, None)]
    back = pieces.decode(pieces.with_pieces(odd), text_col="again").collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["again"]) for r in back)
    again = {r["doc_id"]: r["piece_ids"] for r in pieces.with_pieces(odd.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["piece_ids"] for r in found}
    assert pieces.with_pieces(empty).count() == 0


def test_samples_follow_weights():
    """Sampled segmentations of a word come as often as the product of their pieces' weights says."""
    vocabulary = pieces.Vocabulary(pieces.load())
    weights = {}

    def spell(rest, ids, weight):
        if not rest:
            weights[ids] = np.exp(weight)
        for k in range(1, len(rest) + 1):
            if rest[:k] in vocabulary.weight:
                spell(rest[k:], (*ids, vocabulary.weight[rest[:k]][0]), weight + vocabulary.weight[rest[:k]][1])

    spell(" ration", (), 0.0)
    ids, sizes = pieces.Sampler(vocabulary).sample(["ration"] * 20_000, np.arange(20_000, dtype=np.uint64))
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - n : e].tolist()) for e, n in zip(ends, sizes))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for key, weight in weights.items():
        share = weight / total
        assert abs(seen[key] / 20_000 - share) < 5 * np.sqrt(share * (1 - share) / 20_000) + 1e-4


def test_statistics_and_scores_by_hand(spark):
    """Statistics, rules and scores of texts against plain Python."""
    texts = ["", "One two two three.\nOne two two three.", "LOUD!!! <b>9 9</b>", "a b c d e f g", None]
    rows = quality.described(table(spark, list(enumerate(texts))), ["doc_id"]).collect()
    model = quality.RuleModel(-0.25, (((("upper", True, 0.1),), 1.5), ((("log_words", False, 1.2), ("digits", True, 0.05)), -2.0)))
    scores = {r["doc_id"]: r["score"] for r in quality.described(table(spark, list(enumerate(texts))), ["doc_id"]).select("doc_id", model.column().alias("score")).collect()}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        words, lines, n = text.split(), text.split("\n"), max(len(text), 1)
        want = {
            "log_words": math.log1p(len(words)), "chars_per_word": len(text) / max(len(words), 1), "distinct_words": len(set(words)) / max(len(words), 1),
            "repeated_words": sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), "upper": sum(c.isupper() for c in text) / n, "signs": sum(c in "#$%&*+/<=>@\\^_`|~" for c in text) / n,
            "shouts": sum(c in "!?" for c in text) / n, "stops": sum(c in ".,;:" for c in text) / n, "digits": sum(c in "0123456789" for c in text) / n, "distinct_lines": len(set(lines)) / len(lines), "words_per_line": len(words) / len(lines),
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (name, text)
        z = model.intercept + sum(w for rule, w in model.rules if all((want[c] > t) == above for c, above, t in rule))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)))


def test_one_row_a_label(spark):
    """However many rows have an id, one of them is learned from."""
    docs = table(spark, [(1, f"text number {k}") for k in range(500)] + [(2, "another"), (3, "another")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, label int")
    seen = []
    kept = quality.fit
    try:
        quality.fit = lambda x, y: seen.append((x.shape, sorted(y.tolist()))) or kept(x, y)
        quality.trained(docs, labels)
    finally:
        quality.fit = kept
    assert seen == [((3, len(quality.NAMES)), [0.0, 1.0, 1.0])]


def test_features_stay_where_they_lie(spark, capsys):
    """All names of all texts are not shuffled to meet the few that tell labels apart."""
    every = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("y", 0, "c")], "key string, label int, name string")
    strong = toxicity.cut(every.where("name <> 'b'").select("name"))
    held = toxicity._held(every, strong)
    assert {(r["key"], tuple(r["names"])) for r in held.collect()} == {("x", ("a",)), ("y", ("c",))}
    held.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_new_units_are_learned_in_bounded_parts(monkeypatch):
    """What a worker holds while it learns is bounded, and no bound changes a piece."""
    texts = [" ".join(f"unit{k}x{j}" for j in range(50)) for k in range(40)]
    seeds = np.arange(len(texts), dtype=np.uint64)
    vocabulary = pieces.Vocabulary(pieces.load())
    whole = pieces.Sampler(vocabulary).sample(texts, seeds)
    sizes, learn = [], pieces.Sampler.learn
    monkeypatch.setattr(pieces, "LEARNED", 1_000, raising=False)
    monkeypatch.setattr(pieces.Sampler, "learn", lambda self, units: (sizes.append(sum(map(len, units))), learn(self, units))[1])
    parts = pieces.Sampler(vocabulary).sample(texts, seeds)
    assert max(sizes) < 1_100 and len(sizes) > 10
    assert all((a == b).all() for a, b in zip(whole, parts))
