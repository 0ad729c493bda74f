"""Near-duplicates of texts and vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from assize.llm import shingles, simhash, vectors

from .conftest import table


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, close):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if close(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(items))]


def test_fingerprints_and_classes(spark, docs, odd, odd_rows):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    assert [got[k][0] for k, _ in rows] == prints
    found = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), c in zip(rows, found):
        least[c] = min(least.get(c, k), k)
    assert [got[k][1] for k, _ in rows] == [least[c] for c in found]
    strange = {(r["id"], r["component_id"]) for r in simhash.components(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (6, 6), (7, 6)} <= strange
    assert simhash.components(odd).count() == len(odd_rows)


def test_dense_bucket_loses_no_link(spark):
    """Many fingerprints around one centre go through all three levels of the index."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 6)))) for _ in range(400)} | {centre ^ (k << 20) for k in range(300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=8).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3 for r in edges)
    place = {x: k for k, x in enumerate(signed)}
    pairs = {(place[r["a"]], place[r["b"]]) for r in edges} | {(place[r["b"]], place[r["a"]]) for r in edges}
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    linked = classes(list(range(len(prints))), lambda a, b: (a, b) in pairs)
    assert want == linked


def test_keep_one(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 8]
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Unlike texts under one id stay; a copy without an id takes no other text with it."""
    unlike = ["one plain text about rivers and the sea", "quite another story of seven old trains", "a third thing that nobody has said before"]
    rows = [(None, unlike[0]), (None, unlike[1]), (4, unlike[0]), (7, unlike[1]), (7, unlike[2]), (7, unlike[2]), (None, "a lone row that has no id of its own")]
    kept = sorted(((r["doc_id"] or 0), r["text"]) for r in simhash.keep_one(table(spark, rows)).collect())
    assert kept == sorted([(4, unlike[0]), (7, unlike[1]), (7, unlike[2]), (0, rows[-1][1])])


def test_five_word_copies(spark):
    """Classes are those of brute force, with small bands expanded and with all bands held to be large."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.sample(vocabulary, 120)
        for edits in (0, 1, 2, 3, 4, 5):
            text = list(base)
            for at in rng.sample(range(120), edits):
                text[at] = rng.choice(vocabulary)
            texts.append(" ".join(text))
    texts += ["same four words here", "Same four  words here", "", "   "]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    want = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    docs = table(spark, list(enumerate(texts)))
    for limit in (64, 2):
        roots = {r["row"]["id"]: r["root"] for r in shingles.classes(docs, limit=limit).collect()}
        assert classes(list(range(len(texts))), lambda a, b: roots[a] == roots[b]) == want
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(want)) and len(kept) < len(texts)


def test_large_bands_of_several_classes(spark, monkeypatch):
    """A cloud of copies edited more and less, two close families and a crowd that shares a passage: classes are those of brute force."""
    monkeypatch.setattr(shingles, "BLOCK", 100)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5000)]

    def edited(base, edits):
        text = list(base)
        for at in rng.sample(range(len(base)), edits):
            text[at] = rng.choice(vocabulary)
        return text

    base = rng.sample(vocabulary, 150)
    sibling = edited(base, 7)
    texts = [edited(base, rng.randrange(12)) for _ in range(250)] + [edited(sibling, rng.randrange(3)) for _ in range(100)]
    passage = rng.sample(vocabulary, 90)
    texts += [passage + rng.sample(vocabulary, 40) for _ in range(150)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    want = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    docs = table(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    roots = {r["row"]["id"]: r["root"] for r in shingles.classes(docs, limit=16).collect()}
    assert classes(list(range(len(texts))), lambda a, b: roots[a] == roots[b]) == want
    assert 150 < len(set(want)) < 400


def test_sketches_miss_few_pairs():
    """Pairs of similarity 0.8 share a band and pass the sketch, at every size of sets."""
    rng = np.random.default_rng(3)
    for size in (6, 40, 150, 1000):
        missed = 0
        for _ in range(300):
            drawn = rng.integers(0, 1 << 63, size * 2, np.uint64) * np.uint64(2)
            both = int(np.ceil(0.8 * size))
            half = both + (size - both) // 2
            keys, bits = shingles.sketch([np.sort(drawn[:half]), np.sort(np.concatenate([drawn[:both], drawn[half:size]]))])
            alike = shingles.BINS - np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum(dtype=int)
            missed += not ((keys[0] == keys[1]).any() and shingles._likely(0.8, alike))
        assert missed <= 3


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [base[k % 30] + rng.standard_normal(16) * 0.12 for k in range(150)]
    rows += [rows[0], rows[0] * 2.0, np.ones(16) * 1e300]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (1005, [1.0, float("inf")]), (1006, [1.0, 2.0]), (1007, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in data + odd], "vec_id long, embedding array<double>, label int, cid string")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    m = np.array([v for _, v in data])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    true = near.sum(axis=1) - 1
    found = np.array([got[k][0] for k, _ in data])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    assert got[1006] == (1, 1006) and got[1007] == (1, 1006)
    assert all(got[k] == (0, k) for k in range(1000, 1006))
    assert vectors.near_duplicates(df.where("false")).count() == 0


def brute_links(m, n):
    """(links, component) of unit rows, each standing for n vectors, by all cosines."""
    near = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    return near @ n + n - 1, classes(list(range(len(m))), lambda a, b: near[a, b])


def test_vector_blocks(spark):
    """Buckets above the limit, block by block, give the numbers that small buckets give, and those of brute force."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 16))
    vectors_ = [centres[k % 3] + rng.standard_normal(16) * (0.03, 0.1, 0.3)[k // 3 % 3] for k in range(300)]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors_)] + [(300, [float(x) for x in vectors_[0]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    classes_ = df.where("vec_id < 300").selectExpr("vec_id as cid", "1L as n", "size(embedding) as dim", "embedding as v").cache()
    results = []
    for limit, block in ((10_000, 4_096), (6, 16), (6, 4_096)):
        found = vectors.links(classes_, limit=limit, block=block).collect()
        gained = Counter()
        for r in found:
            gained[r["cid"]] += r["links"]
        results.append(sorted((k, n) for k, n in gained.items() if n))
    assert results[0] == results[1] == results[2]
    m = np.array(vectors_)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want, _ = brute_links(m, np.ones(300, int))
    got = dict(results[0])
    assert all(got.get(k, 0) <= want[k] for k in range(300)) and sum(got.values()) >= 0.95 * want.sum()


@pytest.mark.parametrize("cosine", [0.905, 0.92])
def test_recall_near_the_threshold(spark, cosine):
    """Of pairs just above the threshold, among unrelated vectors, nine in ten are found, by the registered query's operator."""
    rng = np.random.default_rng(int(cosine * 1000))
    base = rng.standard_normal((700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((700, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    other = cosine * base + np.sqrt(1 - cosine**2) * off
    data = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, other]).astype(np.float32))]
    found = {r["id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    m = np.array([v for _, v in data])
    want, _ = brute_links(m / np.linalg.norm(m, axis=1, keepdims=True), np.ones(len(m), int))
    got = np.array([found[k] for k in range(len(m))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_shape_follows_the_number_of_classes():
    near, far = vectors.collision(np.sqrt(0.2), 2.0), vectors.collision(np.sqrt(2), 2.0)
    for n in (0, 1, 1_000, 50_000, 10**9):
        tables, projections = vectors.shape(n)
        assert 1 - (1 - near**projections) ** tables >= 0.93 and n * far**projections <= 2 * vectors.OCCUPANCY
    assert vectors.shape(50_000) == (33, 13)


def test_registered_vectors(spark, folder):
    """The registered query on the given table against all cosines."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = {r["vec_id"]: r for r in vectors.op3_vectors(spark, folder).collect()}
    m = np.array([r["embedding"] for r in rows], float)
    want, root = brute_links(m / np.linalg.norm(m, axis=1, keepdims=True), np.ones(len(m), int))
    assert len(got) == len(rows) and sum(r["n_links"] for r in got.values()) >= 0.9 * want.sum()
    assert all(got[r["vec_id"]]["n_links"] <= n for r, n in zip(rows, want))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_extra_columns(spark):
    assert simhash.components(table(spark, [(1, "a b c d"), (2, "a b c d")])).columns == ["id", "fp", "component_id"]


def test_fingerprints_make_candidates(spark):
    """Where no band meets, sets whose SimHash fingerprints differ in at most three bits are candidates, and are verified."""
    words = [f"w{k}" for k in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words[:-1]), 3: " ".join(words[1:]), 4: " ".join(words[::-1]), 5: "", 6: None, 7: " ".join(words[:200])}
    prints = {k: simhash.of_hashes(shingles.shingles(t)) for k, t in texts.items()}
    assert all((prints[1] ^ prints[k]).bit_count() <= 3 for k in (2, 3))
    rows = simhash.named(table(spark, list(texts.items())))
    found = shingles.cut(shingles.sketches(rows)).withColumn("bands", shingles.F.array(shingles.F.xxhash64("node")))
    edges = {(r["a"], r["b"]) for r in shingles.links(rows, found).collect()}
    node = {k: shingles._node(shingles.shingles(t)) for k, t in texts.items()}
    joined = classes([node[k] for k in texts], lambda a, b: (min(a, b), max(a, b)) in edges or a == b)
    groups = dict(zip(texts, joined))
    assert groups[1] == groups[2] == groups[3] and groups[5] == groups[6]
    assert len({groups[k] for k in (1, 4, 5, 7)}) == 4
