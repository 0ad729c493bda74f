"""Personal data, licenses and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from assize.llm import boosting, imatch, licenses, pii

from .conftest import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (k % 2 + 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


TRICKY = [
    (20, "é a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04 +1 (2) 345-6789 +12 3456789012 4111 1111-1111 1111 x@y z@q.w."),
    (21, "+123456789 +1234567890123456 7@7.7 a.@-.- 4111111111111111@x.y"), (22, "9" * 5000 + " " + "a" * 5000 + "@"), (23, ("1.2.3.4 " * 300) + ("a@b.cc " * 300)),
]


def test_base_spans(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + TRICKY
    found = pii.decided(table(spark, rows), ["doc_id"]).collect()
    got = Counter((r["doc_id"], tuple((s["start"], s["order"], s["stop"], s["kind"]) for s in r["spans"] if s["base"])) for r in found)
    assert got == Counter((k, tuple(brute_spans(t))) for k, t in rows)


def test_query_and_redaction(spark, folder, docs, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.op1_pii(spark, folder).collect():
        spans = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert {f"{s[3]}:{s[0]}:{s[2]}" for s in spans} <= set(r["spans"].split(","))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not brute_spans(r["text"])
        if not re.search("[0-9@]", texts[r["doc_id"]] or ""):
            assert re.sub(r"\[SECRET\]", "", r["text"] or "") == (texts[r["doc_id"]] or "") or "[SECRET]" in r["text"]
    strange = pii.redact(odd).collect()
    assert len(strange) == odd.count() and [r["text"] for r in strange if r["doc_id"] == 2] == [None]
    assert pii.redact(empty).count() == 0 and pii.decided(empty, ["doc_id"]).count() == 0


def test_boosting_follows_counts():
    counts = [((a, b), 10, 10 if a == 1 and b > 2 else 0) for a in range(3) for b in range(5)]
    model = boosting.fit(counts, ["a", "b"])
    assert model.probability({"a": 1, "b": 4}) > 0.9 > 0.1 > model.probability({"a": 2, "b": 4})
    held = boosting.cross_fitted([counts, counts], ["a", "b"])
    assert boosting.threshold([(p, n, ones) for _, p, n, ones in held], 0.9) <= model.probability({"a": 1, "b": 3})
    assert boosting.threshold([(0.9, 5, 5)], 0.9) == 1.1 and boosting.threshold([(0.9, 20, 20), (0.5, 10, 0)], 0.9) == 0.9
    # a model tried on rows it was not fitted to: what holds in one half only selects nothing
    assert boosting.threshold([(p, n, ones) for _, p, n, ones in boosting.cross_fitted([[((0,), 50, 50), ((1,), 50, 0)], [((0,), 50, 0), ((1,), 50, 50)]], ["a"])], 0.9) == 1.1


def plant(rng, k):
    """A text with personal data as people disguise it, or with look-alikes, and what of it is to be found beyond the base spans."""
    name, host = f"{rng.choice(['ana', 'bob', 'eva'])}{rng.randrange(99)}", f"{rng.choice(['mail', 'post', 'web'])}{rng.randrange(99)}"
    digits = [rng.randrange(10) for _ in range(15)]
    good = next(str(x) for x in range(10) if luhn("".join(map(str, digits)) + str(x)))
    bad = str((int(good) + 5) % 10)
    card = lambda last, sign: sign.join(("".join(map(str, digits)) + last)[j : j + 4] for j in range(0, 16, 4))
    return [
        (f"please write to {name}@{host}.org today", None), (f"please write to {name} [at] {host} [dot] org today", ("email", f"{name} [at] {host} [dot] org")),
        (f"his card {card(good, '/')} was used", ("card", card(good, "/"))), (f"serial {card(bad, '.')} is printed below", None),
        (f"this card {card(bad, '/')} was mistyped" if k % 40 == 0 else f"his card {card(good, '/')} again", ("card", card(bad if k % 40 == 0 else good, "/"))),
        (f"cell [at] {rng.randrange(99)} [dot] {rng.randrange(99)} of the table", None), (f"the host {rng.randrange(256)}[.]{rng.randrange(256)}[.]0[.]1 is down", "ip"),
    ]


def test_added_spans(spark):
    """Disguised addresses and cards are added, mistyped cards among them; look-alikes are not, though their features alone do not say so."""
    rng = random.Random(11)
    rows = [row for k in range(200) for row in plant(rng, k)]
    docs = table(spark, [(k, text) for k, (text, _) in enumerate(rows)])
    found = {r["doc_id"]: [(s["kind"], rows[r["doc_id"]][0][s["start"] : s["stop"]]) for s in r["spans"] if not s["base"]] for r in pii.decided(docs, ["doc_id"]).collect()}
    for k, (text, want) in enumerate(rows):
        kinds = [x for x in found[k] if x[0] != "phone"]
        assert (kinds == ([want] if want else [])) if want != "ip" else [x[0] for x in kinds] == ["ip"], (text, found[k])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == "please write to [EMAIL] today" and clean[3] == rows[3][0]


def test_many_spans_in_one_text(spark):
    """Thousands of spans and overlapping ones over many pieces of one text are replaced as a walk by hand does."""
    text = "é🎉 x" * 700 + " ".join(f"a{k}@b{k}.org 10.0.0.{k % 256} {'z' * (k % 50)}" for k in range(3000)) + " 4111111111111111@x.yy end" + "ß" * 2500
    rows = [(1, text), (2, "1.2.3.4"), (3, "a@b.cc" + "y" * 999), (4, "y " * 500 + "a@b.cc")]
    want = {}
    for k, t in rows:
        out, done = "", 0
        for start, _, stop, kind in brute_spans(t):
            out += f"{t[done:start]}[{kind.upper()}]" if start >= done else ""
            done = max(done, stop)
        want[k] = out + t[done:]
    assert {r["doc_id"]: r["text"] for r in pii.redact(table(spark, rows)).collect()} == want


def test_clashing_names_of_personal_data(spark, odd):
    for name in ("pii_id", "pii_hash", "pii_spans", "pii_text", "span", "reach", "digits", "fold", "rows", "found"):
        docs = odd.withColumn(name, F.lit("mine"))
        out = pii.redact(docs)
        assert out.columns == docs.columns
    assert out.count() == odd.count() and out.where("found = 'mine'").count() == odd.count()


def brute_places(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        hits = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, docs, odd_rows, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r[0], r[1]) for r in odd_rows]
    rows += [(900, "MIT License mit LICENSE; General\x00public license x"), (901, "a É apache license"), (902, "mit-license MITlicense mit licenses")]
    got = licenses.scan(table(spark, rows)).collect()
    assert Counter((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((k, *brute_places(t)) for k, t in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(empty).count() == 0


def brute_labels(text, k=licenses.K):
    """Method labels by hand: verified k-grams by diagonal, neighbours merged, spans of enough words, the largest of overlapping ones."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for label, texts in licenses.TEMPLATES.items():
        for t in map(licenses.template_words, texts):
            at = {}
            for q in range(len(t) - k + 1):
                at.setdefault(tuple(t[q : q + k]), []).append(q)
            by = {}
            for p in range(len(words) - k + 1):
                for q in at.get(tuple(words[p : p + k]), []):
                    by.setdefault(p - q, []).append((p, q))
            runs, before = [], None
            for d in sorted(by):
                if before is None or d - before > licenses.NEIGHBOURS:
                    runs.append([])
                runs[-1] += by[d]
                before = d
            for run in runs:
                covered = len({q + j for _, q in run for j in range(k)})
                first, last = min(p for p, _ in run), max(p for p, _ in run) + k - 1
                if (covered >= licenses.COVERED * len(t) or covered >= licenses.ENOUGH) and covered >= licenses.DENSE * (last - first + 1):
                    found.append((label, first, last, covered))
    return {a[0] for a in found if not any(b[0] != a[0] and b[3] > a[3] and b[1] <= a[2] and b[2] >= a[1] for b in found)}


def test_method_labels(spark, docs):
    """Labels of whole licenses, cut and changed ones among other words, and of the given documents, against a walk by hand."""
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for n, (label, texts) in enumerate(licenses.TEMPLATES.items()):
        for m, text in enumerate(texts):
            words = text.split()
            changed = [w if rng.random() > 0.05 else "other" for w in words if rng.random() > 0.03]
            rows += [(10_000 + 100 * n + 10 * m + j, f"some words before {x} and some after") for j, x in enumerate((text, " ".join(changed), " ".join(words[: len(words) // 2]), " ".join(sorted(words))))]
    got = {r["id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan(table(spark, rows)).collect()}
    for k, text in rows:
        base = set(filter(None, brute_places(text)[4].split(",")))
        assert got[k] == base | brute_labels(text), (k, text[:80])
    whole = {10_000 + 100 * n + 10 * m: label for n, (label, texts) in enumerate(licenses.TEMPLATES.items()) for m in range(len(texts))}
    assert all(label in got[k] for k, label in whole.items())
    assert got[10_000 + 100 * list(licenses.TEMPLATES).index("mit") + 10] == {"mit"}


def test_license_diagonals(spark):
    """A copy with a few words changed, put in and left out is still found, and a scrambled one is not."""
    words = licenses.template_words(licenses.TEMPLATES["bsd"][-1])
    changed = [*words[:8], "well", *words[8:14], *words[15:]]
    found = {r["id"]: r["labels"] for r in licenses.scan(table(spark, [(1, "x y z " + " ".join(changed) + " q"), (2, " ".join(sorted(words))), (3, " ".join(words[:6]))])).collect()}
    assert found == {1: "bsd", 2: "", 3: ""}


def test_imatch(spark, folder, odd, odd_rows, empty):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in imatch.op6_imatch(spark, folder).collect()}
    same = {}
    for k, r in enumerate(rows):
        text, following = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out = got[r["doc_id"]]
        assert out["n_chars"] == len(text) and out["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out["near_edited"] <= 1 and 0 <= out["near_next"] <= 1
        assert same.setdefault(text, out["fingerprint"]) == out["fingerprint"]
    assert sum(r["near_edited"] for r in got.values()) > 5 * sum(r["near_next"] for r in got.values())
    strange = imatch.fingerprint(odd).collect()
    assert len({r["fingerprint"] for r in strange if r["id"] in (2, 3, 4)}) == 1
    assert imatch.likened(odd).count() == len(odd_rows)
    assert imatch.likened(empty).count() == 0 and imatch.fingerprint(empty).count() == 0


def _long(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(*values, start=42):
    """Spark's xxhash64 of strings, longs and ints, one after another."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        start = xxhash.xxh64_intdigest(raw, start)
    return _long(start)


def brute_imatch(texts, low=imatch.LOW, high=imatch.HIGH):
    """(subset hashes, hash of all terms) of a text, by hand over all texts."""
    def split(t):
        return {x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x}

    distinct = set(texts)
    df = Counter(_hash(x) for t in distinct for x in split(t))
    lexicon = {t for t, n in df.items() if max(2.0, low * len(distinct)) <= n <= max(2.0, high * len(distinct))}

    def of(text):
        found = sorted({_hash(x) for x in split(text)} & lexicon)
        hashes = []
        for k in range(imatch.SUBSETS):
            inside = [t for t in found if _hash((t, 8), (k, 4)) % imatch.RATES[k % len(imatch.RATES)] == 0]
            hashes.append(_hash(*[(t, 8) for t in inside]) if inside else 0)
        return hashes, _hash(*sorted(split(text), key=lambda x: x.encode()))

    return of


def brute_likeness(a, b):
    used = [x == y for x, y in zip(a[0], b[0]) if x or y]
    return sum(used) / len(used) if used else float(a[1] == b[1])


def brute_digits(a):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in a[0]) if any(a[0]) else f"{a[1] & (2**64 - 1):016x}"


def test_fingerprints_and_likeness(spark, docs):
    """Every column against I-Match by hand: the given documents, string ids, null ids, repeated rows and ids."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    of = brute_imatch([t for _, t in rows])
    got = {r["id"]: r for r in imatch.likened(docs).collect()}
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        mine, other = of(text), of(text[: len(text) - len(text) // 2] + after[: len(text) // 2])
        assert (got[key]["fingerprint"], got[key]["edited_fingerprint"]) == (brute_digits(mine), brute_digits(other))
        assert abs(got[key]["near_edited"] - brute_likeness(mine, other)) < 1e-9 and abs(got[key]["near_next"] - brute_likeness(mine, of(after))) < 1e-9
    names = [(None, "first of all"), (None, "first of all"), ("k10", "same words"), ("k10", "same words"), ("k10", "same words"), ("k2", "ünï çödé 🎉 end"), ("k3", "")]
    df = spark.createDataFrame(names, "doc_id string, text string").repartition(3)
    seen = Counter((r["id"], r["n_chars"], r["edited_sha256"]) for r in imatch.likened(df).collect())
    want = Counter()
    for k, (key, text) in enumerate(names):
        half, after = len(text) // 2, names[(k + 1) % len(names)][1]
        want[key, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert seen == want


def test_copies_stay_in_the_band(spark):
    """A text whose copies are a third of all rows keeps its terms in the lexicon."""
    words = [f"t{k}" for k in range(200)]
    others = [" ".join(words[(7 * k + j) % 200] for j in range(10)) for k in range(60)]
    rows = list(enumerate([others[0]] * 30 + others))
    found = {r[0] for r in imatch.lexicon(table(spark, rows)).collect()}
    once = {r[0] for r in imatch.lexicon(table(spark, list(enumerate(others)))).collect()}
    hot = {r[0] for r in spark.createDataFrame([(w,) for w in others[0].split()], "w string").selectExpr("xxhash64(w)").collect()}
    assert found == once and hot <= found


def test_next_over_many_ranges(spark):
    rows = [(k * k, f"text {k}") for k in range(3000)]
    got = {r["key"]: r["next_key"] for r in imatch.successors(table(spark, rows).repartition(7)).collect()}
    keys = {r["id"]: r["key"] for r in table(spark, rows).select("doc_id", imatch._key(F.col("doc_id"), F.xxhash64("text")).alias("key")).withColumnRenamed("doc_id", "id").collect()}
    assert got == {keys[k * k]: keys[((k + 1) % 3000) ** 2] for k in range(3000)}
