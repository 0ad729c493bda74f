"""Source divergence against Python's own integers, term by term."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from assize.llm import divergence

from .conftest import table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs=3, top=200):
    """Rows of (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[u] for u in kept) + len(kept)) for t in kept}
        p = share(counts[lang, source])
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        q = share(whole)
        pairs = []
        for other in {s for g, s in groups if g == lang} - {source}:
            r = share(counts[lang, other])
            pairs.append((other, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)))
        listed = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", listed, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark, docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert got(divergence.op13_divergence(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = Counter(con.sql(divergence.OP13_SQL).fetchall())
    assert got(divergence.op13_divergence(spark, folder)) == want


def test_ties_and_small_blocks(spark, monkeypatch):
    """Many blocks, early sums, groups without terms, a language without kept terms, ties beyond the limit."""
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "CELLS", 16)
    texts = [("a b c d e f g h É é", "x", "en"), ("a b c d, É é", "y", "en"), ("A-B-C-D e_f [g] h", None, "en"), ("...", "z", "en"), (None, "w", "en"), ("only here", "x", "de"), ("", None, None), ("日本 日本 ß", "x", None), ("日本 ß", "y", None), ("日本 ß", "y", None)]
    schema = "doc_id long, text string, lang string, source string, n long, term string"
    df = spark.createDataFrame([(k, t, g, s, 1, "x") for k, (t, s, g) in enumerate(texts)], schema)
    assert got(divergence.divergence(df, top=3, block_bytes=9)) == brute([(g, s, t) for t, s, g in texts], top=3)


def test_odd_tables(spark, odd, odd_rows, empty):
    rows = [("en", r[2] if len(r) > 2 else "a", r[1]) for r in odd_rows]
    assert got(divergence.divergence(odd)) == brute(rows)
    assert divergence.divergence(empty).count() == 0


def test_shares_are_exact():
    counts = np.array([[0, 7, 10**14, 3 * 10**14]])
    total = np.array([[10**15 + 1]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * (n + 1) // (10**15 + 1) for n in counts[0].tolist()]]
