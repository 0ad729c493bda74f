"""Routes, as-of values, intervals, sketches and reconciliation on cases that the tables do not hold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from assize.operators import curation, intervals, reconcile, risk, routes, sequence, sessions, sketches

D = datetime.date


def test_truncated_seeds_are_not_expanded(spark):
    bridges = spark.createDataFrame([("s", 1, "x"), ("s", 1, "x"), ("s", 2, "y"), ("t", 5, "x"), ("u", 9, "x")], "seed string, bridge int, basis string")
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "g"), (5, "h"), (6, "h")], "company int, group string")
    holders = spark.createDataFrame([(1, "a"), (3, "b"), (4, "b"), (2, "b"), (6, "c"), (9, "d")], "company int, entity string")
    found = lambda limit: {(r.seed, r.bridge, r.basis, r.entity, r.degree, r.via, r.truncated) for r in routes.sanction_routes(bridges, groups, holders, limit).collect()}
    whole = {("s", 1, "x", "a", 2, 1, False), ("s", 2, "y", "b", 2, 2, False), ("s", 1, "x", "b", 3, 3, False), ("t", 5, "x", "c", 3, 6, False), ("u", 9, "x", "d", 2, 9, False)}
    assert found(6) == whole
    # s meets 2 bridges and 4 companies; at 5 it is cut and its group is not followed
    assert found(5) == {(*r[:6], True) if r[0] == "s" else r for r in whole if r[:4] != ("s", 1, "x", "b")}


def test_cheapest_paths_drop_dominated_states(spark):
    edge = lambda k, a, b, cost, policy=routes.STRICT, cut=False: (f"e{k}", a, b, "kind", "deterministic", policy, cut, 1.0, cost)
    rows = [edge(1, "a", "b", 1.0), edge(2, "c", "b", 1.0), edge(3, "a", "c", 5.0), edge(4, "a", "c", 4.0, routes.BROAD), edge(5, "c", "d", 1.0, cut=True), edge(6, "c", "a", 2.0)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, kind string, strength string, policy string, truncated boolean, weight double, cost double")
    node = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    got = [(r.end, r["rank"], r.cost, r.hops, r.path, r.truncated) for r in routes.cheapest_paths(edges, node("a"), node("c", "d")).orderBy("end", "rank").collect()]
    assert got == [("c", 1, 2.0, 1, "a > c", False), ("d", 1, 3.0, 2, "a > c > d", True)]
    assert [r.end for r in routes.cheapest_paths(edges, node("a"), node("c", "d"), policy=routes.STRICT).collect()] == ["c"]
    assert routes.cheapest_paths(edges, node("zz"), node("c")).count() == 0


def test_as_of_over_slices(spark):
    rng = random.Random(3)
    days = [D(2000, 1, 1) + datetime.timedelta(rng.randrange(4000)) for _ in range(300)]
    left = [(k, rng.choice(["a", "b", None]), rng.choice([*days[:150], None])) for k in range(200)]
    right = [(k, rng.choice(["a", "b"]), d, rng.choice(["x", "y", None])) for k, d in enumerate(days[100:140])] + [(99, "a", None, "z")]
    rows, known = spark.createDataFrame(left, "id int, key string, d date"), spark.createDataFrame(right, "n int, key string, e date, v string")
    want = {}
    for k, key, d in left:
        best = max(((e, n, v) for n, c, e, v in right if c == key and d and e and e <= d), key=lambda x: x[:2], default=None)
        want[k] = best and best[2]
    for size in (10_000, 365, 7):
        got = {r.id: r.v for r in sessions.as_of(rows, known, ["key"], "d", "e", ["n"], ["v"], size).collect()}
        assert got == want


def test_islands_and_events(spark):
    rows = [("k", D(2020, 1, 1), D(2020, 1, 5)), ("k", D(2020, 1, 6), D(2020, 1, 9)), ("k", D(2020, 2, 1), None), ("k", D(2020, 3, 1), D(2020, 1, 1)), ("m", None, D(2019, 1, 1)), ("m", D(2019, 1, 3), D(2019, 1, 4))]
    spans = intervals.islands(spark.createDataFrame(rows, "k string, a date, b date"), ["k"], "a", "b")
    assert sorted((r.k, r.island, r.start, r.end, r.paths) for r in spans.collect()) == [("k", 1, D(2020, 1, 1), D(2020, 1, 9), 2), ("k", 2, D(2020, 2, 1), None, 1), ("m", 1, None, D(2019, 1, 1), 1), ("m", 2, D(2019, 1, 3), D(2019, 1, 4), 1)]
    events = spark.createDataFrame([("k", D(2019, 1, 1), 1), ("k", D(2020, 1, 9), 0), ("k", D(2020, 5, 1), None), ("k", None, 1)], "k string, d date, v int")
    got = {(r.k, r.island): (r.n_before, r.n_within, r.n_after, r.rate_within) for r in intervals.around_intervals(spans, events, ["k"], "d", "v").collect()}
    assert got == {("k", 1): (1, 1, 1, 0.0), ("k", 2): (2, 1, 0, None), ("m", 1): (0, 0, 0, None), ("m", 2): (0, 0, 0, None)}


def test_sketches_err_by_a_hundredth(spark):
    rng = random.Random(5)
    values = [rng.lognormvariate(0, 3) * rng.choice((1, -1)) for _ in range(3000)] + [0.0] * 50
    df = spark.createDataFrame([("g", k % 7, v) for k, v in enumerate(values)], "g string, y int, v double")
    got = sketches.percentiles(sketches.merged(sketches.sketch(df, ["g", "y"], "v"), ["g"]), ["g"], [0.01, 0.25, 0.5, 0.9, 1.0]).first()
    ordered = sorted(values)
    for p, name in ((0.01, "p1"), (0.25, "p25"), (0.5, "p50"), (0.9, "p90"), (1.0, "p100")):
        exact = ordered[int(p * (len(values) - 1))]
        assert abs(got[name] - exact) <= 0.0101 * abs(exact) + 1e-6


def test_reconciled_within_a_case(spark):
    names = spark.createDataFrame([(1, "party", "a", "Ana Lima"), (1, "party", "b", "Ana Lima"), (1, "counsel", "c", "José da Silva"), (2, "party", "d", "Jose da Silva"), (3, "party", "e", None)], "case int, kind string, entity string, name string")
    asked = spark.createDataFrame([(1, 1, "ANA LIMA"), (2, 1, "jose da silva"), (3, 2, "José da Sylva"), (4, 2, " "), (5, 3, "x"), (6, None, "Ana Lima")], "occurrence int, case int, hint string")
    got = {r.occurrence: (r.status, r.entity, r.strategy, r.candidates, r.note) for r in reconcile.reconciled(asked, names).collect()}
    assert got[1] == ("ambiguous", None, None, 2, "multiple_process_local_candidates") and got[2] == ("proposed", "c", "exact", 1, None)
    assert got[3][:3] == ("proposed", "d", "levenshtein") and got[4] == ("unresolved", None, None, 0, "missing_entity_name_hint")
    assert got[5][4] == got[6][4] == "no_process_local_match"


def test_rarity_falls_back_on_all_dimensions(spark):
    """A sharp dimension that is explained leaves the noise too; where all are explained nothing is dropped."""
    rows = [(k, "g", f"m{k % 2}", "rare" if k == 0 else "usual", "same") for k in range(20)]
    df = spark.createDataFrame(rows, "id int, g string, m string, a string, b string")
    score = lambda rule: {r.id: (r.dims_used, r.score, r.kind) for r in risk.rarity(df, "id", ["g"], "m", ["a", "b"], suppressed=rule).collect()}
    # the row's own member is left out of its baseline: nobody else is rare
    assert score({})[0] == (1, 1.0, "inconclusive")
    assert score({"a": F.col("id") == 0})[0] == (2, 0.5, "inconclusive")
    every = score({"a": F.lit(True), "b": F.lit(True)})
    assert len(every) == 20 and every[0] == (2, 0.5, "inconclusive") and every[3][0] == 2


def test_unknown_sides_are_sides(spark):
    links = spark.createDataFrame([("c1", None, "x"), ("c1", None, "y"), ("c1", "A", "z"), ("c2", "A", "x"), ("c2", "A", None)], "c string, s string, m string")
    assert {r.m: (r.cases, r.others) for r in curation.co_members(links, ["c", "s"], "m").collect()} == {"x": (2, 1), "y": (1, 1), "z": (1, 0)}


def test_neutral_outcomes_count_after_a_change(spark):
    rows = [(1, k, who, fav, "o") for k, (who, fav) in enumerate([("a", 0), ("b", 1), ("b", None), ("b", None), ("a", 0)])]
    got = sequence.after_change(spark.createDataFrame(rows, "c int, k int, m string, fav int, o string"), ["c"], ["k"], "m", "fav", "o").orderBy("from_seq").collect()
    assert [(r.new_member, r.n, r.rate, r.red_flag) for r in got] == [("b", 3, 1.0, False), ("a", 1, 0.0, False)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 4)] + [("a", None), ("b", 1.0)], "k string, v double")
    (row,) = sequence.percentiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0], least=2).collect()
    assert tuple(row) == ("a", 4, 1.0, 2.0, pytest.approx(3.4), 4.0)


def test_session_events_of_one_movement(spark):
    """Rows of one case, day, kind and movement: which stays does not hang on the order they are read in."""
    day = datetime.date(2020, 1, 2)
    rows = [(1, 11, day, "Pedido de vista", m) for m in ("B", None, "A", "", "C")] + [(1, 12, None, f"Julgado em sessão da {t} Turma", "D") for t in ("Segunda", "Primeira")]
    movements = "case long, movement long, date date, description string, member string"
    virtual, decided = spark.createDataFrame([], "case long, entry long, date date, member string"), spark.createDataFrame([(1, 1, day, "Z")], "case long, decision long, date date, member string")
    for listed in (rows, rows[::-1], sorted(rows, key=lambda r: str(r[4]))):
        got = sessions.session_events(spark.createDataFrame(listed, movements).coalesce(1), virtual, decided)
        assert sorted((r.movement, r.session or "", r.event, r.member) for r in got.collect()) == [("11", "", "pedido_de_vista", "A"), ("12", "turma_1", "julgamento", "D")]
    numbered = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)][::-1], movements + ", place int")
    assert sorted(r.member for r in sessions.session_events(numbered, virtual, decided, ("place",)).collect()) == ["B", "D"]


def test_expansion_of_seeds_that_share_a_key(spark):
    from assize.operators import graph

    seeds = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, "z"), (6, None), (7, "b")]
    bridge, groups = [("a", 10), ("a", 11), ("b", 20)], [(10, 0), (11, 1), (12, 1), (20, 2), (21, 2), (22, 2), (23, 2)]
    members = [(10, "x"), (12, "y"), (20, "x"), (21, "z")]
    frame = spark.createDataFrame
    args = frame(seeds, "seed long, key string"), frame(bridge, "key string, unit long"), frame(groups, "unit long, `group` long"), frame(members, "unit long, entity string")
    got = {tuple(r) for r in graph.expand_with_breaker(*args, limit=4).collect()}
    one = {("x", 1, False), ("y", 2, False)}
    other = {("x", 1, False), ("z", 2, False)}
    assert got == {(s, *r) for s in (1, 2) for r in one} | {(s, *r) for s in (4, 7) for r in other} | {(3, "x", 1, True)}


def test_seeds_of_one_key_are_expanded_once(spark):
    import time

    from assize.operators import graph

    # 100,000 seeds of one key and 4,000 units: each seed by itself would make 400 million rows
    seeds = spark.range(100_000).select(F.col("id").alias("seed"), F.lit(1).alias("key"))
    units = spark.range(4_000)
    bridge = units.select(F.lit(1).alias("key"), F.col("id").alias("unit"))
    groups = units.select(F.col("id").alias("unit"), (F.col("id") % 7).alias("group"))
    members = units.select(F.col("id").alias("unit"), (F.col("id") % 3).alias("entity"))
    start = time.perf_counter()
    assert graph.expand_with_breaker(seeds, bridge, groups, members).count() == 300_000
    assert time.perf_counter() - start < 60


def test_resampled_weights_are_those_of_the_digests():
    import hashlib

    from assize.operators import evaluation, resampling

    keys = [f"{k}:".encode() for k in [*range(0, 3000, 7), *(10**e for e in range(18))]] + [b"", "é:".encode(), *(b"x" * n for n in (52, 53, 54, 55, 56, 200))]
    found = resampling.weights(keys, 101)
    assert evaluation.drawn_counts is resampling.drawn_counts
    for turn in (1, 9, 10, 55, 99, 100, 101):
        u = [int(hashlib.md5(k + str(turn).encode()).hexdigest()[:12], 16) / 2**48 for k in keys]
        bars = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
        assert found[turn - 1].tolist() == [sum(x >= bar for bar in bars) for x in u]


def test_resampled_areas_of_many_rows(spark):
    import time

    from assize.operators import evaluation

    rows = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("k"), F.when(F.col("id") % 50 > 0, (F.col("id") % 11) / 10).alias("score"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3 == 0).cast("int")).alias("label"))
    start = time.perf_counter()
    area, low, high = evaluation.area_interval(rows, "score", "label", "k", turns=100).collect()[0]
    assert low < area < high and high - low < 0.02
    assert time.perf_counter() - start < 60


def test_reconciled_hints_meet_every_name_that_fits(spark):
    """Against every pair of a case, with short and long names, initials, doubled words and slips of the pen."""
    from assize.functions import text

    rng = random.Random(4)
    words = ["ANA", "LIMA", "B", "BRITO", "A", "COSTA", "DIAS", "J", "JOSE"]
    made = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 10, 11])))
    names = [(k % 3, "party", k, made()) for k in range(150)]

    def slip(name):
        letters, kind = list(name), rng.random()
        for _ in range(rng.choice([1, 2, 3])):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], [letters[at], "X"], ["Z"]])
            letters = letters or ["Q"]
        parts = name.split()
        rng.shuffle(parts)
        return "".join(letters) if kind < 0.5 else " ".join(parts[rng.choice([0, 1]) :] + rng.choice([[], ["NETO"]])) or "W"

    asked = [(k, k % 3, slip(rng.choice(names)[3])) for k in range(300)]
    found = reconcile.reconciled(spark.createDataFrame(asked, "occurrence int, case int, hint string"), spark.createDataFrame(names, "case int, kind string, entity int, name string")).collect()
    df = spark.createDataFrame([(o, e, h, n) for o, c, h in asked for d, _, e, n in names if c == d and h.strip()], "o int, e int, h string, n string")
    c, d, h, n = text.canonical_name(F.col("h")), text.canonical_name(F.col("n")), text.entity_name(F.col("h")), text.entity_name(F.col("n"))
    alike, edits = text.greedy_jaccard(text.tokens(F.col("h")), text.tokens(F.col("n"))), F.levenshtein(c, d)
    score = F.when(h == n, F.struct(F.lit(4), F.lit(1.0))).when(c == d, F.struct(F.lit(3), F.lit(1.0))).when(alike >= 0.8, F.struct(F.lit(2), alike)).when(edits <= 2, F.struct(F.lit(1), 1 / (1 + edits)))
    best = {}
    for r in df.select("o", "e", score.alias("s")).where("s is not null").collect():
        best.setdefault(r.o, {}).setdefault(tuple(r.s), set()).add(r.e)
    levels = {4: "exact", 3: "canonical_name", 2: "jaccard", 1: "levenshtein"}
    for r in found:
        top = max(best.get(r.occurrence, {(0, 0.0): set()}).items())
        assert r.candidates == len(top[1]), r
        if len(top[1]) == 1:
            assert (r.strategy, r.entity) == (levels[top[0][0]], *top[1])
    assert len(found) == 300 and {r.strategy for r in found} >= {"jaccard", "levenshtein"}


def test_cheapest_paths_share_searches(spark, monkeypatch):
    """Starts with one way out reach what each reaches by itself, a start that is an end too, and few states are made."""
    sizes = []
    monkeypatch.setattr(routes, "cut", lambda df, cut=routes.cut: [out := cut(df), sizes.append(out.count())][0])
    edge = lambda k, a, b, cost: (f"e{k}", a, b, f"k{k % 3}", "deterministic", routes.STRICT, k % 4 == 0, 1.0, cost)
    pairs = [(f"s{k:03}", "hub", 1.0) for k in range(100)] + [("s000", "two", 0.5), ("two", "hub", 0.25)]
    pairs += [("hub", f"m{k}", 1.0 + k % 2) for k in range(40)] + [(f"m{k}", f"goal{k % 3}", 1.0) for k in range(0, 40, 4)] + [("hub", "goal0", 4.0), ("hub", "goal0", 4.0)]
    edges = spark.createDataFrame([edge(k, *p) for k, p in enumerate(pairs)], "edge_id string, src string, dst string, kind string, strength string, policy string, truncated boolean, weight double, cost double")
    node = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    starts, ends = [f"s{k:03}" for k in range(100)], ["goal0", "goal1", "goal2", "s005"]
    found = {tuple(r) for r in routes.cheapest_paths(edges, node(starts), node(ends)).collect()}
    assert sum(sizes) < 1_500
    near = {}
    for eid, a, b, kind, _, _, broken, _, cost in sorted((edge(k, *p) for k, p in enumerate(pairs)), key=lambda e: (e[8], e[0])):
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, (cost, kind, broken))
    want = set()
    for s in starts:
        known, frontier = {s: 0.0}, {s: (0.0, s, "", False)}
        told = {}
        for hop in range(1, 5):
            made = {}
            for n, (c, path, kinds, broken) in frontier.items():
                for m, (more, kind, also) in near.get(n, {}).items():
                    if c + more <= 6:
                        state = (c + more, f"{path} > {m}", f"{kinds},{kind}" if kinds else kind, broken or also)
                        made[m] = min(made.get(m, state), state)
            frontier = {m: v for m, v in made.items() if m not in known or v[0] < known[m]}
            known |= {m: v[0] for m, v in frontier.items()}
            for m in set(frontier) & set(ends):
                told.setdefault(m, []).append((frontier[m][0], hop, frontier[m][1], *frontier[m][2:]))
        for m, states in told.items():
            want |= {(s, m, rank, round(c, 6), hop, kinds, broken, path) for rank, (c, hop, path, kinds, broken) in enumerate(sorted(states), 1)}
    assert found == want
