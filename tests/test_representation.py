"""Representation and gates: nulls, ties, empty tables."""

import datetime

from assize.operators import audit, representation

DAY = datetime.date(2020, 1, 1)


def test_edges_without_member_or_events(spark):
    edges = spark.createDataFrame([("e1", 1, "A", "x"), ("e2", 1, "A", "y"), ("e3", 1, "A", None), ("e4", 1, "B", "x"), ("e5", 1, "A", "x")], "e string, c int, s string, m string")
    events = spark.createDataFrame([("e1", "brief", DAY), ("e1", "brief", None), ("e1", None, DAY), (None, "brief", DAY)], "e string, k string, d date")
    got = {r.e: r for r in representation.edge_activity(edges, events, "e", "c", "s", "m", "k", "d").collect()}
    assert {e: r.companions for e, r in got.items()} == {"e1": 1, "e2": 2, "e3": 3, "e4": 0, "e5": 1}
    assert (got["e1"].events, got["e1"].kinds, got["e1"].span_days) == (3, "brief=2", 0)
    assert (got["e2"].events, got["e2"].kinds, got["e2"].first_day) == (0, None, None)


def test_windows_of_events_without_member(spark):
    links = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, None), (2, "z")], "c int, m string")
    events = spark.createDataFrame([(1, "x", "pauta", DAY), (1, None, "pauta", None), (1, None, None, DAY), (9, None, "pauta", DAY)], "c int, m string, w string, d date")
    got = {(r.m, r.w): (r.events, r.cases, r.first_day) for r in representation.window_rollup(links, events, "m", "c", "w", "d").collect()}
    assert got == {("x", "pauta"): (2, 1, DAY), ("y", "pauta"): (1, 1, None)}
    assert representation.window_rollup(links, events.limit(0), "m", "c", "w", "d").count() == 0


def test_profiles_count_a_shared_case_once(spark):
    clients = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "b"), ("n", "c"), ("m", None)], "m string, k string")
    entries = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, None), ("c", 3, 0)], "k string, c int, f int")
    flagged = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    (row,) = representation.client_profiles(clients, entries, flagged, "m", "k", "c", "f", delta=-0.1, least=3).collect()
    assert (row.m, row.flagged, row.flagged_rate, row.overall_rate, row.stands_out) == ("m", 2, 1.0, 1.0, False)
    (row,) = representation.client_profiles(clients, entries, flagged, "m", "k", "c", "f", delta=-0.1, least=2).collect()
    assert row.stands_out


def test_matched_donors_without_sum_or_year(spark):
    gifts = spark.createDataFrame([("a", 2018, 10.0, "p"), ("a", None, 5.0, " "), ("b", 2014, 0.0, "p"), ("c", 2022, 1.0, None)], "k string, y int, v double, s string")
    matched = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    got = {r.k: (r.total, r.donations, r.years, r.recent, r.top_share_s) for r in representation.matched_donors(gifts, matched, "k", "y", "v", ["s"]).collect()}
    assert got == {"a": (15.0, 2, 1, True, 0.6667), "b": (0.0, 1, 1, False, None)}
    assert representation.matched_donors(gifts.limit(0), matched, "k", "y", "v", ["s"]).count() == 0


def test_gates_of_empty_tables_pass(spark):
    empty = spark.createDataFrame([], "g int, e int, n int")
    got = audit.audit_gates(empty.select("g", "n"), empty.select("g", "e"), empty.select("g", "e"), "g", "e", "n").collect()
    assert [(r.faults, r.status) for r in got] == [(0, "ok")] * 4


def test_first_source_names_a_node(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "key int, label string")
    got = audit.graph_nodes([("p", part((1, "b"), (1, "c"), (None, "x"))), ("p", part((1, "a"), (2, "d")))]).collect()
    assert sorted(r.label for r in got) == ["b", "d"]
