"""Scalar functions and small operators against plain Python."""

from collections import deque

from pyspark.sql import functions as F

from assize.functions import dates, rules, stats, text
from assize.operators import graph, joins, match, sequence, skew
from assize.operators.components import connected_components
from assize.sources import files


def values(spark, rows, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.select("k", expression.alias("x")).orderBy("k").select("x").collect()]


def test_names(spark):
    rows = ["  José  da Silva ", "Ação & Cia S.A.", "ME LTDA", "", None, "Œuvre ñandú S/A"]
    assert values(spark, rows, text.entity_name(F.col("v")))[:2] == ["JOSE DA SILVA", "ACAO & CIA S.A."]
    assert values(spark, rows, text.canonical_name(F.col("v"))) == ["JOSE DA SILVA", "ACAO CIA", "ME LTDA", None, None, "ŒUVRE NANDU"]


def test_numbers(spark):
    rows = ["529.982.247-25", "529.982.247-24", "111.111.111-11", "11.222.333/0001-81", "11.222.333/0001-80", None]
    assert values(spark, rows, text.valid_person_id(F.col("v"))) == [True, False, False, False, False, False]
    assert values(spark, rows, text.valid_company_id(F.col("v"))) == [False, False, False, True, False, False]
    assert values(spark, ["12.345/sp", "1/XX", "x", "1234567/SP"], text.bar_number(F.col("v"))) == ["12345/SP", None, None, None]


def test_greedy_likeness(spark):
    rows = [("J SILVA", "JOSE SILVA", 1.0), ("A SILVA", "ANA SILVA", 1 / 3), ("X Y", "Z", 0.0), ("", "Z", 0.0), ("B B", "B", 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", text.greedy_jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("got")).collect():
        assert abs(r["want"] - r["got"]) < 1e-9


def test_lists_and_entries(spark):
    assert values(spark, ["Ana x Bia vs. ana"], text.party_names(F.col("v"))) == [["Ana", "Bia"]]
    found = values(spark, ["RECTE.(S): ANA ADV.(A/S): BIA"], text.role_entries(F.col("v")))[0]
    assert [(e["label"], e["content"]) for e in found] == [("RECTE.(S)", "ANA"), ("ADV.(A/S)", "BIA")]
    assert text.column_labels(["Data Decisão", "Data decisao"]) == ["data_decisao", "data_decisao_2"]


def test_rules(spark):
    rows = ["Provido", "JULGAMENTO - NEGADO PROVIMENTO", "Liminar deferida ad referendum", "", None, "Desprovido", "Não conhecido(s)"]
    assert values(spark, rows, rules.outcome(F.col("v"))) == ["favorable", "unfavorable", "favorable", None, None, "unfavorable", "unfavorable"]
    assert values(spark, rows, rules.materiality(F.col("v"))) == ["substantive", "substantive", "provisional", "unknown", "unknown", "substantive", "procedural"]
    kinds = values(spark, ["1", "#NULO", "Recursos próprios", "Serviço de gráfica", "zzz", None], rules.resource(F.col("v")))
    assert [(k["category"], k["subtype"]) for k in kinds] == [("payment_method", "check"), ("empty", "null_marker"), ("source_type", "own_resources"), ("in_kind", "professional_service"), ("unknown", "unclassified"), ("empty", "blank")]
    assert values(spark, ["Redistribuído por sorteio", "Trânsito em julgado", "x"], rules.movement_category(F.col("v"))) == ["deslocamento", "baixa", "outros"]


def test_dates_and_amounts(spark):
    got = values(spark, ["2020-02-29", "29/02/2021", "31/12/2020", "20201231", "x"], dates.any_date(F.col("v")).cast("string"))
    assert got == ["2020-02-29", None, "2020-12-31", "2020-12-31", None]
    assert values(spark, ["1.234,56", "7", "a"], dates.amount(F.col("v"))) == [1234.56, 7.0, None]
    assert values(spark, ["10h30", "9h", "25h", "x"], dates.clock(F.col("v"))) == ["10:30", "09:00", None, None]


def test_power(spark):
    row = spark.range(1).select(stats.proportion_power(F.lit(50), F.lit(0.4)).alias("p"), stats.erfc(F.lit(0.5)).alias("e")).first()
    assert abs(row["e"] - 0.4795001221869535) < 2e-7 and 0 < row["p"] < 1


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000), (None, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in root}


def test_hubs_learn_their_minimum_in_place(spark):
    """Both ends of the order may be hubs; keys above the bar are met through a broadcast."""
    edges = [(1, k) for k in range(2, 400)] + [(9999, k) for k in range(300, 900)] + [(20_000, 20_001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", hot_rows=50).collect()}
    assert got == {k: 1 for k in [*range(1, 900), 9999]} | {20_000: 20_000, 20_001: 20_000}
    rows = spark.createDataFrame([("a", k) for k in range(30)] + [("b", 1), ("c", 2)], "k string, x int")
    table = spark.createDataFrame([("a", 7), ("b", 8)], "k string, y int")
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for how, want in (("inner", 31), ("left", 32)):
        met = skew.meet(rows, table, "k", sizes, 32, how, 5)
        assert met.count() == want and met.where("k = 'a' and y = 7").count() == 30


def test_greedy_durations(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = [(k % 7, k, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60)), rng.choice("oc-")) for k in range(200)]
    df = spark.createDataFrame(rows, "u int, k int, d date, kind string")
    got = sequence.greedy_durations(df, ["u"], ["d", "k"], "d", F.col("kind") == "o", F.col("kind") == "c")
    want = []
    for u in range(7):
        waiting = deque()
        for _, _, d, kind in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            if kind == "o":
                waiting.append(d)
            elif kind == "c" and waiting:
                want.append((u, (d - waiting.popleft()).days))
    assert sorted((r["u"], r["days"]) for r in got.collect()) == sorted(want)


def test_search_and_sources(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    got = {(r["node"], r["degree"]) for r in graph.bounded_search(spark.createDataFrame([(1,)], "node long"), edges, 3).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}
    (tmp_path / "a.csv").write_text('Nome,Data Decisão\n" Ana_x000D_ ",nan\n')
    row = files.read_delimited(spark, str(tmp_path), ["Nome", "Data Decisão"]).first()
    assert (row["nome"], row["data_decisao"]) == ("Ana", None)
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    two = spark.createDataFrame([(1, 2, "c")], "k int, v int, x string")
    assert {(r["k"], r["x"]) for r in files.merge_increment(one, two, ["k"], ["v"]).collect()} == {(1, "c"), (2, "b")}
    assert joins.orphans(one, "k", two, "k").count() == 1


def test_fuzzy(spark):
    index = match.prepared(spark.createDataFrame([(1, "MARIA APARECIDA SOUZA"), (2, "MARIA APARECIDA SOUSA"), (3, "JOAO PEREIRA LIMA")], "i int, n string"), "i", "n")
    asked = match.prepared(spark.createDataFrame([(10, "João Pereira de Lima"), (11, "MARIA APARECIDA SOUZE"), (12, "NOBODY")], "i int, n string"), "i", "n")
    got = {r["id"]: (r["target"], r["strategy"]) for r in match.resolve(asked, index).collect()}
    assert got[12] == (None, "unmatched") and got[11] == (1, "levenshtein") and got[10][0] in (3, None)


def test_stream_equals_batch(spark, folder, tmp_path):
    from assize.streaming import events

    table = spark.read.parquet(f"{folder}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.event_stream(spark, str(tmp_path / "in"), table), "ts", ["event_type"], "value", late="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["event_type"], r["start"], r["events"]) for r in spark.table("tumbled").collect()}
    want = {(r["event_type"], r["start"], r["events"]) for r in events.tumbling(table, "ts", ["event_type"], "value").collect()}
    assert got == want


def test_rows_with_nulls_match_once(spark):
    """A matched row with a null in any column comes once; one without a date stays unmatched."""
    left = spark.createDataFrame([(1, "2024-01-01", None), (1, "2024-03-01", "x"), (2, None, None), (None, "2024-01-01", "y")], "k int, d string, note string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([(1, "2024-01-05", None), (1, "2024-01-31", "b"), (1, "2024-06-01", "c"), (None, "2024-01-02", "d")], "k int, later string, r string").withColumn("later", F.to_date("later"))
    got = sorted((str(r["k"]), str(r["note"]), r["gap_days"] or 0) for r in joins.within_days(left, right, ["k"], "d", "later", 30).collect())
    assert got == sorted([("1", "None", 4), ("1", "None", 30), ("1", "x", 0), ("2", "None", 0), ("None", "y", 0)])


def test_ties_in_time_are_told_apart(spark):
    rows = [(1, 1, 10, "stop"), (1, 2, 10, "go"), (2, 1, 10, "go"), (2, 2, 10, "stop")]
    df = spark.createDataFrame(rows, "u int, k int, t int, kind string").withColumn("d", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("t")))
    for partitions in (1, 3):
        out = joins.not_followed(df.repartition(partitions), ["u"], "d", F.col("kind") == "stop", F.col("kind") == "go", 5, ["k"]).collect()
        assert [(r["u"], r["k"]) for r in out] == [(2, 2)]


def test_candidates_are_limited_by_their_number(spark):
    """Frequent tokens with a small intersection give candidates; a query whose candidates are too many has none."""
    names = [(k, f"SILVA RARE{k % 40}") for k in range(200)] + [(k, f"SOUZA RARE{k % 40}") for k in range(200, 400)] + [(900, "SILVA SOUZA")]
    index = match.prepared(spark.createDataFrame(names, "i int, n string"), "i", "n")
    asked = match.prepared(spark.createDataFrame([(1, "SILVA SOUZA"), (2, "SILVA XAVIER"), (3, "SILVA RARE7")], "i int, n string"), "i", "n")
    got = {}
    for r in match.candidates(asked, index, most=20).collect():
        got.setdefault(r["id"], set()).add(r["target"])
    assert got == {1: {900}, 3: {7, 47, 87, 127, 167}}


def test_edits_anywhere(spark):
    index = match.prepared(spark.createDataFrame([(1, "MARIA"), (2, "MARINA SOUZA"), (3, "AB")], "i int, n string"), "i", "n")
    asked = match.prepared(spark.createDataFrame([(1, "XARIA"), (2, "ARINA SOUSA"), (3, "MARIA"), (4, "ZZ"), (5, "B")], "i int, n string"), "i", "n")
    assert {(r["id"], r["target"], r["edits"]) for r in match.within_edits(asked, index).collect()} == {(1, 1, 1), (2, 2, 2), (3, 1, 0), (4, 3, 2), (5, 3, 1)}


def test_forest_is_one_for_a_group(spark):
    """A group dealt over many tasks scores as it does in one; the scale is the group's."""
    import random

    from assize.operators import builders

    rng = random.Random(2)
    rows = [(k, "g" if k % 3 else "h", rng.choice("aaaabc"), rng.choice("xxy"), rng.choice("ppppppq")) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, g string, a string, b string, c string")
    whole, parts = (sorted(map(tuple, builders.isolation_rarity(df, "k", ["g"], ["a", "b", "c"], trees=20, rows_a_task=n).collect())) for n in (50_000, 60))
    assert whole == parts and len(whole) == 600
    for g in "gh":
        mine = [r[2] for r in whole if r[1] == g]
        assert (min(mine), max(mine)) == (0.0, 1.0)
    common, odd = ([r[2] for r in whole if rows[r[0]][2:] == x] for x in (("a", "x", "p"), ("b", "y", "q")))
    assert max(common) < min(odd)


def test_process_refs_begin_where_words_do(spark, tmp_path):
    import duckdb

    from assize.plans import catalogue

    rows = ["RE 33.89 e HC 5", "ele queier ère 33.89.168.153", "áre 4, xRE 5, 7MS 8, _ADI 9, (ADI 9)", "RE\v12 ms\t 1.2 ms 12", "", None]
    classes = ["RE", "HC", "MS", "ADI", "ARE"]
    assert values(spark, rows[:3], text.extract_process_refs(F.col("v"), classes)) == [["RE 3389", "HC 5"], [], ["ADI 9"]]
    assert values(spark, rows[:3], text.extract_process_refs(F.col("v"), classes, ascii_only=True)) == [["RE 3389", "HC 5"], ["RE 3389168153"], ["RE 4", "ADI 9"]]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = {tuple(r) for r in catalogue.QUERIES["process_refs_extract"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(catalogue.ORACLE_SQL["process_refs_extract"]).fetchall())
