"""Representation, matched donors and gates, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import audit, representation
from assize.plans.bindings import Registry
from assize.session import read_table

R = Registry()


@R.add("""WITH e AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_returnflag, l_suppkey, l_orderkey || ':' || l_returnflag || ':' || l_suppkey AS edge_id FROM lineitem),
v AS (SELECT l_orderkey || ':' || l_returnflag || ':' || l_suppkey AS edge_id, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linestatus = 'F'),
k AS (SELECT edge_id, string_agg(l_linenumber || '=' || n, ',' ORDER BY l_linenumber || '=' || n) AS kinds FROM (SELECT edge_id, l_linenumber, count(*) AS n FROM v GROUP BY ALL) GROUP BY edge_id), s AS (SELECT edge_id, count(*) AS events, min(d) AS a, max(d) AS b FROM v GROUP BY ALL)
SELECT e.edge_id, e.l_suppkey, coalesce(events, 0) AS events, kinds, a AS first_day, b AS last_day, coalesce(date_diff('day', a, b), 0)::INT AS span_days, (SELECT count(*) FROM e o WHERE o.l_orderkey = e.l_orderkey AND o.l_returnflag IS NOT DISTINCT FROM e.l_returnflag AND o.l_suppkey <> e.l_suppkey) AS companions FROM e LEFT JOIN s USING (edge_id) LEFT JOIN k USING (edge_id)""")
def representation_edges(spark, folder):
    lines = read_table(spark, folder, "lineitem").withColumn("edge_id", F.concat_ws(":", "l_orderkey", "l_returnflag", "l_suppkey")).withColumn("d", F.to_date("l_shipdate"))
    side = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag")
    edges = lines.select("edge_id", "l_orderkey", side, "l_suppkey").distinct()
    return representation.edge_activity(edges, lines.where("l_linestatus = 'F'"), "edge_id", "l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber", "d")


WINDOWS = {1: "pauta", 2: "vista", 3: "julgamento", 4: "publicacao"}


@R.add("""WITH l AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS m FROM lineitem), w AS (SELECT l_orderkey AS c, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS m, CASE l_linenumber WHEN 1 THEN 'pauta' WHEN 2 THEN 'vista' WHEN 3 THEN 'julgamento' WHEN 4 THEN 'publicacao' END AS stage, CAST(l_shipdate AS DATE) AS d FROM lineitem),
x AS (SELECT m, c, stage, d FROM w WHERE m IS NOT NULL UNION ALL SELECT l.m, w.c, stage, d FROM w JOIN l ON l.c = w.c WHERE w.m IS NULL)
SELECT m AS l_suppkey, stage, count(*) AS events, count(DISTINCT c) AS cases, min(d) AS first_day, max(d) AS last_day FROM x WHERE stage IS NOT NULL GROUP BY ALL""")
def representation_windows(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    stage = F.lit(None).cast("string")
    for number, name in WINDOWS.items():
        stage = F.when(F.col("l_linenumber") == number, name).otherwise(stage)
    events = lines.select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("l_suppkey"), stage.alias("stage"), F.to_date("l_shipdate").alias("d"))
    return representation.window_rollup(lines.select("l_orderkey", "l_suppkey"), events, "l_suppkey", "l_orderkey", "stage", "d").withColumn("events", F.col("events").cast("long"))


@R.add("""WITH e AS (SELECT l_suppkey, l_orderkey, CAST(l_shipdate AS DATE) AS a, (CAST(l_shipdate AS DATE) + l_linenumber::INT) AS b FROM lineitem WHERE l_linenumber = 1), s AS (SELECT l_suppkey, count(*) AS edges, least(min(a), min(b)) AS first_day, greatest(max(a), max(b)) AS last_day FROM e GROUP BY ALL),
c AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2)), k AS (SELECT l_suppkey, l_orderkey, o_orderpriority AS cls, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS minister FROM c LEFT JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT l_suppkey, string_agg(cls || '=' || n, ',' ORDER BY cls || '=' || n) AS by_cls FROM (SELECT l_suppkey, cls, count(*) AS n FROM k WHERE cls IS NOT NULL GROUP BY ALL) GROUP BY ALL), q AS (SELECT l_suppkey, string_agg(minister || '=' || n, ',' ORDER BY minister || '=' || n) AS by_minister FROM (SELECT l_suppkey, minister, count(*) AS n FROM k WHERE minister IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT l_suppkey, n.cases, coalesce(edges, 0) AS edges, first_day, last_day, by_cls, by_minister FROM (SELECT l_suppkey, count(*) AS cases FROM k GROUP BY ALL) n LEFT JOIN s USING (l_suppkey) LEFT JOIN p USING (l_suppkey) LEFT JOIN q USING (l_suppkey)""")
def amicus_network(spark, folder):
    lines = read_table(spark, folder, "lineitem").withColumn("a", F.to_date("l_shipdate")).withColumn("b", F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")))
    cases = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("cls"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("minister"))
    return representation.role_network(lines.where("l_linenumber = 1"), lines.where("l_linenumber = 2"), cases, "l_suppkey", "l_orderkey", "a", "b", ["cls", "minister"])


@R.add("""WITH e AS (SELECT o_custkey AS client, o_orderkey // 8 AS c, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS f, o_orderpriority = '5-LOW' AS passive FROM orders), v AS (SELECT client, c, CASE WHEN passive THEN 1 - f ELSE f END AS fav FROM e),
m AS (SELECT DISTINCT l_partkey, o_custkey AS client FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT c_custkey AS client FROM customer WHERE c_acctbal > 9000),
n AS (SELECT l_partkey, count(*) AS clients, count(*) FILTER (client IN (SELECT client FROM k)) AS flagged FROM m GROUP BY ALL), r AS (SELECT l_partkey, avg(fav) AS o, avg(fav) FILTER (client IN (SELECT client FROM k)) AS f, count(DISTINCT c) FILTER (client IN (SELECT client FROM k)) AS cases FROM m JOIN v USING (client) GROUP BY ALL)
SELECT l_partkey, clients, flagged, round_even(f, 6)::DOUBLE AS flagged_rate, round_even(o, 6)::DOUBLE AS overall_rate, coalesce(f > o + 0.15 AND cases >= 3, false) AS stands_out FROM n LEFT JOIN r USING (l_partkey) WHERE flagged > 0""")
def client_profiles(spark, folder):
    orders = read_table(spark, folder, "orders")
    won = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    entries = orders.select(F.col("o_custkey").alias("client"), F.floor(F.col("o_orderkey") / 8).alias("c"), representation.favourable(won, F.col("o_orderpriority") == "5-LOW").alias("fav"))
    clients = read_table(spark, folder, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).select("l_partkey", F.col("o_custkey").alias("client"))
    flagged = read_table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("client"))
    return representation.client_profiles(clients, entries, flagged, "l_partkey", "client", "c", "fav")


@R.add("""WITH d AS (SELECT l_suppkey, year(l_shipdate)::INT AS y, l_extendedprice AS p, l_linenumber AS a, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS b FROM lineitem), r AS (SELECT min(y) AS since FROM (SELECT DISTINCT y FROM d ORDER BY y DESC LIMIT 2)), o AS (SELECT * FROM d WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
t AS (SELECT l_suppkey, sum(p) AS s, count(*) AS n, count(DISTINCT y) AS years, min(y) AS y0, max(y) AS y1 FROM o GROUP BY ALL), ta AS (SELECT l_suppkey, max(p) AS top FROM (SELECT l_suppkey, a, sum(p) AS p FROM o WHERE a IS NOT NULL GROUP BY ALL) GROUP BY ALL), tb AS (SELECT l_suppkey, max(p) AS top FROM (SELECT l_suppkey, b, sum(p) AS p FROM o WHERE b IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT l_suppkey, round_even(s, 2)::DOUBLE AS total, n AS donations, round_even(s / n, 2)::DOUBLE AS mean, years, y1 - y0 + 1 AS year_span, y1 >= since AS recent, round_even(ta.top / s, 4)::DOUBLE AS top_share_a, round_even(tb.top / s, 4)::DOUBLE AS top_share_b FROM t CROSS JOIN r LEFT JOIN ta USING (l_suppkey) LEFT JOIN tb USING (l_suppkey)""")
def matched_donors(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.col("l_extendedprice").alias("p"), F.col("l_linenumber").alias("a"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("b"))
    matched = read_table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return representation.matched_donors(lines, matched, "l_suppkey", "y", "p", ["a", "b"])


@R.add("""SELECT * FROM (SELECT 'orders' AS module, count(*) AS rows, 'available' AS status FROM orders) UNION ALL SELECT 'parts', count(*), 'available' FROM part UNION ALL SELECT 'returns', 0, 'empty_after_build' UNION ALL SELECT 'agenda', 0, 'missing_source' UNION ALL SELECT 'graph', 0, 'missing_source'""")
def module_availability(spark, folder):
    modules = spark.createDataFrame([("orders", "orders", True), ("parts", "part", True), ("returns", "lineitem", True), ("agenda", "agenda", False), ("graph", None, True)], "module string, source string, found boolean")
    count = lambda name, df: df.agg(F.lit(name).alias("module"), F.count("*").alias("rows"))
    counts = count("orders", read_table(spark, folder, "orders")).union(count("parts", read_table(spark, folder, "part"))).union(count("returns", read_table(spark, folder, "lineitem").where("l_returnflag = 'X'")))
    return audit.module_availability(modules, counts)


@R.add("""WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN 4 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT l_orderkey AS k, l_suppkey AS e FROM lineitem), a AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS e FROM orders),
x AS (SELECT 'link_without_group' AS gate, (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM g)) AS faults UNION ALL SELECT 'size_differs', (SELECT count(*) FROM g LEFT JOIN (SELECT k, count(*) AS m FROM l GROUP BY k) USING (k) WHERE n <> coalesce(m, 0)) UNION ALL SELECT 'link_repeated', (SELECT count(*) FROM (SELECT k, e FROM l GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'alert_without_link', (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = a.k AND l.e = a.e)))
SELECT gate, faults, CASE WHEN faults > 0 THEN 'fail' ELSE 'ok' END AS status FROM x""")
def audit_gates(spark, folder):
    orders, lines = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("e"))
    counted = orders.join(lines.groupBy("k").agg(F.count("*").alias("m")), F.expr("o_orderkey = k"), "left")
    groups = counted.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderpriority") == "5-LOW", 4).otherwise(F.coalesce("m", F.lit(0))).alias("n"))
    return audit.audit_gates(groups, lines, orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("e")), "k", "e", "n")


@R.add("""SELECT c_mktsegment, count(*) AS before, count(*) FILTER (c_acctbal >= 0) AS after FROM customer GROUP BY ALL HAVING before <> after""")
def rows_preserved(spark, folder):
    customer = read_table(spark, folder, "customer")
    return audit.rows_preserved(customer, customer.where("c_acctbal >= 0"), ["c_mktsegment"])


@R.add("""WITH p AS (SELECT 'entity' AS kind, c_custkey AS key, c_name AS label, 0 AS turn FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'entity', s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT 'case', o_orderkey, o_orderpriority, 2 FROM orders)
SELECT 'gn_' || substr(sha256(kind || ':' || key), 1, 16) AS node_id, kind, arg_min(label, turn) AS label FROM p GROUP BY kind, key""")
def graph_nodes(spark, folder):
    part = lambda table, key, label: read_table(spark, folder, table).select(F.col(key).alias("key"), F.col(label).alias("label"))
    customers = read_table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"))
    return audit.graph_nodes([("entity", customers), ("entity", part("supplier", "s_suppkey", "s_name")), ("case", part("orders", "o_orderkey", "o_orderpriority"))])


@R.add("""SELECT 'gp_' || substr(sha256(l_suppkey || ':' || l_orderkey), 1, 16) AS path_id, l_suppkey AS start, l_orderkey AS finish, min('r' || l_linenumber) AS kind FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY l_suppkey, l_orderkey""")
def risk_paths(spark, folder):
    edges = read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"), F.concat(F.lit("r"), "l_linenumber").alias("kind"))
    return audit.risk_paths(edges, ["r1", "r2", "r3"])
