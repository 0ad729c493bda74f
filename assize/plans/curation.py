"""Curated records and the query surface, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import curation
from assize.plans.bindings import DECISIONS, Registry, decisions
from assize.session import read_table

R = Registry()


@R.add("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'HC ' || o_custkey END AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate FROM orders), t AS (SELECT 'HC ' || o_custkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, min(l_partkey) AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT 'de_' || substr(sha256('decisoes.csv:' || o_orderkey || ':' || o.number), 1, 16) AS event_id, 'proc_' || substr(sha256(o.number), 1, 16) AS process_id, year(o_orderdate)::INT AS decision_year, strftime(o_orderdate, '%Y-%m') AS time_bucket, doc_id FROM o LEFT JOIN t ON t.number = o.number AND t.day = o.day WHERE o.number IS NOT NULL""")
def decision_events(spark, folder):
    orders = read_table(spark, folder, "orders")
    number = F.concat(F.lit("HC "), F.col("o_custkey"))
    lines = read_table(spark, folder, "lineitem").where("l_returnflag = 'R'").join(orders, F.expr("l_orderkey = o_orderkey"))
    texts = lines.select(number.alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("l_partkey").alias("doc_id"))
    rows = orders.withColumn("n", F.when(F.col("o_orderkey") % 9 == 0, "  ").otherwise(number))
    return curation.decision_events(rows, texts, "o_orderkey", "n", "o_orderdate", "decisoes.csv")


@R.add("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), m AS (SELECT user_id, date_trunc('month', day)::DATE AS month, count(*) AS days FROM d GROUP BY ALL),
w AS (SELECT *, (SELECT count(*) FROM generate_series(month::TIMESTAMP, month::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::INT AS workdays, month(month) IN (1, 7) AS recess FROM m), r AS (SELECT *, days / workdays AS exact FROM w),
p AS (SELECT a.user_id, a.month, (SELECT list(b.days ORDER BY b.month DESC)[1:3] FROM r b WHERE b.user_id = a.user_id AND b.month < a.month AND NOT b.recess) AS lately, (SELECT count(*) FROM r b WHERE b.user_id = a.user_id AND b.month < a.month) AS nb, (SELECT avg(b.exact) FROM r b WHERE b.user_id = a.user_id AND b.month < a.month) AS prior FROM r a)
SELECT user_id, month, days, workdays, round_even(exact, 4)::DOUBLE AS ratio, recess, coalesce(NOT recess AND len(lately) = 3 AND list_sum(lately) / 3 >= 15 AND days < 5, false) AS leave, coalesce(nb >= 3 AND exact < 0.3 AND prior > 0.5, false) AS gap, CASE WHEN exact >= 0.6 THEN 'high' WHEN exact >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM r JOIN p USING (user_id, month)""")
def month_coverage(spark, folder):
    return curation.month_coverage(read_table(spark, folder, "events"), ["user_id"], "ts")


@R.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN l_returnflag = 'A' ELSE l_linestatus = 'F' END AS is_signal FROM lineitem")
def signal_qualification(spark, folder):
    substantive = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", curation.qualifies(substantive, F.col("l_linestatus") == "F", F.col("l_linenumber") > 3).alias("is_signal"))


@R.add("SELECT s_suppkey, CASE WHEN upper(s_name) IN (SELECT upper(s_name) FROM supplier WHERE s_acctbal > 5000) THEN 'structural' WHEN starts_with(upper(s_name), 'SUPPLIER#00000001') OR starts_with(upper(s_name), 'SUPPLIER_1') THEN 'fallback:name_prefix' ELSE 'private' END AS basis FROM supplier")
def institutional_names(spark, folder):
    rows = read_table(spark, folder, "supplier")
    return curation.institutional(rows, "s_name", rows.where("s_acctbal > 5000").select(F.lower("s_name").alias("name")), ("SUPPLIER#00000001", "SUPPLIER_1")).select("s_suppkey", "basis")


@R.add("""WITH l AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_returnflag, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey, count(DISTINCT b.l_suppkey) AS others FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
SELECT l_suppkey, count(*) AS cases, coalesce(any_value(others), 0) AS others FROM l LEFT JOIN p USING (l_suppkey) GROUP BY l_suppkey""")
def co_members(spark, folder):
    """Suppliers on a side of an order, of which one is not known."""
    side = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return curation.co_members(read_table(spark, folder, "lineitem").withColumn("l_returnflag", side), ["l_orderkey", "l_returnflag"], "l_suppkey")


@R.add("""WITH y AS (SELECT l_suppkey, year(l_shipdate)::INT AS y, count(*) AS n, sum(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS years, sum(n)::BIGINT AS rows, round_even(sum(p), 2)::DOUBLE AS total, arg_max(y, struct_pack(p := p, y := y)) AS top_year, round_even(max(p) / sum(p), 6)::DOUBLE AS top_share FROM y GROUP BY l_suppkey""")
def donation_years(spark, folder):
    return curation.two_pass_years(read_table(spark, folder, "lineitem").withColumn("y", F.year("l_shipdate")), "l_suppkey", "y", "l_extendedprice")


@R.add("""WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority AS signal FROM orders) SELECT n.signal, count(s.signal) AS pairs FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW'), ('velocity')) n(signal) LEFT JOIN s ON s.signal = n.signal GROUP BY ALL""")
def signal_frequency(spark, folder):
    rows = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("signals"))
    return curation.signal_frequency(rows, "signals", ["1-URGENT", "2-HIGH", "5-LOW", "velocity"])


@R.add("SELECT l_orderkey, l_linenumber, round_even(l_discount * CASE WHEN l_returnflag = 'A' THEN 2.0 ELSE 1.0 END * CASE WHEN l_linenumber > 2 THEN pow(0.5, l_linenumber - 2) ELSE 1.0 END, 6)::DOUBLE AS adjusted FROM lineitem")
def adjusted_deltas(spark, folder):
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.bround(curation.adjusted_delta(F.col("l_discount").cast("double"), F.col("l_returnflag") == "A", F.col("l_linenumber")), 6).alias("adjusted"))


@R.add(f"""WITH {DECISIONS}, c AS (SELECT cls, member, outcome, count(*) AS n FROM dec GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cls, member) AS p FROM c)
SELECT cls, member, arg_max(outcome, struct_pack(p := p, o := outcome)) AS expected, round_even(max(p), 6)::DOUBLE AS probability FROM p GROUP BY ALL""")
def expected_values(spark, folder):
    counts = decisions(spark, folder).groupBy("cls", "member", "outcome").agg(F.count("*").alias("n"))
    return curation.top_value(counts, ["cls", "member"], "outcome", "n")


@R.add("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::INT AS occurrence FROM events")
def occurrence_indices(spark, folder):
    return curation.occurrence_index(read_table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "occurrence")


@R.add("""WITH a AS (SELECT DISTINCT l_suppkey, l_partkey % 97 AS member FROM lineitem), g AS (SELECT member, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM (SELECT DISTINCT p_partkey % 97 AS member, p_partkey % 97 % 10 AS group_id FROM part))
SELECT l_suppkey, arg_max(group_id, struct_pack(m := members, g := -group_id)) AS group_id, max(members) AS members FROM a JOIN g USING (member) GROUP BY l_suppkey""")
def largest_groups(spark, folder):
    """Of the groups that hold any of a supplier's parts, by an array of them, the largest."""
    rows = read_table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 97).alias("members_of"))
    pairs = read_table(spark, folder, "part").select((F.col("p_partkey") % 97).alias("member"), (F.col("p_partkey") % 97 % 10).alias("group_id")).distinct()
    groups = pairs.join(pairs.groupBy("group_id").agg(F.count("*").alias("members")), "group_id")
    return curation.largest_group(rows, "l_suppkey", "members_of", groups)


@R.add("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t FROM events) WHERE t <= 500")
def review_sample(spark, folder):
    rows = read_table(spark, folder, "events")
    return curation.capped_by_reason(rows, "event_type", ["ts", "event_id"])[0].select("event_type", "event_id")


@R.add("""WITH u AS (SELECT DISTINCT o_custkey AS k, 'orders' AS f FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) SELECT k, string_agg(DISTINCT f, ',' ORDER BY f) AS sources FROM u GROUP BY k""")
def keys_with_provenance(spark, folder):
    keys = [("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")]
    return curation.union_with_provenance([(t, read_table(spark, folder, t).select(F.col(c).alias("k"))) for t, c in keys], ["k"])


@R.add("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'cpf_validated' WHEN 1 THEN 'cnpj_validated' WHEN 2 THEN 'tax_id_masked' WHEN 3 THEN 'name_raw' WHEN 4 THEN 'name_normalized' ELSE 'tax_id_unvalidated' END AS kind, CASE c_custkey % 7 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' ELSE 'medium' END AS quality,
CASE c_custkey % 7 WHEN 0 THEN '52998224725' WHEN 1 THEN '11222333000181' WHEN 2 THEN '***123456**' WHEN 3 THEN '' WHEN 4 THEN upper(c_name) WHEN 5 THEN '52998224726' ELSE lpad((c_custkey + 10000000)::VARCHAR, 8, '0') END AS normalized FROM customer""")
def identifier_quality(spark, folder):
    key = F.col("c_custkey")
    raw = F.when(key % 7 == 0, "529.982.247-25").when(key % 7 == 1, "11.222.333/0001-81").when(key % 7 == 2, "***123456**").when(key % 7 == 3, "  ").when(key % 7 == 4, F.lower("c_name")).when(key % 7 == 5, "529.982.247-26").otherwise((key + 10000000).cast("string"))
    return read_table(spark, folder, "customer").select("c_custkey", curation.identifier(raw).alias("i")).select("c_custkey", "i.kind", "i.quality", "i.normalized")


@R.add("""SELECT p_partkey, '1 - ' || p_type || ' | 2 - ' || p_brand || ' x || ' || p_name || ' | end' AS subjects FROM part""")
def subject_lists(spark, folder):
    raw = F.concat(F.lit("1 - "), F.col("p_type"), F.lit(" \n 2 - "), F.col("p_brand"), F.lit("\nx||"), F.col("p_name"), F.lit("|end"))
    return read_table(spark, folder, "part").select("p_partkey", curation.subject_separators(raw).alias("subjects"))


@R.add(f"""WITH {DECISIONS}, a AS (SELECT member, y, max(price) / 1e6 AS score, count(DISTINCT cls) AS signals FROM dec GROUP BY ALL) SELECT member, y, round_even(score, 6)::DOUBLE AS score, signals FROM a ORDER BY score + signals * 0.05 DESC, member, y LIMIT 100""")
def alert_page(spark, folder):
    """The first page of alerts by score and signals; a page of more than 100 rows is brought down to 100."""
    rows = decisions(spark, folder).groupBy("member", "y").agg((F.max("price") / 1e6).alias("score"), F.count_distinct("cls").alias("signals"))
    return curation.page(rows, [F.desc(F.col("score") + F.col("signals") * 0.05), "member", "y"], 0, 500).select("member", "y", F.bround("score", 6).alias("score"), "signals")


@R.add("""WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS v FROM orders), b AS (SELECT DISTINCT c_mktsegment AS v FROM customer), a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '__all__' WHEN 1 THEN '1996-05' WHEN 2 THEN '1800-01' END AS period, CASE WHEN c_custkey % 3 = 0 THEN 'NOWHERE' ELSE c_mktsegment END AS body, CASE c_custkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'colegiado' WHEN 2 THEN 'monocratico' WHEN 3 THEN 'odd' END AS kind FROM customer)
SELECT id, CASE WHEN period = '__all__' THEN period WHEN period IN (SELECT v FROM p) THEN period ELSE (SELECT max(v) FROM p) END AS period, CASE WHEN body IN (SELECT v FROM b) THEN body END AS body, CASE WHEN kind IN ('all', 'colegiado', 'monocratico') THEN kind ELSE 'all' END AS kind FROM a""")
def filter_resolution(spark, folder):
    key = F.col("c_custkey")
    customer = read_table(spark, folder, "customer")
    option = lambda name, df, value: df.select(F.lit(name).alias("name"), value.alias("value")).distinct()
    options = option("period", read_table(spark, folder, "orders"), F.date_format("o_orderdate", "yyyy-MM")).union(option("body", customer, F.col("c_mktsegment")))
    period = F.when(key % 4 == 0, "__all__").when(key % 4 == 1, "1996-05").when(key % 4 == 2, "1800-01")
    kind = F.when(key % 5 == 0, "all").when(key % 5 == 1, "colegiado").when(key % 5 == 2, "monocratico").when(key % 5 == 3, "odd")
    asked = customer.select(key.alias("id"), period.alias("period"), F.when(key % 3 == 0, "NOWHERE").otherwise(F.col("c_mktsegment")).alias("body"), kind.alias("kind"))
    return curation.resolved_filters(asked, options)
