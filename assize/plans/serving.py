"""Rollups, flows, compound risk, the query surface and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.functions import dates, rules, text
from assize.operators import flow, joins, quality, risk, rollups
from assize.plans.bindings import DECISIONS, Registry, decisions
from assize.session import read_table

R = Registry()


@R.add("""WITH b AS (SELECT l_suppkey AS donor, l_partkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS a, l_returnflag, year(l_shipdate) AS cycle, l_linenumber FROM lineitem), t AS (SELECT donor, count(*) AS donations, round_even(sum(a), 2)::DOUBLE AS total, round_even(avg(a), 6)::DOUBLE AS mean, max(a) AS largest, count(DISTINCT l_partkey) AS receivers, date_diff('day', min(d), max(d))::INT AS span_days FROM b GROUP BY donor),
x AS (SELECT donor, max(p) / sum(p) AS s FROM (SELECT donor, l_returnflag, sum(a) AS p FROM b GROUP BY ALL) GROUP BY donor), y AS (SELECT donor, max(p) / sum(p) AS s FROM (SELECT donor, cycle, sum(a) AS p FROM b GROUP BY ALL) GROUP BY donor), z AS (SELECT donor, max(p) / sum(p) AS s FROM (SELECT donor, l_linenumber, sum(a) AS p FROM b GROUP BY ALL) GROUP BY donor)
SELECT t.*, round_even(x.s, 6)::DOUBLE AS top_share_l_returnflag, round_even(y.s, 6)::DOUBLE AS top_share_cycle, round_even(z.s, 6)::DOUBLE AS top_share_l_linenumber FROM t JOIN x USING (donor) JOIN y USING (donor) JOIN z USING (donor)""")
def donor_rollup(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumns({"donor": F.col("l_suppkey"), "d": F.to_date("l_shipdate"), "cycle": F.year("l_shipdate")})
    return rollups.donor_rollup(rows, "donor", "l_partkey", "d", "l_extendedprice", ["l_returnflag", "cycle", "l_linenumber"])


@R.add("""SELECT l_suppkey, count(*) AS payments, round_even(sum(l_extendedprice), 2)::DOUBLE AS total, coalesce(arg_max(l_returnflag || l_partkey, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, e := l_partkey)) FILTER (l_linestatus = 'F'), arg_min(l_returnflag || l_partkey, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, e := l_partkey))) AS best_name FROM lineitem GROUP BY l_suppkey""")
def counterparty_rollup(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("name", F.concat("l_returnflag", "l_partkey"))
    return rollups.counterparty_rollup(rows, "l_suppkey", "name", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice", F.col("l_linestatus") == "F")


@R.add("SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS cases, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2")
def pair_recurrence(spark, folder):
    return rollups.recurrence(read_table(spark, folder, "lineitem").withColumn("d", F.to_date("l_shipdate")), ["l_suppkey", "l_partkey"], "l_orderkey", "d")


@R.add("""WITH o AS (SELECT unnest([n_name, 'REGION_' || n_regionkey]) AS origin FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT origin, count(*) AS rows FROM o GROUP BY origin), t AS (SELECT n_name AS origin, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'REGION_' || n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT origin, rows, total, round_even(rows / total, 6)::DOUBLE AS share FROM k JOIN t USING (origin)""")
def origin_shares(spark, folder):
    nation = read_table(spark, folder, "nation")
    origins = F.array("n_name", F.concat(F.lit("REGION_"), "n_regionkey")).alias("origins")
    rows = read_table(spark, folder, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select(origins)
    totals = read_table(spark, folder, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(F.explode(origins).alias("origin")).groupBy("origin").agg(F.count("*").alias("total"))
    return rollups.shares_of_origin(rows, "origins", totals, "origin")


FLOW = f"{DECISIONS}, f AS (SELECT member, theme, cls, strftime(d, '%Y-%m') AS period, CASE outcome WHEN 'favorable' THEN 'collegiate' WHEN 'unfavorable' THEN 'monocratic' END AS kind, d FROM dec)"


def _flow(spark, folder):
    kind = F.when(F.col("outcome") == "favorable", "collegiate").when(F.col("outcome") == "unfavorable", "monocratic")
    return decisions(spark, folder).select("member", "theme", "cls", dates.month_key(F.col("d")).alias("period"), kind.alias("kind"), "d")


@R.add(f"""WITH {FLOW} SELECT CASE WHEN grouping(member) = 1 THEN '*' ELSE member END AS member, CASE WHEN grouping(theme) = 1 THEN '*' ELSE theme END AS theme, CASE WHEN grouping(cls) = 1 THEN '*' ELSE cls END AS cls, CASE WHEN grouping(period) = 1 THEN '*' ELSE period END AS period, CASE WHEN grouping(kind) = 1 THEN '*' ELSE kind END AS kind, count(*) AS events, count(DISTINCT d) AS active_days
FROM f GROUP BY CUBE (member, theme, cls, period, kind) HAVING grouping(kind) = 1 OR kind IS NOT NULL""")
def flow_cube(spark, folder):
    return flow.flow_cube(_flow(spark, folder), ["member", "theme", "cls"], "period", "kind", "d")


@R.add(f"""WITH {FLOW}, g AS (SELECT member, period, count(*) AS events, count(DISTINCT d) AS days FROM f GROUP BY ALL)
SELECT *, coalesce(sum(events) OVER w, 0)::BIGINT AS history_events, coalesce(sum(days) OVER w, 0)::BIGINT AS history_days FROM g WINDOW w AS (PARTITION BY member ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def flow_history_running(spark, folder):
    return flow.history(_flow(spark, folder), ["member"], "period", "d")


@R.add(f"WITH {FLOW}, g AS (SELECT cls, d AS day, count(*) AS events FROM f GROUP BY ALL) SELECT cls, day, events, round_even(events - avg(events) OVER w, 6)::DOUBLE AS delta, round_even(events / avg(events) OVER w, 6)::DOUBLE AS ratio FROM g WINDOW w AS (PARTITION BY cls)")
def daily_vs_history(spark, folder):
    return flow.days_against_mean(_flow(spark, folder), ["cls"], "d")


@R.add(f"WITH {DECISIONS}, s AS (SELECT unnest(['cls', 'theme', 'outcome']) AS segment, unnest([cls, theme, outcome]) AS value, y >= 2000 AS now FROM dec) SELECT segment, value, count(*) FILTER (now) AS current, count(*) FILTER (NOT now) AS historical FROM s GROUP BY ALL")
def segment_flow(spark, folder):
    return flow.segments(decisions(spark, folder), ["cls", "theme", "outcome"], F.col("y") >= 2000)


@R.add("""WITH g AS (SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*) AS events, count(DISTINCT CASE WHEN isodow(ts) < 6 THEN CAST(ts AS DATE) END) AS active FROM events GROUP BY ALL), w AS (SELECT *, (SELECT count(*) FROM generate_series(month::TIMESTAMP, month::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::INT AS workdays FROM g)
SELECT *, round_even(active / workdays, 6)::DOUBLE AS ratio, CASE WHEN active / workdays >= 0.6 THEN 'high' WHEN active / workdays >= 0.3 THEN 'partial' ELSE 'low' END AS tier FROM w""")
def coverage_tiers(spark, folder):
    return flow.coverage(read_table(spark, folder, "events"), ["user_id"], "ts")


SIGNALS = """sg AS (SELECT c_nationkey AS member, o_custkey AS entity, 'rare' AS signal, max(o_totalprice) / 1e6 AS strength FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY ALL
  UNION ALL SELECT c_nationkey, c_custkey, 'donation', c_acctbal / 1e4 FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_nationkey, c_custkey, 'sanction', 1.0 FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT c_nationkey, c_custkey, 'link', 0.5 FROM customer WHERE c_custkey % 11 = 0)"""


def _signals(spark, folder):
    customer = read_table(spark, folder, "customer").select(F.col("c_nationkey").alias("member"), F.col("c_custkey").alias("entity"), "c_acctbal")
    rare = read_table(spark, folder, "orders").where("o_totalprice > 250000").join(customer, F.expr("o_custkey = entity")).groupBy("member", "entity").agg((F.max("o_totalprice") / 1e6).alias("strength"))
    named = lambda df, name, value: df.select("member", "entity", F.lit(name).alias("signal"), value.alias("strength"))
    parts = [named(rare, "rare", F.col("strength")), named(customer.where("c_acctbal > 8000"), "donation", F.col("c_acctbal") / 1e4), named(customer.where("entity % 17 = 0"), "sanction", F.lit(1.0)), named(customer.where("entity % 11 = 0"), "link", F.lit(0.5))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@R.add(f"""WITH {SIGNALS}, c AS (SELECT *, CASE WHEN signal IN ('sanction', 'link') THEN 'corporate' ELSE signal END AS family FROM sg)
SELECT member, entity, count(DISTINCT signal) AS signal_count, count(DISTINCT family) AS family_count, round_even(max(strength), 6)::DOUBLE AS max_strength, round_even(sum(strength), 6)::DOUBLE AS sum_strength, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals, count(DISTINCT family) >= 2 AS red_flag FROM c GROUP BY ALL""")
def compound_signals(spark, folder):
    return risk.compound(_signals(spark, folder), ["member", "entity"], {"sanction": "corporate", "link": "corporate"})


@R.add(f"""WITH {SIGNALS}, c AS (SELECT *, CASE WHEN signal IN ('sanction', 'link') THEN 'corporate' ELSE signal END AS family FROM sg), k AS (SELECT member, entity, count(DISTINCT signal) AS signal_count, count(DISTINCT family) AS family_count, round_even(max(strength), 6)::DOUBLE AS max_strength, round_even(sum(strength), 6)::DOUBLE AS sum_strength, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals, count(DISTINCT family) >= 2 AS red_flag FROM c GROUP BY ALL)
SELECT * FROM k ORDER BY red_flag DESC, signal_count DESC, family_count DESC, max_strength DESC, sum_strength DESC, member, entity LIMIT 20""")
def compound_top_pairs(spark, folder):
    return risk.ranked(compound_signals(spark, folder), ["member", "entity"], 20)


@R.add("""WITH d AS (SELECT DISTINCT c_custkey AS s, 'donation' AS signal FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT o_custkey AS s, l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), o AS (SELECT DISTINCT s AS holder, signal FROM d), p AS (SELECT DISTINCT t AS holder, signal FROM d JOIN b USING (s))
SELECT holder, signal, 'direct' AS via FROM o UNION ALL SELECT holder, signal, 'linked' FROM p WHERE (holder, signal) NOT IN (SELECT holder, signal FROM o)""")
def signal_propagation(spark, folder):
    direct = read_table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("s"), F.lit("donation").alias("signal"))
    bridge = read_table(spark, folder, "orders").join(read_table(spark, folder, "lineitem"), F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("s"), F.col("l_suppkey").alias("t")).distinct()
    return joins.propagate(direct, bridge, "s", "t")


@R.add("""SELECT p_partkey, round_even((a + b + c) / 3, 6)::DOUBLE AS arithmetic, round_even(coalesce(((a > 0.6)::INT * a + (b > 0.6)::INT * b + (c > 0.6)::INT * c) / nullif((a > 0.6)::INT + (b > 0.6)::INT + (c > 0.6)::INT, 0), (a + b + c) / 3), 6)::DOUBLE AS filtered, round_even(exp((ln(greatest(a, 1e-9)) + ln(greatest(b, 1e-9)) + ln(greatest(c, 1e-9))) / 3), 6)::DOUBLE AS geometric,
 round_even(3 / (1 / greatest(a, 1e-9) + 1 / greatest(b, 1e-9) + 1 / greatest(c, 1e-9)), 6)::DOUBLE AS harmonic, round_even(greatest(a, b, c), 6)::DOUBLE AS largest, round_even(a + b + c - greatest(a, b, c) - least(a, b, c), 6)::DOUBLE AS trimmed FROM (SELECT p_partkey, (p_size / 50.0)::DOUBLE AS a, (p_partkey % 10 / 10.0)::DOUBLE AS b, (p_partkey % 7 / 7.0)::DOUBLE AS c FROM part)""")
def alternative_scores(spark, folder):
    rows = read_table(spark, folder, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.col("p_partkey") % 10 / 10.0).alias("b"), (F.col("p_partkey") % 7 / 7.0).alias("c"))
    return risk.alternative_means(rows, "p_partkey", ["a", "b", "c"])


@R.add("SELECT 'priority' AS kind, o_orderpriority AS value FROM orders GROUP BY ALL UNION ALL SELECT 'segment', c_mktsegment FROM customer GROUP BY ALL UNION ALL SELECT 'period', strftime(o_orderdate, '%Y-%m') FROM orders GROUP BY ALL")
def filter_options(spark, folder):
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    option = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), value.alias("value")).distinct()
    return option(orders, "priority", F.col("o_orderpriority")).union(option(customer, "segment", F.col("c_mktsegment"))).union(option(orders, "period", F.date_format("o_orderdate", "yyyy-MM")))


@R.add(f"WITH {DECISIONS}, g AS (SELECT member, count(*) AS events, count(DISTINCT case_id) AS cases, round_even(avg(fav), 6)::DOUBLE AS rate FROM dec WHERE cls = '1-URGENT' GROUP BY ALL) SELECT * FROM g ORDER BY events DESC, member LIMIT 10 OFFSET 5")
def entity_listing_page(spark, folder):
    rows = decisions(spark, folder).where(F.col("cls") == "1-URGENT").groupBy("member").agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.bround(F.avg("fav"), 6).alias("rate"))
    return rows.orderBy(F.desc("events"), "member").offset(5).limit(10)


@R.add(f"WITH {DECISIONS} SELECT count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT member) AS members, round_even(avg(price), 6)::DOUBLE AS mean_price, round_even(avg(fav), 6)::DOUBLE AS rate FROM dec WHERE y = 1999")
def dashboard_kpis(spark, folder):
    return decisions(spark, folder).where("y = 1999").agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.count_distinct("member").alias("members"), F.bround(F.avg("price"), 6).alias("mean_price"), F.bround(F.avg("fav"), 6).alias("rate"))


@R.add(f"WITH {DECISIONS} SELECT member, y, count(*) AS events, round_even(avg(fav), 6)::DOUBLE AS rate FROM dec GROUP BY ALL")
def heatmap(spark, folder):
    return decisions(spark, folder).groupBy("member", "y").agg(F.count("*").alias("events"), F.bround(F.avg("fav"), 6).alias("rate"))


@R.add("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def like_search(spark, folder):
    return read_table(spark, folder, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")


@R.add("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE round_even(o_totalprice, 2) END::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders""")
def date_multi_parse(spark, folder):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "dd/MM/yyyy")).when(kind == 2, F.date_format(d, "yyyy/MM/dd")).when(kind == 3, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyyMMdd"))
    money = F.when(kind == 4, "n/a").otherwise(F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    parsed = dates.any_date(shown)
    return read_table(spark, folder, "orders").select("o_orderkey", parsed.alias("parsed"), dates.amount(money).alias("amount"), dates.month_key(parsed).alias("month_key"))


@R.add("SELECT count(*) AS rows, count(*) FILTER (l_orderkey IS NULL) AS no_key, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')) AS orphans FROM lineitem")
def fk_orphans(spark, folder):
    return quality.reference_check(read_table(spark, folder, "lineitem"), "l_orderkey", read_table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'"), "o_orderkey")


@R.add("SELECT 'c_custkey' AS \"column\", count(*) AS rows, count(c_custkey) AS filled, 1.0::DOUBLE AS share FROM customer UNION ALL SELECT 'c_name', count(*), count(nullif(c_name, '')), 1.0 FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment), 1.0 FROM customer")
def column_coverage(spark, folder):
    return quality.coverage(read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@R.add("""WITH a AS (SELECT DISTINCT o_custkey AS k, 'y' || year(o_orderdate) AS part FROM orders WHERE year(o_orderdate) < 1998) SELECT a.part AS "left", b.part AS "right", count(*) AS common FROM a JOIN a b ON a.k = b.k AND a.part < b.part GROUP BY ALL""")
def file_overlap(spark, folder):
    orders = read_table(spark, folder, "orders")
    return quality.overlap({f"y{y}": orders.where(F.year("o_orderdate") == y) for y in (1995, 1996, 1997)}, "o_custkey")


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return quality.duplicates(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def key_set_operations(spark, folder):
    orders = read_table(spark, folder, "orders")
    keys = lambda y: orders.where(F.year("o_orderdate") == y).select("o_custkey")
    return keys(1995).intersect(keys(1996)).subtract(keys(1997))


@R.add("""WITH v AS (SELECT 'c_mktsegment' AS c, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k FROM v WHERE v IS NOT NULL)
SELECT c AS "column", 0::BIGINT AS nulls, count(*) AS distinct_values, max(length(v))::INT AS longest, string_agg(v, '|' ORDER BY k) FILTER (k <= 5) AS commonest, CASE c WHEN 'c_nationkey' THEN 'integer' ELSE 'text' END AS looks_like FROM r GROUP BY c""")
def column_profile(spark, folder):
    return quality.profile(read_table(spark, folder, "customer"), ["c_mktsegment", "c_nationkey"])


@R.add("SELECT * FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR), c_custkey)::INT AS turn FROM customer) WHERE turn <= 10")
def hashed_sample(spark, folder):
    return quality.hashed_sample(read_table(spark, folder, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 10)


@R.add("SELECT floor(l_discount * 100)::BIGINT AS bucket, count(*) AS n, round_even(quantile_cont(l_extendedprice, 0.5), 6)::DOUBLE AS median FROM lineitem GROUP BY ALL")
def score_histogram(spark, folder):
    return read_table(spark, folder, "lineitem").groupBy(F.floor(F.col("l_discount") * 100).alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.percentile("l_extendedprice", F.lit(0.5)), 6).alias("median"))


@R.add("SELECT l_returnflag, l_linestatus, round_even(sum(l_quantity), 2)::DOUBLE AS sum_qty, round_even(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def line_totals(spark, folder):
    return read_table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.bround(F.sum("l_quantity"), 2).alias("sum_qty"), F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@R.add(r"SELECT doc_id, rtrim(ltrim(regexp_replace(lower(strip_accents(source || ' / ' || lang)), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS slug FROM documents")
def document_slugs(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", text.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"))
