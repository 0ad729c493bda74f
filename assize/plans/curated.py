"""Builders and remaining classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.functions import rules, stats, text
from assize.operators import builders, joins, rates
from assize.plans.bindings import DECISIONS, Registry, decisions
from assize.plans.rates import _RARITY, rarity_alerts
from assize.session import read_table

R = Registry()


@R.add("""WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN l_quantity END AS quantity FROM lineitem)
SELECT l_orderkey, arg_min(flag, CASE WHEN flag IS NOT NULL THEN struct_pack(a := l_linenumber, b := l_suppkey, c := l_partkey) END) AS flag, arg_min(quantity, CASE WHEN quantity IS NOT NULL THEN struct_pack(a := l_linenumber, b := l_suppkey, c := l_partkey) END) AS quantity, count(*) AS source_rows FROM f GROUP BY l_orderkey""")
def folded_records(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumns({"flag": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")), "quantity": F.when(F.col("l_quantity") > 25, F.col("l_quantity"))})
    return builders.fold(rows, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], ["flag", "quantity"])


@R.add("""WITH e AS (SELECT p_partkey, unnest([1, 2]) AS k, unnest([p_name, p_type || ' ' || p_brand]) AS name FROM part), c AS (SELECT *, trim(regexp_replace(regexp_replace(upper(name), '[^\\w\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical FROM e)
SELECT 'ent-' || substr(sha256(canonical), 1, 16) AS entity_id, arg_min(name, struct_pack(a := p_partkey, b := k)) AS name, canonical, count(*) AS mentions FROM c GROUP BY canonical""")
def named_entities(spark, folder):
    rows = read_table(spark, folder, "part").withColumn("names", F.array("p_name", F.concat_ws(" ", "p_type", "p_brand")))
    return builders.named_entities(rows, "names", ["p_partkey"], "ent-")


@R.add("""WITH l AS (SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_linenumber > 3 THEN l_returnflag END AS side FROM lineitem) SELECT l_suppkey, l_partkey, side FROM (SELECT *, bool_or(side IS NOT NULL) OVER (PARTITION BY l_suppkey, l_partkey) AS s FROM l) WHERE side IS NOT NULL OR NOT s""")
def sided_links(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("side", F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")))
    return builders.sided_links(rows, ["l_suppkey", "l_partkey"], "side")


@R.add("""WITH r AS (SELECT upper(p_name) AS canonical, p_partkey, CASE WHEN p_size > 25 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS type FROM part)
SELECT canonical, arg_min(brand, CASE WHEN brand IS NOT NULL THEN p_partkey END) AS brand, arg_min(type, CASE WHEN type IS NOT NULL THEN p_partkey END) AS type, count(*) AS records FROM r GROUP BY canonical""")
def merged_entities(spark, folder):
    rows = read_table(spark, folder, "part").withColumns({"brand": F.when(F.col("p_size") > 25, F.col("p_brand")), "type": F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))})
    return builders.merged_entities(rows, "p_name", ["p_partkey"], ["brand", "type"])


@R.add("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN '' ELSE l_returnflag END AS flag, CASE WHEN l_linenumber = 7 THEN '01/02/2020' ELSE '2020-02-01' END AS d FROM lineitem), g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (flag = '') AS lacking, count(*) FILTER (d LIKE '%/%') AS odd FROM r GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, sum(lacking)::BIGINT AS lacking, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated, sum(odd)::BIGINT AS odd_dates FROM g""")
def table_validation(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumns({"flag": F.when(F.col("l_quantity") > 45, "").otherwise(F.col("l_returnflag")), "d": F.when(F.col("l_linenumber") == 7, "01/02/2020").otherwise("2020-02-01")})
    return builders.validate(rows, ["flag"], ["l_orderkey", "l_linenumber"], ["d"])


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT l_partkey::VARCHAR || '/' || l_suppkey) AS contents FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey::VARCHAR || '/' || l_suppkey) > 1")
def conflicting_keys(spark, folder):
    return builders.conflicting_keys(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@R.add(f"""WITH al AS (SELECT * FROM ({_RARITY}) WHERE score >= 0.75), {DECISIONS}, g AS (SELECT theme, y, count(*) FILTER (outcome = 'favorable') AS favorable, count(*) FILTER (outcome = 'unfavorable') AS unfavorable FROM dec GROUP BY ALL)
SELECT al.event_id, score, kind, theme, y, outcome, d, favorable, unfavorable, round_even((favorable + 1.0) / (favorable + unfavorable + 2.0), 6)::DOUBLE AS smoothed_rate, CASE WHEN favorable + unfavorable > 0 THEN round_even(favorable / (favorable + unfavorable), 6) END::DOUBLE AS raw_rate
FROM al JOIN (SELECT event_id, outcome, d FROM dec) e ON e.event_id = al.event_id LEFT JOIN g USING (theme, y)""")
def evidence_bundle(spark, folder):
    """Alerts with their events and group rates."""
    rows = decisions(spark, folder)
    groups = rates.smoothed(rows, ["theme", "y"], "outcome").drop("n", "status")
    return builders.evidence(rarity_alerts(spark, folder).select("event_id", "score", "kind", "theme", "y"), rows.select("event_id", "outcome", "d"), groups, "event_id", ["theme", "y"])


@R.add("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS t FROM documents) WHERE t % 10 = 0")
def systematic_sample(spark, folder):
    return builders.every_nth(read_table(spark, folder, "documents").select("doc_id", "source"), ["doc_id"], 10, "source")


@R.add()
def isolation_rarity(spark, folder):
    return builders.isolation_rarity(decisions(spark, folder), "event_id", ["cls", "y"], ["outcome", "member", "theme"])


@R.add(f"""WITH {DECISIONS}, s AS (SELECT * FROM dec WHERE fav IS NOT NULL), a AS (SELECT avg(fav) AS p0 FROM s), g AS (SELECT member, cls, y, count(*) AS n, avg(fav) AS r FROM s GROUP BY ALL),
z AS (SELECT *, least(p0 + 0.15, 0.999) AS p1 FROM g, a), t AS (SELECT *, greatest(-8.0, least(8.0, (p0 + 1.6448536269514729 * sqrt(p0 * (1 - p0) / n) - p1) / sqrt(p1 * (1 - p1) / n))) AS x FROM z),
c AS (SELECT *, 0.5 - exp(-x * x / 2) / sqrt(2 * pi()) * list_sum([sign(x) * exp((2 * k + 1) * ln(greatest(abs(x), 1e-12)) + k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2)) for k in range(0, 120)]) AS power FROM t)
SELECT member, cls, y, n, round_even(r - p0, 6)::DOUBLE AS delta, round_even(power, 4)::DOUBLE AS power, CASE WHEN power >= 0.8 THEN 'high' WHEN power >= 0.5 THEN 'moderate' ELSE 'low' END AS confidence, round_even(r - p0, 6) > 0.15 AND n >= 3 AS red_flag FROM c""")
def red_flag_power(spark, folder):
    """Rates of members by class and year against the overall rate, and how surely so many rows would show a rise of 0.15."""
    rows = decisions(spark, folder).where("fav is not null")
    overall = rows.agg(F.avg("fav").alias("p0"))
    out = rows.groupBy("member", "cls", "y").agg(F.count("*").alias("n"), F.sum("fav").alias("f")).join(F.broadcast(overall))
    out = out.withColumn("exact", stats.proportion_power(F.col("n"), F.col("p0"))).withColumn("delta", F.bround(F.col("f") / F.col("n") - F.col("p0"), 6))
    return out.select("member", "cls", "y", "n", "delta", F.bround("exact", 4).alias("power"), stats.power_label(F.col("exact")).alias("confidence"), ((F.col("delta") > 0.15) & (F.col("n") >= 3)).alias("red_flag"))


@R.add("""WITH p AS (SELECT l_orderkey AS source_id, p_partkey AS target_id, 0 AS turn, 'part' AS basis FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT l_orderkey, p_partkey, 1, 'supplier' FROM lineitem JOIN part ON l_suppkey = p_partkey UNION ALL SELECT o_orderkey, p_partkey, 2, 'customer' FROM orders JOIN part ON o_custkey = p_partkey)
SELECT source_id, target_id, arg_min(basis, turn) AS basis FROM p GROUP BY ALL""")
def donors_by_path(spark, folder):
    """Orders to parts by three keys in turn, each pair under the first that joins it."""
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_partkey", "l_suppkey")
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("source_id"), "o_custkey")
    target = read_table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_partkey").alias("k"))
    return joins.multi_path([("part", lines, ["l_partkey"]), ("supplier", lines, ["l_suppkey"]), ("customer", orders, ["o_custkey"])], target, "k")


@R.add("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'cpf' WHEN 1 THEN 'cnpj' WHEN 2 THEN 'masked' ELSE 'unknown' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN '12345678901' WHEN c_custkey % 4 = 1 THEN '12345678000199' WHEN c_custkey % 4 = 2 THEN '123' ELSE NULL END AS digits FROM customer")
def document_kinds(spark, folder):
    raw = F.get(F.array(F.lit("123.456.789-01"), F.lit("12.345.678/0001-99"), F.lit("***.123"), F.lit("x")), (F.col("c_custkey") % 4).cast("int"))
    return read_table(spark, folder, "customer").select("c_custkey", rules.document_kind(raw).alias("kind"), text.tax_id(raw).alias("digits"))


