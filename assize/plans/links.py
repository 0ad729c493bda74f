"""Sanction routes, typed edges and cheapest paths, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import routes
from assize.plans.bindings import Registry
from assize.session import read_table

R = Registry()


@R.add("""WITH own AS (SELECT DISTINCT l_suppkey AS seed, o_custkey AS bridge, CASE l_returnflag WHEN 'A' THEN 'exact_cnpj_basico' WHEN 'R' THEN 'exact_partner_cnpj' ELSE 'exact_partner_cpf' END AS basis FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT own.*, c_nationkey AS grp FROM own JOIN customer ON c_custkey = bridge), sz AS (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY ALL),
gate AS (SELECT seed, count(DISTINCT bridge) + (SELECT sum(n) FROM sz WHERE grp IN (SELECT grp FROM g h WHERE h.seed = g.seed)) AS reach FROM g GROUP BY seed),
far AS (SELECT m.seed, m.grp, c_mktsegment AS entity, min(c_custkey) AS via FROM (SELECT DISTINCT seed, grp FROM g) m JOIN gate USING (seed) JOIN customer ON c_nationkey = m.grp WHERE reach <= 5000 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.seed = m.seed AND o.bridge = c_custkey) GROUP BY ALL),
e AS (SELECT seed, bridge, basis, c_mktsegment AS entity, 2 AS degree, bridge AS via FROM own JOIN customer ON c_custkey = bridge UNION ALL SELECT g.seed, bridge, basis, entity, 3, via FROM g JOIN far ON far.seed = g.seed AND far.grp = g.grp),
b AS (SELECT seed, bridge, basis, entity, min(degree)::INT AS degree, arg_min(via, struct_pack(d := degree, v := via)) AS via FROM e GROUP BY ALL)
SELECT seed, bridge, basis, entity, degree, via, reach::BIGINT AS reach, reach > 5000 AS truncated, concat_ws(' > ', seed, basis, bridge, CASE WHEN degree > 2 THEN via::VARCHAR END, entity) AS route,
  'scl-' || substr(sha256(seed || ':' || bridge || ':' || entity || ':' || basis), 1, 16) AS route_id FROM b JOIN gate USING (seed)""")
def sanction_routes(spark, folder):
    """Suppliers as sanctioned seeds, their customers as companies, nations as groups, segments as entities."""
    lines, orders, customers = (read_table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    basis = F.when(F.col("l_returnflag") == "A", "exact_cnpj_basico").when(F.col("l_returnflag") == "R", "exact_partner_cnpj").otherwise("exact_partner_cpf")
    bridges = lines.join(orders, F.expr("l_orderkey = o_orderkey")).select(F.col("l_suppkey").alias("seed"), F.col("o_custkey").alias("bridge"), basis.alias("basis"))
    groups = customers.select(F.col("c_custkey").alias("company"), F.col("c_nationkey").alias("group"))
    return routes.sanction_routes(bridges, groups, customers.select(F.col("c_custkey").alias("company"), F.col("c_mktsegment").alias("entity")))


_EDGES = """r AS (SELECT CASE WHEN s_acctbal < 0 THEN 'firm' WHEN s_acctbal < 2000 THEN 'counsel' WHEN s_acctbal < 5000 THEN 'lawyer' ELSE 'counsel' END AS kind, s_suppkey, s_nationkey FROM supplier),
pn AS (SELECT DISTINCT l_partkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
nb AS (SELECT c_nationkey, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
ns AS (SELECT n_regionkey, n_nationkey, count(DISTINCT c_mktsegment) AS signals FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
raw AS (
  SELECT CASE WHEN kind = 'firm' THEN 'firm_represents_party' ELSE 'counsel_represents_party' END AS kind, CASE WHEN kind = 'firm' THEN 'law_firm:' ELSE 'counsel:' END || s_suppkey AS src, 'party:' || s_nationkey AS dst, s_suppkey::VARCHAR AS key, 'deterministic' AS strength, 'strict_allowed' AS policy, false AS truncated, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS cost FROM r
  UNION ALL SELECT DISTINCT 'case_has_counsel', 'case:' || l_partkey, 'counsel:' || l_suppkey, l_partkey || '/' || l_suppkey, 'deterministic', 'strict_allowed', false, 1.0, 1.0 FROM lineitem
  UNION ALL SELECT 'case_has_party', 'case:' || l_partkey, 'party:' || c_nationkey, l_partkey || '/' || c_nationkey, 'deterministic', 'strict_allowed', false, 1.0, 1.0 FROM pn
  UNION ALL SELECT 'minister_linked_to_company', 'case:' || p_partkey, 'economic_group:' || p_brand, p_partkey::VARCHAR, CASE WHEN p_size % 2 = 0 THEN 'deterministic' ELSE 'statistical' END, CASE WHEN p_size > 25 THEN 'broad_only' ELSE 'strict_allowed' END, p_size > 25, CASE WHEN p_retailprice = 900 THEN 1.0 ELSE p_retailprice - 900 END, CASE WHEN p_size > 25 THEN 2.0 ELSE 1.0 END FROM part
  UNION ALL SELECT 'sanction_links_corporate_path', 'party:' || c_nationkey, 'economic_group:' || p_brand, c_nationkey || '/' || p_brand, CASE WHEN n % 3 = 2 THEN 'truncated' ELSE 'statistical' END, 'broad_only', n % 3 = 2, 1.0, CASE WHEN n % 3 = 2 THEN 3.0 ELSE 2.0 END FROM nb
  UNION ALL SELECT 'sanction_hits_entity', 'sanction:' || s_suppkey, 'party:' || s_nationkey, s_suppkey::VARCHAR, CASE WHEN s_acctbal >= 3000 THEN 'deterministic' ELSE 'statistical' END, 'strict_allowed', false, 1.0, 1.0 FROM supplier
  UNION ALL SELECT 'donation_associated_with_entity', 'donation:' || c_custkey, 'party:' || c_nationkey, c_custkey::VARCHAR, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN 'deterministic' ELSE 'statistical' END, 'strict_allowed', false, CASE WHEN c_acctbal = 0 THEN 1.0 ELSE c_acctbal END, 1.0 FROM customer
  UNION ALL SELECT 'case_has_compound_signal', 'case:region-' || n_regionkey, 'party:' || n_nationkey, n_nationkey::VARCHAR, 'composite', 'broad_only', false, CASE WHEN signals = 0 THEN 1 ELSE signals END, 1.0::DOUBLE / CASE WHEN signals = 0 THEN 1 ELSE signals END FROM ns),
edges AS (SELECT 'ge-' || substr(sha256(kind || ':' || key || ':' || dst), 1, 16) AS edge_id, src, dst, kind, strength, policy, truncated, weight::DOUBLE AS weight, cost::DOUBLE AS cost FROM raw)"""


@R.add(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark, folder):
    """Nine kinds of edges: suppliers as counsel, firms and sanctions, parts as cases, nations as parties, brands as groups."""
    lines, orders, customers, parts, suppliers, nations = (read_table(spark, folder, t) for t in ("lineitem", "orders", "customer", "part", "supplier", "nation"))
    c = F.col
    sold = lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(customers, F.expr("o_custkey = c_custkey"))
    balance = c("s_acctbal")
    kind = F.when(balance < 0, "firm").when(balance < 2000, None).when(balance < 5000, "lawyer").otherwise("counsel")
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    parties = sold.select("l_partkey", "c_nationkey").distinct()
    brands = sold.join(parts, F.expr("p_partkey = l_partkey")).groupBy("c_nationkey", "p_brand").agg(F.count("*").alias("n"))
    signals = nations.join(customers, F.expr("c_nationkey = n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count_distinct("c_mktsegment").alias("signals"))
    key = lambda a, b: F.concat_ws("/", a, b)
    made = [
        routes.representation_edges(suppliers, kind, c("s_suppkey"), c("s_suppkey"), c("s_nationkey"), c("s_suppkey")),
        routes.typed_edges(pairs, "case_has_counsel", routes.node_id("case", c("l_partkey")), routes.node_id("counsel", c("l_suppkey")), key("l_partkey", "l_suppkey"), "deterministic"),
        routes.typed_edges(parties, "case_has_party", routes.node_id("case", c("l_partkey")), routes.node_id("party", c("c_nationkey")), key("l_partkey", "c_nationkey"), "deterministic"),
        routes.company_edges(parts, c("p_partkey"), c("p_brand"), F.when(c("p_size") > 25, 2).otherwise(1), F.when(c("p_size") % 2 == 0, "party").otherwise("counsel"), c("p_retailprice") - 900, c("p_partkey")),
        routes.sanction_path_edges(brands, c("c_nationkey"), c("p_brand"), F.when(c("n") % 3 == 2, 3).when(c("n") % 3 == 1, 2), F.lit(None).cast("double"), key("c_nationkey", "p_brand")),
        routes.sanction_edges(suppliers, c("s_suppkey"), c("s_nationkey"), F.when(balance >= 3000, "TAX_ID").when(balance >= 0, "exact")),
        routes.donation_edges(customers, c("c_custkey"), c("c_nationkey"), F.when(c("c_acctbal") < 0, "  ").when(c("c_acctbal") <= 9000, c("c_name")), c("c_acctbal")),
        routes.signal_edges(signals, F.concat(F.lit("region-"), "n_regionkey"), c("n_nationkey"), c("signals"), c("n_nationkey")),
    ]
    out = made[0]
    for part in made[1:]:
        out = out.union(part)
    return out


def _paths_sql(cost: str, strict: bool) -> str:
    parts = [f"""WITH {_EDGES}, allowed AS MATERIALIZED (SELECT * FROM edges {"WHERE policy = 'strict_allowed' AND NOT truncated" if strict else ""}),
steps AS MATERIALIZED (SELECT node, next, arg_min(struct_pack(c := cost, k := kind, t := truncated), struct_pack(c := cost, e := edge_id)) AS s FROM (SELECT src AS node, dst AS next, * FROM allowed UNION ALL SELECT dst, src, * FROM allowed) GROUP BY ALL),
k0 AS (SELECT 'sanction:' || s_suppkey AS start, 'sanction:' || s_suppkey AS node, 0.0::DOUBLE AS cost, 0 AS hops, 'sanction:' || s_suppkey AS path, '' AS kinds, false AS truncated FROM supplier), f0 AS (FROM k0)"""]
    for k in range(1, 5):
        parts.append(f"""m{k} AS (SELECT start, next AS node, cost + s.c AS cost, path || ' > ' || next AS path, CASE WHEN kinds = '' THEN s.k ELSE kinds || ',' || s.k END AS kinds, truncated OR s.t AS truncated FROM f{k - 1} JOIN steps USING (node) WHERE cost + s.c <= {cost}),
f{k} AS MATERIALIZED (SELECT b.start, b.node, b.x.c AS cost, {k} AS hops, b.x.p AS path, b.x.k AS kinds, b.x.t AS truncated FROM (SELECT start, node, arg_min(struct_pack(c := cost, p := path, k := kinds, t := truncated), struct_pack(c := cost, p := path)) AS x FROM m{k} GROUP BY ALL) b
  LEFT JOIN (SELECT start, node, min(cost) AS least FROM k{k - 1} GROUP BY ALL) l ON l.start = b.start AND l.node = b.node WHERE least IS NULL OR b.x.c < least), k{k} AS MATERIALIZED (FROM k{k - 1} UNION ALL FROM f{k})""")
    return ",\n".join(parts) + """
SELECT start, node AS "end", row_number() OVER (PARTITION BY start, node ORDER BY cost, hops, path)::INT AS rank, round_even(cost, 6)::DOUBLE AS cost, hops::INT AS hops, kinds, truncated, path FROM k4 WHERE hops > 0 AND node IN (SELECT 'economic_group:' || p_brand FROM part)"""


def _paths(spark, folder, **how):
    starts = read_table(spark, folder, "supplier").select(routes.node_id("sanction", F.col("s_suppkey")).alias("node"))
    ends = read_table(spark, folder, "part").select(routes.node_id("economic_group", F.col("p_brand")).alias("node"))
    return routes.cheapest_paths(graph_edges(spark, folder), starts, ends, hops=4, **how)


@R.add(_paths_sql("3.5", False))
def cheapest_paths_broad(spark, folder):
    """From every sanction to the groups it reaches at a cost of 3.5, in four steps."""
    return _paths(spark, folder, most_cost=3.5)


@R.add(_paths_sql("4", True))
def cheapest_paths_strict(spark, folder):
    return _paths(spark, folder, most_cost=4.0, policy=routes.STRICT)


@R.add(f"""WITH {_EDGES}, d AS (SELECT edge_id, src AS node FROM edges UNION SELECT edge_id, dst FROM edges), c AS (SELECT node, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT 'party:' || s_nationkey AS node, arg_min(s_suppkey, struct_pack(p := -s_acctbal, s := s_suppkey)) AS score_id, max(s_acctbal) AS priority FROM supplier GROUP BY ALL),
b AS (SELECT 'party:' || c_nationkey AS node, min(c_custkey) AS bundle_id, arg_min(length(c_mktsegment), c_custkey) AS signals FROM customer WHERE c_acctbal > 5000 GROUP BY ALL),
n AS (SELECT 'party:' || n_nationkey AS node, n_name AS label FROM nation UNION ALL SELECT 'case:' || p_partkey, p_name FROM part UNION ALL SELECT 'case:none', 'no edges')
SELECT node, label, coalesce(c.n, 0) AS edge_count, score_id, priority, bundle_id, coalesce(signals, 0)::INT AS signal_count FROM n LEFT JOIN c USING (node) LEFT JOIN s USING (node) LEFT JOIN b USING (node)""")
def graph_explained(spark, folder):
    party = lambda c: routes.node_id("party", F.col(c)).alias("node")
    nations, parts = read_table(spark, folder, "nation"), read_table(spark, folder, "part")
    nodes = nations.select(party("n_nationkey"), F.col("n_name").alias("label")).union(parts.select(routes.node_id("case", F.col("p_partkey")), "p_name")).union(nations.limit(1).select(F.lit("case:none"), F.lit("no edges")))
    scores = read_table(spark, folder, "supplier").select(party("s_nationkey"), F.col("s_suppkey").alias("score_id"), F.col("s_acctbal").alias("priority"))
    bundles = read_table(spark, folder, "customer").where("c_acctbal > 5000").select(party("c_nationkey"), F.col("c_custkey").alias("bundle_id"), F.length("c_mktsegment").alias("signals"))
    return routes.explained(nodes, graph_edges(spark, folder), scores, bundles)
