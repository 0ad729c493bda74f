"""Routes: sanctions to entities through companies, typed edges, and cheapest paths along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.functions.text import stable_id
from assize.session import cut

# Fixed value: companies a sanction is followed through at most.
MOST_COMPANIES = 5000


def sanction_routes(bridges: DataFrame, groups: DataFrame, holders: DataFrame, limit: int = MOST_COMPANIES) -> DataFrame:
    """Every route from a seed over a bridge to an entity, once: (seed, bridge, basis, entity, degree, via, reach, truncated, route, route_id).

    ``bridges`` (seed, bridge, basis) are companies that a seed meets, on what grounds; ``groups`` (company, group) has a row a
    company; ``holders`` (company, entity). An entity of the bridge itself is of degree 2; one of another company of the
    bridge's group is of degree 3, unless that company is a bridge of the seed's own. ``reach`` counts the seed's bridges and
    the companies of the groups they belong to; beyond ``limit`` the seed is truncated and its groups are not expanded. Of
    several routes of one (seed, bridge, basis, entity) that of the least degree stays, then that of the least company.

    What a group's entities are is found once a seed and group, with the least company of each, before bridges multiply them.
    """
    own = cut(bridges.select("seed", "bridge", "basis").distinct())
    grouped = own.join(groups.select(F.col("company").alias("bridge"), "group"), "bridge", "left")
    met = grouped.where("group is not null").select("seed", "group").distinct()
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    wide = met.join(sizes, "group").groupBy("seed").agg(F.sum("size").alias("wide"))
    gate = own.groupBy("seed").agg(F.count_distinct("bridge").alias("own")).join(wide, "seed", "left")
    gate = cut(gate.select("seed", (F.col("own") + F.coalesce("wide", F.lit(0))).alias("reach")))
    direct = own.join(holders.withColumnRenamed("company", "bridge"), "bridge").select("seed", "bridge", "basis", "entity", F.lit(2).alias("degree"), F.col("bridge").alias("via"))
    members = met.join(gate.where(F.col("reach") <= limit), "seed").join(groups, "group").select("seed", "group", "company")
    fresh = members.join(own.select("seed", F.col("bridge").alias("company")).distinct(), ["seed", "company"], "left_anti")
    reached = fresh.join(holders, "company").groupBy("seed", "group", "entity").agg(F.min("company").alias("via"))
    far = grouped.join(reached, ["seed", "group"]).select("seed", "bridge", "basis", "entity", F.lit(3).alias("degree"), "via")
    best = direct.union(far).groupBy("seed", "bridge", "basis", "entity").agg(F.min(F.struct("degree", "via")).alias("b")).join(gate, "seed")
    route = F.concat_ws(" > ", F.col("seed").cast("string"), "basis", F.col("bridge").cast("string"), F.when(F.col("b.degree") > 2, F.col("b.via").cast("string")), F.col("entity").cast("string"))
    identity = F.concat_ws(":", F.col("seed").cast("string"), F.col("bridge").cast("string"), F.col("entity").cast("string"), "basis")
    return best.select("seed", "bridge", "basis", "entity", "b.degree", "b.via", "reach", (F.col("reach") > limit).alias("truncated"), route.alias("route"), stable_id("scl-", identity).alias("route_id"))


# Kinds of edges, and what they are worth where a source does not say.
EDGE_KINDS = ("counsel_represents_party", "firm_represents_party", "case_has_counsel", "case_has_party", "minister_linked_to_company", "sanction_links_corporate_path", "sanction_hits_entity", "donation_associated_with_entity", "case_has_compound_signal")
STRICT, BROAD = "strict_allowed", "broad_only"
_EDGE_COLUMNS = ["edge_id", "src", "dst", "kind", "strength", "policy", "truncated", "weight", "cost"]


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def typed_edges(rows: DataFrame, kind: str, src: Column, dst: Column, key: Column, strength: Column | str, policy: Column | str = STRICT, truncated: Column | None = None, weight: Column | None = None, cost: Column | None = None) -> DataFrame:
    """Rows as edges of one kind; edges without both ends are left out. A weight that is null or 0 counts as 1."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    weighed = F.coalesce(F.when(weight != 0, weight), F.lit(1.0)) if weight is not None else F.lit(1.0)
    edges = rows.select(
        stable_id("ge-", F.concat_ws(":", F.lit(kind), key.cast("string"), dst)).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), text(strength).alias("strength"), text(policy).alias("policy"),
        F.coalesce(truncated, F.lit(False)).alias("truncated") if truncated is not None else F.lit(False).alias("truncated"), weighed.cast("double").alias("weight"), (cost if cost is not None else F.lit(1.0)).cast("double").alias("cost"),
    )
    return edges.where("src is not null and dst is not null").select(*_EDGE_COLUMNS)


def representation_edges(rows: DataFrame, kind: Column, person: Column, firm: Column, party: Column, key: Column) -> DataFrame:
    """Edges of people or of firms to the party they stand for, by the kind of representative."""
    counsel = F.coalesce(kind, F.lit("counsel")).isin("lawyer", "counsel")
    people = typed_edges(rows.where(counsel), "counsel_represents_party", node_id("counsel", person), node_id("party", party), key, "deterministic")
    return people.union(typed_edges(rows.where(~counsel), "firm_represents_party", node_id("law_firm", firm), node_id("party", party), key, "deterministic"))


def company_edges(rows: DataFrame, case: Column, company: Column, degree: Column, entity_kind: Column, risk: Column, key: Column) -> DataFrame:
    """A case and the company that its judge is linked to; beyond one step such a link is truncated, and for broad search only."""
    indirect = degree > 1
    return typed_edges(rows, "minister_linked_to_company", node_id("case", case), node_id("economic_group", company), key, F.when(entity_kind == "party", "deterministic").otherwise("statistical"), F.when(indirect, BROAD).otherwise(STRICT), indirect, risk, degree)


def sanction_path_edges(rows: DataFrame, entity: Column, company: Column, degree: Column, risk: Column, key: Column) -> DataFrame:
    """An entity and the company by which a sanction reaches it; of degree 2 where nothing is said, truncated beyond."""
    steps = F.coalesce(F.when(degree != 0, degree), F.lit(2))
    return typed_edges(rows, "sanction_links_corporate_path", node_id("party", entity), node_id("economic_group", company), key, F.when(steps > 2, "truncated").otherwise("statistical"), BROAD, steps > 2, risk, steps)


def sanction_edges(rows: DataFrame, match: Column, entity: Column, strategy: Column) -> DataFrame:
    """A sanction and the entity it hits; matches by an identifier are deterministic."""
    by_id = F.coalesce(F.lower(strategy).rlike("tax_id|cpf|cnpj"), F.lit(False))
    return typed_edges(rows, "sanction_hits_entity", node_id("sanction", match), node_id("party", entity), match, F.when(by_id, "deterministic").otherwise("statistical"))


def donation_edges(rows: DataFrame, match: Column, entity: Column, document: Column, total: Column) -> DataFrame:
    """A donation and the entity it is matched to; those with a document are deterministic."""
    known = F.coalesce(F.trim(document) != "", F.lit(False))
    return typed_edges(rows, "donation_associated_with_entity", node_id("donation", match), node_id("party", entity), match, F.when(known, "deterministic").otherwise("statistical"), weight=total)


def signal_edges(rows: DataFrame, member: Column, entity: Column, signals: Column, key: Column) -> DataFrame:
    """A member's cases and an entity with several signals; the more signals, the cheaper."""
    weight = F.coalesce(F.when(signals != 0, signals), F.lit(1)).cast("double")
    return typed_edges(rows, "case_has_compound_signal", node_id("case", member), node_id("party", entity), key, "composite", BROAD, weight=weight, cost=F.when(weight > 0, 1.0 / weight).otherwise(1.0))


#: Tables of no more rows than this meet others through a broadcast.
SMALL = 200_000


def _small(df: DataFrame) -> DataFrame:
    """A table that is cut already, marked for broadcast if it is counted small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def cheapest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int = 4, most_cost: float = 6.0, policy: str = BROAD) -> DataFrame:
    """Paths from ``starts`` (node) to ``ends`` (node), cheapest first: (start, end, rank, cost, hops, kinds, truncated, path).

    Edges are walked either way; under the strict policy only those that allow it and are whole. A state is (start, node, hops);
    of its paths the cheapest stays, the first in order of text where costs are equal, and it is dropped where fewer hops
    cost no more. Costs are above zero, so a path that meets a node twice is dropped by that rule. Every round joins the
    states that are new, and states are aggregated as they are made.

    Starts whose only way out is the same step share one search, that of the least of them. The last step leads to an end and
    the one before to an end or to where one step more leads to one within the cost; other states lead nowhere and are not made.
    """
    allowed = edges.where("cost > 0") if policy == BROAD else edges.where((F.col("policy") == STRICT) & ~F.col("truncated") & (F.col("cost") > 0))
    step = F.struct("cost", "edge_id", "kind", "truncated").alias("step")
    both = allowed.select(F.col("src").alias("node"), F.col("dst").alias("next"), step).union(allowed.select(F.col("dst").alias("node"), F.col("src").alias("next"), step)).where("node <> next")
    goals = cut(ends.select("node").distinct())
    last = both.join(_small(goals.withColumnRenamed("node", "next")), "next").select("node", "next", "step")
    nearest = last.groupBy("node").agg(F.min("step.cost").alias("rest")).union(goals.withColumn("rest", F.lit(0.0)))
    near = _small(cut(nearest.groupBy(F.col("node").alias("next")).agg(F.min("rest").alias("rest"))))
    out = ["start", "node", "cost", "hops", "path", "kinds", "truncated"]
    frontier = starts.where("node is not null").select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.col("node").alias("path"), F.lit("").alias("kinds"), F.lit(False).alias("truncated")).distinct()
    frontier = cut(frontier)
    known = led = None
    for hop in range(1, hops + 1):
        cost, kind = F.col("cost") + F.col("step.cost"), F.concat_ws(",", F.when(F.col("kinds") != "", F.col("kinds")), F.col("step.kind"))
        ways = last if hop == hops else both.join(near, "next") if hop == hops - 1 else both
        # a bound by what is left may differ by rounding from the sum along the path
        within = (cost <= most_cost) & (cost + F.col("rest") <= most_cost + 1e-6) if hop == hops - 1 else cost <= most_cost
        made = _small(frontier).join(ways, "node").where(within).select("start", F.col("next").alias("node"), cost.alias("cost"), F.concat("path", F.lit(" > "), "next").alias("path"), "step", kind.alias("kinds"), (F.col("truncated") | F.col("step.truncated")).alias("truncated"))
        # of edges between the same nodes the first by cost and id counts
        best = made.groupBy("start", "node").agg(F.min(F.struct("cost", "path", "step", "kinds", "truncated")).alias("b"))
        if hop > 1:
            before = known.groupBy("start", "node").agg(F.min("cost").alias("least"))
            best = best.join(before, ["start", "node"], "left").where("least is null or b.cost < least")
        frontier = best.select("start", "node", "b.cost", F.lit(hop).alias("hops"), "b.path", "b.kinds", "b.truncated")
        if hop == 1:
            first = cut(frontier)
            way = F.struct("node", "cost", "kinds", "truncated")
            lone = first.groupBy("start").agg(F.count("*").alias("n"), F.min(way).alias("way"))
            leads = lone.where("n = 1").groupBy("way").agg(F.min("start").alias("lead"))
            led = cut(lone.withColumn("way", F.when(F.col("n") == 1, F.col("way"))).join(leads, "way", "left").select("start", F.coalesce("lead", "start").alias("lead")))
            frontier = first.join(led.where("start = lead").select("start"), "start").select(out)
        frontier = cut(frontier)
        if not frontier.take(1):
            break
        known = frontier if known is None else known.union(frontier)
    if known is None:
        known = frontier
    reached = known.join(_small(goals), "node").withColumnRenamed("start", "lead")
    # a path back to its start costs more than none
    found = led.join(reached, "lead").where("start <> node").withColumn("path", F.concat("start", F.expr("substring(path, length(lead) + 1)"))).select(out)
    rank = F.row_number().over(W.partitionBy("start", "node").orderBy("cost", "hops", "path"))
    return found.select("start", F.col("node").alias("end"), rank.alias("rank"), F.bround("cost", 6).alias("cost"), "hops", "kinds", "truncated", "path")


def explained(nodes: DataFrame, edges: DataFrame, scores: DataFrame, bundles: DataFrame) -> DataFrame:
    """What is known of every node: its label, its edges by end, its best score and the signals of its first bundle.

    ``nodes`` (node, label), ``scores`` (node, score_id, priority), ``bundles`` (node, bundle_id, signals).
    """
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("edge_count"))
    best = scores.groupBy("node").agg(F.min(F.struct((-F.col("priority")).alias("least"), "score_id")).alias("s"))
    first = bundles.groupBy("node").agg(F.min(F.struct("bundle_id", "signals")).alias("b"))
    out = nodes.join(ends, "node", "left").join(best, "node", "left").join(first, "node", "left")
    return out.select("node", "label", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "s.score_id", (-F.col("s.least")).alias("priority"), "b.bundle_id", F.coalesce("b.signals", F.lit(0)).alias("signal_count"))
