"""Rates, distributions and their tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from assize.operators import rates, risk
from assize.plans.bindings import DECISIONS, Registry, decisions
from assize.session import read_table

R = Registry()
CHI2 = "CASE WHEN df < 1 THEN NULL ELSE CASE WHEN chi2 >= list_extract([10.828,13.816,16.266,18.467,20.515,22.458,24.322,26.125,27.877,29.588,31.264,32.910,34.528,36.123,37.697,39.252,40.790,42.312,43.820,45.315,46.797,48.268,49.728,51.179,52.620,54.052,55.476,56.892,58.301,59.703], df::INT) THEN 0.001 WHEN chi2 >= list_extract([6.635,9.210,11.345,13.277,15.086,16.812,18.475,20.090,21.666,23.209,24.725,26.217,27.688,29.141,30.578,31.999,33.409,34.805,36.191,37.566,38.932,40.289,41.638,42.980,44.314,45.642,46.963,48.278,49.588,50.892], df::INT) THEN 0.01 WHEN chi2 >= list_extract([3.841,5.991,7.815,9.488,11.070,12.592,14.067,15.507,16.919,18.307,19.675,21.026,22.362,23.685,24.996,26.296,27.587,28.869,30.144,31.410,32.671,33.924,35.172,36.415,37.652,38.885,40.113,41.337,42.557,43.773], df::INT) THEN 0.05 ELSE 1.0 END END::DOUBLE AS p_bracket"


@R.add(f"""WITH {DECISIONS}, g AS (SELECT cls, theme, y, count(*) AS n, count(*) FILTER (outcome = 'favorable') AS favorable, count(*) FILTER (outcome = 'unfavorable') AS unfavorable FROM dec GROUP BY ALL)
SELECT *, round_even((favorable + 1.0) / (favorable + unfavorable + 2.0), 6)::DOUBLE AS smoothed_rate, CASE WHEN favorable + unfavorable > 0 THEN round_even(favorable / (favorable + unfavorable), 6) END::DOUBLE AS raw_rate,
  CASE WHEN n < 5 THEN 'insufficient_cases' WHEN n > 5000 THEN 'too_broad' ELSE 'valid' END AS status FROM g""")
def smoothed_rate_by_group(spark, folder):
    return rates.smoothed(decisions(spark, folder), ["cls", "theme", "y"], "outcome")


@R.add(f"""WITH {DECISIONS}, o AS (SELECT cls, theme, y, member, count(*) AS own_n, count(*) FILTER (outcome = 'favorable') AS f, count(*) FILTER (outcome = 'unfavorable') AS u FROM dec GROUP BY ALL),
t AS (SELECT *, sum(own_n) OVER w AS gn, count(*) OVER w AS m, sum(f) OVER w AS af, sum(u) OVER w AS au FROM o WINDOW w AS (PARTITION BY cls, theme, y))
SELECT cls, theme, y, member, own_n, (gn - own_n)::BIGINT AS rest_n, round_even((af - f + 1.0) / (af - f + au - u + 2.0), 6)::DOUBLE AS loo_rate FROM t WHERE m >= 2 AND gn >= 10""")
def loo_rate_by_member(spark, folder):
    return rates.leave_one_out(decisions(spark, folder), ["cls", "theme", "y"], "member", "outcome")


@R.add(f"""WITH {DECISIONS}, o AS (SELECT cls, y, member, outcome, count(*) AS own FROM dec GROUP BY ALL), m AS (SELECT cls, y, member, sum(own) AS r FROM o GROUP BY ALL),
k AS (SELECT * FROM (SELECT cls, y, member, count(*) OVER w AS c, sum(r) OVER w AS t FROM m WINDOW w AS (PARTITION BY cls, y)) WHERE c >= 2 AND t >= 10), t AS (SELECT cls, y, outcome, sum(own) AS total FROM o GROUP BY ALL)
SELECT cls, y, member, outcome, (total - coalesce(own, 0))::BIGINT AS n FROM k JOIN t USING (cls, y) LEFT JOIN o USING (cls, y, member, outcome) WHERE total - coalesce(own, 0) > 0""")
def loo_distribution(spark, folder):
    return rates.leave_one_out_distribution(decisions(spark, folder), ["cls", "y"], "member", "outcome")


@R.add(f"""WITH {DECISIONS}, k AS (SELECT * FROM dec WHERE fav IS NOT NULL), c AS (SELECT cls, theme, member, count(*) AS cell_n, round_even(avg(fav), 6) AS cr FROM k GROUP BY ALL), w AS (SELECT cls, theme, round_even(avg(fav), 6) AS wr FROM k GROUP BY ALL)
SELECT cls, theme, member, cell_n, coalesce(CASE WHEN cell_n >= 10 THEN cr END, wr)::DOUBLE AS rate, CASE WHEN cell_n >= 10 THEN 'cell' ELSE 'coarse' END AS basis FROM c LEFT JOIN w USING (cls, theme)""")
def stratified_baseline_fallback(spark, folder):
    return rates.stratified(decisions(spark, folder), ["cls", "theme", "member"], ["cls", "theme"], "outcome")


_RARITY = f"""WITH {DECISIONS}, dh AS (SELECT *, month(d) <= 6 AS half FROM dec), w AS (SELECT *, count(*) OVER (PARTITION BY theme, y) AS group_n, count(*) OVER (PARTITION BY theme, y, member) AS own_n,
  count(*) OVER (PARTITION BY theme, y, half) AS ah, count(*) OVER (PARTITION BY theme, y, member, half) AS oh, count(*) OVER (PARTITION BY theme, y, outcome) AS ao, count(*) OVER (PARTITION BY theme, y, member, outcome) AS oo,
  count(*) OVER (PARTITION BY theme, y, cls) AS ac, count(*) OVER (PARTITION BY theme, y, member, cls) AS oc, count(*) OVER (PARTITION BY theme, y, cls, outcome) AS ap, count(*) OVER (PARTITION BY theme, y, member, cls, outcome) AS op FROM dh),
m AS (SELECT theme, y, count(DISTINCT member) AS members FROM dec GROUP BY ALL), b AS (SELECT w.*, (members >= 2 AND group_n >= 10) AS wo FROM w JOIN m USING (theme, y) WHERE group_n BETWEEN 5 AND 5000),
s AS (SELECT *, CASE WHEN wo THEN group_n - own_n ELSE group_n END AS base_n, CASE WHEN wo THEN ac - oc ELSE ac END AS cn FROM b),
p AS (SELECT *, (CASE WHEN wo THEN ah - oh ELSE ah END) / base_n AS p1, CASE WHEN cn >= 5 THEN (CASE WHEN wo THEN ap - op ELSE ap END) / cn ELSE (CASE WHEN wo THEN ao - oo ELSE ao END) / base_n END AS p2 FROM s),
l AS (SELECT *, [{{'p': p1, 's': cls = '1-URGENT'}}, {{'p': p2, 's': theme = 'BUILDING' AND cls = '1-URGENT'}}, {{'p': p2, 's': theme = 'BUILDING' AND cls = '1-URGENT'}}] AS every FROM p), k AS (SELECT *, CASE WHEN len(list_filter(every, lambda x: x.p < 0.4)) > 0 THEN list_filter(every, lambda x: x.p < 0.4) ELSE every END AS kept FROM l),
f AS (SELECT *, list_filter(kept, lambda x: NOT x.s) AS rest FROM k), q AS (SELECT *, list_transform(CASE WHEN len(rest) > 0 THEN rest ELSE every END, lambda x: x.p) AS used, len(rest) < len(kept) AS noted FROM f)
SELECT event_id, theme, y, member, group_n::BIGINT AS group_n, base_n::BIGINT AS base_n, len(used)::INT AS dims_used, round_even(1 - list_sum(used) / len(used), 6)::DOUBLE AS score, CASE WHEN base_n < 10 OR len(used) < 2 OR noted THEN 'inconclusive' ELSE 'atypical' END AS kind FROM q"""


@R.add(_RARITY)
def rarity_scores(spark, folder):
    """Outcomes against those of their class in the group, and the half of the year, which a rule explains for urgent cases; one theme's urgent outcomes are explained too."""
    rows = decisions(spark, folder).withColumn("half", F.month("d") <= 6)
    urgent, known = F.col("cls") == "1-URGENT", F.col("theme") == "BUILDING"
    return risk.rarity(rows, "event_id", ["theme", "y"], "member", ["half", "outcome"], "cls", "outcome", {"half": urgent, "outcome": urgent & known, "pair": urgent & known})


@R.add(f"SELECT * FROM ({_RARITY}) WHERE score >= 0.75")
def rarity_alerts(spark, folder):
    return risk.alerts(rarity_scores(spark, folder))


@R.add("""WITH h AS (SELECT l_returnflag, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, p_type)::INT AS rank FROM h) WHERE rank <= 5""")
def value_histogram(spark, folder):
    lines = read_table(spark, folder, "lineitem").join(read_table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    return rates.histogram(lines, ["l_returnflag"], "p_type", 5)


@R.add("""WITH h AS (SELECT l_suppkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY l_suppkey, n) > 1 AS tied FROM h)
SELECT l_suppkey, v AS modal_value, n, tied FROM r WHERE k = 1""")
def mode_with_ties(spark, folder):
    return rates.mode(read_table(spark, folder, "lineitem"), ["l_suppkey"], "l_returnflag")


@R.add(f"""WITH {DECISIONS}, o AS (SELECT cls, y, member, count(*) AS n FROM dec GROUP BY ALL), g AS (SELECT cls, y, sum(n)::BIGINT AS total, count(*) AS members, sum(n * n) AS sq, arg_max(member, struct_pack(n := n, m := member)) AS most_common FROM o GROUP BY ALL),
c AS (SELECT cls, y, total, members, most_common, round_even((sq * members)::DOUBLE / total - total, 6) AS chi2, members - 1 AS df FROM g WHERE total >= 50 AND members >= 2) SELECT *, {CHI2} FROM c""")
def chi2_uniformity(spark, folder):
    return rates.uniformity(decisions(spark, folder), ["cls", "y"], "member")


@R.add(f"""WITH {DECISIONS}, o AS (SELECT cls, member, outcome, count(*) AS obs FROM dec GROUP BY ALL), t AS (SELECT *, sum(vn) OVER (PARTITION BY cls) AS gn FROM (SELECT cls, outcome, sum(obs) AS vn FROM o GROUP BY ALL)), m AS (SELECT cls, member, sum(obs) AS mn FROM o GROUP BY ALL),
d AS (SELECT m.cls, m.member, t.outcome, mn, vn, gn, coalesce(obs, 0) AS obs FROM m JOIN t USING (cls) LEFT JOIN o ON o.cls = m.cls AND o.member = m.member AND o.outcome = t.outcome WHERE gn >= 30),
p AS (SELECT *, (obs - vn::DOUBLE * mn / gn) ** 2 / (vn::DOUBLE * mn / gn) AS part, round_even(obs / mn - vn / gn, 9) AS delta FROM d),
c AS (SELECT cls, member, any_value(mn)::BIGINT AS member_n, round_even(sum(part), 6)::DOUBLE AS chi2, count(*) - 1 AS df, arg_max(outcome, struct_pack(a := abs(delta), o := outcome)) AS direction, round_even(arg_max(delta, struct_pack(a := abs(delta), o := outcome)), 6)::DOUBLE AS direction_delta FROM p GROUP BY cls, member)
SELECT *, {CHI2} FROM c""")
def chi2_vs_group(spark, folder):
    return rates.against_group(decisions(spark, folder), ["cls"], "member", "outcome")


@R.add(f"""WITH {DECISIONS}, p AS (SELECT member, case_id AS counsel, cls, count(DISTINCT event_id) AS cases, count(fav) AS n, coalesce(sum(fav), 0) AS f FROM dec GROUP BY ALL), a AS (SELECT member, cls, count(fav) AS an, coalesce(sum(fav), 0) AS af FROM dec GROUP BY ALL), b AS (SELECT case_id AS counsel, cls, count(fav) AS bn, coalesce(sum(fav), 0) AS bf FROM dec GROUP BY ALL),
s AS (SELECT member, counsel, sum(cases)::BIGINT AS cases, sum(n) AS n, sum(f) AS f, sum(an) AS an, sum(af) AS af, sum(bn) AS bn, sum(bf) AS bf FROM p JOIN a USING (member, cls) JOIN b USING (counsel, cls) GROUP BY ALL),
r AS (SELECT member, counsel, cases, round_even(f / n, 6)::DOUBLE AS rate, round_even(f / n - af / an, 6)::DOUBLE AS delta_left, round_even(f / n - bf / bn, 6)::DOUBLE AS delta_right FROM s WHERE cases >= 2 AND n > 0)
SELECT *, cases >= 5 AND delta_left > 0.15 AND delta_right > 0.15 AS red_flag FROM r""")
def affinity_pairs(spark, folder):
    rows = decisions(spark, folder).withColumnRenamed("case_id", "counsel")
    return risk.affinity(rows, "member", "counsel", "cls", "event_id", "fav")


@R.add(f"""WITH {DECISIONS}, l AS (SELECT l_suppkey AS holder, case_id, member, outcome FROM lineitem JOIN dec ON l_orderkey = event_id), g AS (SELECT member, case_id % 7 AS role, avg(CASE outcome WHEN 'favorable' THEN 1.0 WHEN 'unfavorable' THEN 0.0 END) AS raw, avg(CASE outcome WHEN 'favorable' THEN CASE WHEN case_id % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 'unfavorable' THEN CASE WHEN case_id % 2 = 0 THEN 0.0 ELSE 1.0 END END) AS aware FROM l GROUP BY ALL)
SELECT member, role, round_even(raw, 6)::DOUBLE AS raw_rate, round_even(aware, 6)::DOUBLE AS role_rate FROM g""")
def role_aware_rate(spark, folder):
    from assize.functions.rules import outcome_for_party

    rows = decisions(spark, folder).join(read_table(spark, folder, "lineitem").select("l_orderkey"), F.expr("l_orderkey = event_id"))
    role = F.when(F.col("case_id") % 2 == 0, "RECTE.(S)").otherwise("RECDO.(A/S)")
    mine = rows.withColumn("mine", outcome_for_party(F.col("outcome"), role))
    return mine.groupBy("member", (F.col("case_id") % 7).alias("role")).agg(F.bround(rates.favorable_rate(F.col("outcome")), 6).alias("raw_rate"), F.bround(rates.favorable_rate(F.col("mine")), 6).alias("role_rate"))


@R.add("""WITH s AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS a FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, coalesce(sum(a) FILTER (l_returnflag = 'A' AND l_linestatus = 'F'), 0) AS a, coalesce(sum(a) FILTER (l_returnflag = 'R' AND l_linestatus = 'F'), 0) AS b, coalesce(sum(a) FILTER (l_returnflag = 'A' AND l_linestatus = 'O'), 0) AS c, coalesce(sum(a) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'), 0) AS d FROM s GROUP BY ALL)
SELECT l_suppkey, CASE WHEN b * c = 0 THEN 'inf'::DOUBLE ELSE round_even((a * d)::DOUBLE / (b * c)::DOUBLE, 6) END AS odds FROM r""")
def odds_ratio_by_supplier(spark, folder):
    from assize.functions.stats import odds_ratio

    cell = lambda f, s: F.count_if((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s))
    rows = read_table(spark, folder, "lineitem").groupBy("l_suppkey").agg(cell("A", "F").alias("a"), cell("R", "F").alias("b"), cell("A", "O").alias("c"), cell("R", "O").alias("d"))
    return rows.select("l_suppkey", odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("odds"))


@R.add("""WITH l AS (SELECT doc_id, quality, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM l)
SELECT sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg, round_even((sum(quality * r) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)::DOUBLE), 6)::DOUBLE AS auroc, round_even(sum(quality * x) / sum(quality) - sum((1 - quality) * x) / sum(1 - quality), 6)::DOUBLE AS separation FROM k""")
def ranking_metrics(spark, folder):
    rows = read_table(spark, folder, "labels").join(read_table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return risk.ranking_metrics(rows, "n_chars", "quality")
