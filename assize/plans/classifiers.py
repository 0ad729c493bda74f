"""Classifiers over every fixed term and variations of it; the SQL applies the rules to the same texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assize.functions import rules
from assize.plans.bindings import Registry
from assize.session import read_table

R = Registry()

#: How a term is varied: as it is, in upper case, in lower case, after and before other words, with spaces and signs around it.
VARIED = ["{0}", "{1}", "{2}", "x9 {0}", "{1} q7", "  - {0}.  "]


def _varied(terms) -> list[str]:
    return [form.format(t, t.upper(), t.lower()) for t in dict.fromkeys(terms) for form in VARIED] + ["", "zzz", "   "]


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _case(steps, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in steps) + f" ELSE {otherwise} END"


def _said(terms: list[str], key: str) -> Column:
    return F.get(F.array(*[F.lit(t) for t in terms]), (F.col(key) % len(terms)).cast("int"))


def _source(terms: list[str], key: str, table: str) -> str:
    return f"t AS (SELECT {key}, {_list(terms)}[{key} % {len(terms)} + 1] AS said FROM {table})"


LABEL = "trim(regexp_replace(upper(strip_accents(said)), '[^A-Z0-9]+', ' ', 'g'))"
_in = lambda column, terms: f"{column} IN ({', '.join(chr(39) + x + chr(39) for x in sorted({rules._plain(t) for t in terms}))})"

TERMS = _varied([*rules.FAVORABLE, *rules.UNFAVORABLE, *rules.NEUTRAL, *[p for p, _ in rules.OUTCOME_PARTS], *rules.PROCEDURAL, *rules.SUBSTANTIVE])
_OUTCOME = _case([*[(_in("label", terms), name) for terms, name in ((rules.FAVORABLE, "favorable"), (rules.UNFAVORABLE, "unfavorable"), (rules.NEUTRAL, "neutral"))], *[(_any("label", [p]), v) for p, v in rules.OUTCOME_PARTS]])
_MATERIAL = _case([(_any("label", rules.PROVISIONAL), "provisional"), (_any("label", rules.PROCEDURAL), "procedural"), (_any("label", rules.SUBSTANTIVE), "substantive")], "'unknown'")


@R.add(f"WITH {_source(TERMS, 'o_orderkey', 'orders')}, l AS (SELECT *, {LABEL} AS label FROM t) SELECT o_orderkey, {_OUTCOME} AS outcome, {_MATERIAL} AS materiality FROM l")
def outcome_classify(spark, folder):
    progress = _said(TERMS, "o_orderkey")
    return read_table(spark, folder, "orders").select("o_orderkey", rules.outcome(progress).alias("outcome"), rules.materiality(progress).alias("materiality"))


MOVES = _varied([p for _, parts in rules.MOVEMENTS for p in parts] + [p for parts in rules.SIGNALS.values() for p in parts] + ["Plenário: julgamento", "Sessão da Primeira Turma", "2ª turma", "pauta virtual"])
_MOVE = _case([(_any("low", parts), name) for name, parts in rules.MOVEMENTS], "'outros'")
_EVENT = _case([
    (_any("low", rules.SIGNALS["review_return"]), "devolvido_vista"), (_any("low", rules.SIGNALS["review_request"]), "pedido_de_vista"), (_any("low", rules.SIGNALS["agenda_in"]), "pauta_inclusion"), (_any("low", rules.SIGNALS["agenda_out"]), "pauta_withdrawal"),
    ("category = 'pauta'", "pauta_inclusion"), ("category = 'vista'", "pedido_de_vista"), ("category = 'decisao'", "julgamento"),
], "'outros'")
_KIND = _case([("contains(low, 'virtual')", "plenario_virtual"), (_any("low", ("plenário", "pleno", "plenario")), "plenario"), ("regexp_matches(low, '1[ªa]\\s*turma|primeira turma')", "turma_1"), ("regexp_matches(low, '2[ªa]\\s*turma|segunda turma')", "turma_2")])


@R.add(f"""WITH {_source(MOVES, 'event_id', 'events')}, l AS (SELECT *, lower(said) AS low FROM t), c AS (SELECT *, {_MOVE} AS category FROM l)
SELECT event_id, category, {_EVENT} AS session_event, {_KIND} AS session_kind, {_any("low", rules.SIGNALS["redistribution"])} AS is_redistribution, {_any("low", rules.SIGNALS["prevention"])} AS by_prevention FROM c""")
def movement_classify(spark, folder):
    said = _said(MOVES, "event_id")
    return read_table(spark, folder, "events").select("event_id", rules.movement_category(said).alias("category"), rules.session_event(said).alias("session_event"), rules.session_kind(said).alias("session_kind"), rules.signals(said, "redistribution").alias("is_redistribution"), rules.signals(said, "prevention").alias("by_prevention"))


GIFTS = _varied([*rules.RESOURCE_SOURCES, *rules.PAYMENT_METHODS, *rules.PAYMENT_CODES, *[p for _, parts in rules.IN_KIND for p in parts], "#NULO", "Combustível e táxi", "Em espécie", "Fundo Partidário"])
_EDGES = "regexp_replace(trim(regexp_replace(strip_accents(raw), '\\s+', ' ', 'g')), '^[.,;:/\\\\()\\[\\]{}\"''–—-]+|[.,;:/\\\\()\\[\\]{}\"''–—-]+$', '', 'g')"
_GIFT_STEPS = [
    ("raw = ''", "empty/blank/none"), ("raw IN ('#NULO', 'NULO', 'NULL', '#NULO#')", "empty/null_marker/none"), *[(f"raw = '{k}'", f"payment_method/{v}/high") for k, v in rules.PAYMENT_CODES.items()], ("label = ''", "empty/blank/none"),
    *[(f"label = '{k}'", f"source_type/{v}/high") for k, v in rules.RESOURCE_SOURCES.items()], *[(f"label = '{k}'", f"payment_method/{v}/high") for k, v in rules.PAYMENT_METHODS.items()], *[(_any("label", parts), f"in_kind/{name}/medium") for name, parts in rules.IN_KIND],
]


@R.add(f"WITH {_source(GIFTS, 'c_custkey', 'customer')}, r AS (SELECT *, upper(trim(said)) AS raw FROM t), l AS (SELECT *, {_EDGES} AS label FROM r), k AS (SELECT *, string_split({_case(_GIFT_STEPS, chr(39) + 'unknown/unclassified/none' + chr(39))}, '/') AS a FROM l) SELECT c_custkey, a[1] AS category, a[2] AS subtype, a[3] AS confidence FROM k")
def resource_classify(spark, folder):
    kind = rules.resource(_said(GIFTS, "c_custkey"))
    return read_table(spark, folder, "customer").select("c_custkey", kind["category"].alias("category"), kind["subtype"].alias("subtype"), kind["confidence"].alias("confidence"))


PLACES = _varied([*rules.STATE_NAMES, *rules.FEDERAL_REGION, "São Paulo", "PARÁ", "Estado de Mato Grosso do Sul", "Goiás"])
COURTS = ["", "Tribunal de Justiça", "Tribunal Regional Federal", "JUSTICA ESTADUAL", "Varas"]
_NAMES = sorted(rules.STATE_NAMES, key=lambda n: (-len(n), n))
_STATE = _case([*[(f"label = '{s}'", s) for s in rules.STATES], *[(f"label = '{n}'", rules.STATE_NAMES[n]) for n in _NAMES], *[(f"contains(label, '{n}')", rules.STATE_NAMES[n]) for n in _NAMES]])
_REGION = _case([(f"state = '{k}'", f"trf{v}") for k, v in rules.FEDERAL_REGION.items()])


@R.add(f"""WITH {_source(PLACES, 'c_custkey', 'customer')}, l AS (SELECT c_custkey, upper(strip_accents(said)) AS label, upper(strip_accents({_list(COURTS)}[c_custkey % 7 % 5 + 1])) AS court FROM t), s AS (SELECT *, {_STATE} AS state FROM l), r AS (SELECT *, {_REGION} AS region, 'tj' || lower(state) AS tj FROM s)
SELECT c_custkey, state, CASE WHEN contains(court, 'REGIONAL FEDERAL') THEN coalesce(region, '') WHEN contains(court, 'JUSTICA ESTADUAL') OR contains(court, 'TRIBUNAL DE JUSTICA') THEN coalesce(tj, '') ELSE concat_ws(',', tj, region) END AS courts FROM r""")
def origin_mapping(spark, folder):
    state, court = _said(PLACES, "c_custkey"), F.get(F.array(*[F.lit(c) for c in COURTS]), (F.col("c_custkey") % 7 % 5).cast("int"))
    rows = read_table(spark, folder, "customer").select("c_custkey", rules.state_of(state).alias("state"), court.alias("court"))
    return rows.select("c_custkey", "state", F.array_join(rules.origin_courts(F.col("court"), F.col("state")), ",").alias("courts"))


ENTRIES = _varied([w for words in rules.AGENDA.values() for w in words] + ["reuniao com o governo", "reuniao com advogado e governo", "audiencia publica", "almoco", "assunto: HC"])
_has = lambda kind: _any("low", rules.AGENDA[kind])
_NATURE = _case([(_has("core"), "session"), (_has("ceremony"), "ceremony"), (_has("academic"), "academic_event"), (_has("courtesy"), "courtesy_visit"), (_has("admin"), "administrative_event"), (_any("low", ["audiencia"]), "hearing"), (_has("private_actor"), "private_meeting"), (_any("low", ["reuniao"]) + " AND " + _has("public_actor"), "official_meeting")], "'other'")
_CATEGORY = _case([(_has("public_actor") + " AND " + _has("private_actor"), "unclear"), (_has("core"), "institutional_core"), (_has("public_actor") + " AND " + _has("external"), "institutional_external_actor"), (_has("private_actor"), "private_advocacy"), (_has("private") + " AND event_id % 2 = 0", "private_advocacy"), (_has("public_actor"), "institutional_external_actor")], "'unclear'")


@R.add(f"WITH {_source(ENTRIES, 'event_id', 'events')}, l AS (SELECT *, lower(said) AS low FROM t) SELECT event_id, {_NATURE} AS nature, {_CATEGORY} AS category FROM l")
def agenda_classify(spark, folder):
    said = _said(ENTRIES, "event_id")
    return read_table(spark, folder, "events").select("event_id", rules.meeting_nature(said).alias("nature"), rules.agenda_category(said, F.col("event_id") % 2 == 0).alias("category"))


BODIES = _varied(["Plenário Virtual", "PLENARIO", "Tribunal Pleno", "1ª Turma", "Segunda Turma", "Gabinete"])


@R.add(f"""WITH {_source(BODIES, 'p_partkey', 'part')}, l AS (SELECT *, upper(said) AS name, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS col FROM t)
SELECT p_partkey, CASE WHEN {_any("name", ("PLENÁRIO VIRTUAL", "PLENARIO VIRTUAL"))} THEN 'plenario_virtual' WHEN {_any("name", ("PLENÁRIO", "PLENARIO", "TRIBUNAL PLENO"))} THEN 'plenario' WHEN contains(name, 'TURMA') THEN 'turma' WHEN NOT col THEN 'monocratico' WHEN col THEN 'colegiado_outro' ELSE 'incerto' END AS body,
CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS collegiate, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_type ELSE 'INCERTO' END AS theme FROM l JOIN part USING (p_partkey)""")
def body_classify(spark, folder):
    """Judging bodies, the kind of decision, and the thematic key: the first subject, else the branch, else a word for none."""
    key = F.col("p_partkey")
    flag = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    panel = F.get(F.array(*[F.lit(x) for x in ("COLEGIADA", "DECISÃO MONOCRÁTICA", "NÃO COLEGIADA", "SIM", "?")]), (key % 5).cast("int"))
    subjects = F.when(key % 4 == 0, F.array(F.lit(" "), F.col("p_brand"), F.lit("z"))).otherwise(F.array(F.lit("")))
    branch = F.when(key % 4 == 1, F.col("p_type")).otherwise(F.lit("  "))
    return read_table(spark, folder, "part").select("p_partkey", rules.body_category(_said(BODIES, "p_partkey"), flag).alias("body"), rules.collegiate(panel).alias("collegiate"), rules.thematic_key(subjects, branch).alias("theme"))
