"""Classifiers: ordered rules over normalised text, compiled to column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assize.functions.text import STATES, blank_to_null, strip_accents

# Outcomes by the terms of decision records.
FAVORABLE = (
    "Provido", "Parcialmente provido", "Provido em parte", "Deferido", "Deferido em parte", "Parcialmente deferido", "Procedente", "Procedente em parte",
    "Parcialmente procedente", "Julgado procedente", "Concedido", "Parcialmente concedido", "Homologado", "Homologada", "Agravo regimental provido",
    "Agravo regimental provido em parte", "Concedida a ordem", "Concedida a ordem de ofício", "Concedida em parte a ordem", "Concedida a segurança",
    "Concedida em parte a segurança", "Concedida a suspensão", "Concedida em parte a suspensão", "Embargos recebidos", "Embargos recebidos em parte",
    "Liminar deferida", "Liminar deferida em parte", "Liminar referendada", "Liminar referendada em parte", "Homologado o acordo", "Homologada a desistência",
    "Conhecido e provido", "Conhecido e provido em parte", "Conhecido em parte e nessa parte provido",
    "Embargos recebidos como agravo regimental desde logo provido", "Embargos recebidos como agravo regimental desde logo provido em parte",
    "Agravo provido e desde logo provido o RE", "Decisão Referendada", "Decisão Ratificada", "Concedida de ofício", "Liminar parcialmente deferida",
    "Liminar deferida ad referendum",
)
UNFAVORABLE = (
    "Desprovido", "Não provido", "Indeferido", "Improcedente", "Julgado improcedente", "Não conhecido", "Denegado", "Negado provimento", "Negado seguimento",
    "Agravo regimental não provido", "Agravo regimental não conhecido", "Agravo não provido", "Embargos rejeitados", "Embargos não conhecidos",
    "Embargos recebidos como agravo regimental desde logo não provido", "Embargos recebidos como agravo regimental desde logo não conhecido",
    "Denegada a ordem", "Denegada a segurança", "Denegada a suspensão", "Liminar não referendada", "Liminar indeferida", "Não conhecido(s)", "Rejeitados",
    "Conhecido e negado provimento", "Conhecido em parte e nessa parte negado provimento", "Liminar indeferida ad referendum",
)
NEUTRAL = ("Prejudicado", "Liminar prejudicada", "Extinto o processo", "Baixa sem resolução", "Baixa sem resolucao")
# Parts of terms in order of trial.
OUTCOME_PARTS = (
    ("NEGADO PROVIMENTO", "unfavorable"), ("NEGOU PROVIMENTO", "unfavorable"), ("NEGADO SEGUIMENTO", "unfavorable"), ("NAO PROVIDO", "unfavorable"),
    ("NAO CONHECIDO", "unfavorable"), ("NAO REFERENDADA", "unfavorable"), ("LIMINAR INDEFERIDA AD REFERENDUM", "unfavorable"),
    ("LIMINAR INDEFERIDA", "unfavorable"), ("INDEFERIDA A ORDEM", "unfavorable"), ("INDEFERIDO", "unfavorable"), ("IMPROCEDENTE", "unfavorable"),
    ("DENEGADA", "unfavorable"), ("DENEGADO", "unfavorable"), ("REJEITADOS", "unfavorable"), ("REJEITADO", "unfavorable"), ("PREJUDICADO", "neutral"),
    ("EXTINTO O PROCESSO", "neutral"), ("BAIXA SEM RESOLUCAO", "neutral"), ("SEM RESOLUCAO", "neutral"), ("LIMINAR PARCIALMENTE DEFERIDA", "favorable"),
    ("LIMINAR DEFERIDA AD REFERENDUM", "favorable"), ("CONCEDIDA EM PARTE A ORDEM", "favorable"), ("CONCEDIDA DE OFICIO", "favorable"),
    ("CONHECER DO AGRAVO E DAR PARCIAL PROVIMENTO AO RE", "favorable"), ("CONHECER DO AGRAVO E DAR PROVIMENTO AO RE", "favorable"),
    ("CONHECIDO EM PARTE E NESSA PARTE DA PROVIMENTO", "favorable"), ("CONHECIDO EM PARTE E NESSA PARTE PROVIDO", "favorable"),
    ("DAR PARCIAL PROVIMENTO", "favorable"), ("DAR PROVIMENTO", "favorable"), ("PROVIDO EM PARTE", "favorable"), ("DEFERIDA", "favorable"),
    ("DEFERIDO", "favorable"), ("PROVIDO", "favorable"), ("CONCEDIDA", "favorable"), ("CONCEDIDO", "favorable"), ("PROCEDENTE", "favorable"),
    ("HOMOLOGADA", "favorable"), ("HOMOLOGADO", "favorable"), ("HOMOL A DESISTENCIA", "favorable"), ("REFERENDADA", "favorable"), ("RATIFICADA", "favorable"),
)
PASSIVE_ROLES = ("RECDO.(A/S)", "AGDO.(A/S)", "INTDO.(A/S)", "BENEF.(A/S)")
# Parts of terms by what a decision is about.
PROVISIONAL = ("LIMINAR", "AD REFERENDUM")
PROCEDURAL = ("NEGADO SEGUIMENTO", "NAO CONHECIDO", "HOMOLOGADA A DESISTENCIA", "HOMOLOGADO O ACORDO", "PREJUDICADO", "EXTINTO O PROCESSO", "BAIXA SEM RESOLUCAO", "HOMOL A DESISTENCIA")
SUBSTANTIVE = (
    "CONHECIDO E PROVIDO", "CONHECIDO E NEGADO PROVIMENTO", "CONHECIDO EM PARTE E NESSA PARTE PROVIDO", "CONHECIDO EM PARTE E NESSA PARTE NEGADO PROVIMENTO",
    "CONHECIDO EM PARTE E NESSA PARTE DA PROVIMENTO", "CONCEDIDA A ORDEM", "CONCEDIDA EM PARTE A ORDEM", "CONCEDIDA A ORDEM DE OFICIO", "DENEGADA A ORDEM",
    "CONCEDIDA A SEGURANCA", "CONCEDIDA EM PARTE A SEGURANCA", "DENEGADA A SEGURANCA", "CONCEDIDA A SUSPENSAO", "CONCEDIDA EM PARTE A SUSPENSAO",
    "DENEGADA A SUSPENSAO", "PROVIDO EM PARTE", "PARCIALMENTE PROVIDO", "PROVIDO", "NAO PROVIDO", "DESPROVIDO", "NEGADO PROVIMENTO", "NEGOU PROVIMENTO",
    "DAR PROVIMENTO", "DAR PARCIAL PROVIMENTO", "PROCEDENTE", "IMPROCEDENTE",
)
# Movement categories by parts of their descriptions, in order of trial.
MOVEMENTS = (
    ("deslocamento", ("deslocamento", "redistribu", "remessa", "remessa a", "remetido", "encaminhado", "prevenção", "prevencao")),
    ("baixa", ("baixa", "trânsito em julgado", "transito em julgado", "arquivado", "arquivamento")),
    ("distribuicao", ("distribuí", "distribui", "sorteio", "sorteado", "distribuição", "distribuido")),
    ("vista", ("vista", "devolvidos autos")),
    ("pauta", ("pauta", "incluído em pauta", "retirado de pauta", "incluido em pauta", "retirada de pauta")),
    ("recurso", ("embargos", "agravo", "recurso")),
    ("decisao", ("julgamento", "julgado", "decisão", "decisao", "provido", "provimento", "improvido", "negado", "deferido", "indeferido", "procedente", "improcedente", "concedido", "prejudicado", "extinto")),
    ("publicacao", ("publicação", "publicacao", "publicado", "diário", "diario", "intimação", "intimacao")),
)
# What a movement signals.
SIGNALS = {
    "redistribution": ("redistribu", "redistribuição", "redistribuicao", "redistribuído", "redistribuido"),
    "review_request": ("pedido de vista", "vista dos autos", "vista ao"),
    "review_return": ("devolvidos autos", "devolução de vista", "devolvido vista", "devolvidos os autos", "devolucao de vista"),
    "agenda_in": ("incluído em pauta", "incluido em pauta", "incluída em pauta", "incluida em pauta", "inclusão em pauta", "inclusao em pauta"),
    "agenda_out": ("retirado de pauta", "retirada de pauta", "retirado da pauta", "retirada da pauta", "exclusão de pauta", "exclusao de pauta"),
    "prevention": ("prevenção", "prevencao", "prevento", "prevenido"),
}
# Kinds of donated resources.
RESOURCE_SOURCES = {
    "RECURSOS DE PESSOAS FISICAS": "individual", "RECURSOS DE PESSOAS JURIDICAS": "corporate", "RECURSOS PROPRIOS": "own_resources", "RECURSOS PROPRIO": "own_resources",
    "RECURSOS DE ORIGENS NAO IDENTIFICADAS": "unidentified_source", "RECURSOS DE PARTIDO POLITICO": "party_transfer",
    "RECURSOS DE OUTROS CANDIDATOS/COMITES": "committee_transfer", "RECURSOS DE COMITES": "committee_transfer", "RECURSOS DE OUTROS CANDIDATOS": "committee_transfer",
    "COMERCIALIZACAO DE BENS OU REALIZACAO DE EVENTOS": "events_commerce", "COMERCIALIZACAO DE BENS E REALIZACAO DE EVENTOS": "events_commerce",
    "FUNDO PARTIDARIO": "party_fund", "FUNDO ESPECIAL DE FINANCIAMENTO DE CAMPANHA": "campaign_fund", "FUNDO ESPECIAL": "campaign_fund", "FEFC": "campaign_fund",
    "FINANCIAMENTO COLETIVO POR MEIO DA INTERNET": "internet", "RENDIMENTOS DE APLICACOES FINANCEIRAS": "events_commerce", "DOACAO PELA INTERNET": "internet",
    "DOACOES PELA INTERNET": "internet", "RECURSOS DE FINANCIAMENTO COLETIVO": "internet",
}
PAYMENT_METHODS = {"EM ESPECIE": "cash", "DINHEIRO": "cash", "CHEQUE": "check", "ESTIMADO": "estimated", "ESTIMAVEL": "estimated", "NAO INFORMADO": "not_informed", "NAO IDENTIFICADO": "not_informed"}
PAYMENT_CODES = {"0": "cash", "1": "check", "2": "estimated"}
IN_KIND = (
    ("campaign_material", ("SANTINHO", "ADESIVO", "BANDEIRA", "BANNER", "FAIXA", "PANFLETO", "CAMISETA", "BONE", "BROCHE", "FLYER", "MATERIAL DE CAMPANHA", "MATERIAL DE PROPAGANDA", "PROPAGANDA ELEITORAL", "MATERIAL GRAFICO", "MATERIAL PUBLICITARIO", "PLACA")),
    ("professional_service", ("SERVICO", "CONSULTORIA", "ASSESSORIA", "ADVOCACIA", "CONTABILIDADE", "CONTABIL", "JURIDICO", "PESQUISA", "MARKETING", "PUBLICIDADE", "PRESTACAO DE SERVICO", "HONORARIO", "LOCACAO DE MAO DE OBRA")),
    ("transport_fuel", ("COMBUSTIVEL", "GASOLINA", "ETANOL", "DIESEL", "TRANSPORTE", "FRETE", "PASSAGEM", "DESLOCAMENTO", "VEICULO", "TAXI", "UBER")),
    ("media_communication", ("RADIO", "TELEVISAO", "TV", "JORNAL", "INSERCAO", "MIDIA", "HORARIO ELEITORAL", "COMUNICACAO", "TELEFONE", "INTERNET", "SITE", "REDE SOCIAL")),
    ("rental_property", ("ALUGUEL", "LOCACAO DE IMOVEL", "LOCACAO DE ESPACO", "CESSAO DE ESPACO", "CESSAO DE IMOVEL", "SALA", "IMOVEL", "COMITE")),
    ("campaign_worker", ("PESSOAL", "FUNCIONARIO", "CABO ELEITORAL", "MILITANTE", "COORDENADOR", "FISCAL", "MESARIO", "FOLHA DE PAGAMENTO", "SALARIO")),
    ("printing", ("GRAFICA", "IMPRESSAO", "TIPOGRAFIA", "COPIA", "XEROX")),
    ("food_beverage", ("ALIMENTACAO", "ALIMENTO", "REFEICAO", "AGUA", "BEBIDA", "CAFE", "LANCHE", "COMIDA")),
    ("volunteer_work", ("TRABALHO VOLUNTARIO", "CESSAO DE MAO DE OBRA")),
    ("other_item", ("DOACAO", "ESTIMAVEL EM DINHEIRO", "DOACAO EM BENS", "DOACAO ESTIMADA", "CONTRIBUICAO", "RECURSO")),
)


def plain_label(c: Column) -> Column:
    """Upper case without accents; everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), r"[^A-Z0-9]+", " "))


def _plain(text: str) -> str:
    """``plain_label`` of a constant."""
    from unicodedata import combining, normalize

    kept = "".join(c for c in normalize("NFKD", text) if not combining(c)).upper()
    return " ".join("".join(c if c.isalnum() else " " for c in kept).split())


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of some parts."""
    found = F.contains(c, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(c, F.lit(part))
    return found


def ladder(rules: list[tuple[Column, Column | str]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def outcome(progress: Column) -> Column:
    """favorable, unfavorable or neutral: whole terms first, then parts in order; else null."""
    label = plain_label(progress)
    whole = [(label.isin(*sorted({_plain(x) for x in terms})), name) for terms, name in ((FAVORABLE, "favorable"), (UNFAVORABLE, "unfavorable"), (NEUTRAL, "neutral"))]
    return ladder([*whole, *[(F.contains(label, F.lit(part)), name) for part, name in OUTCOME_PARTS]])


def outcome_for_party(raw_outcome: Column, role: Column) -> Column:
    """An outcome as the party sees it: for the passive side it is turned round."""
    passive = F.upper(strip_accents(F.trim(role))).isin(*PASSIVE_ROLES)
    turned = F.when(raw_outcome == "favorable", "unfavorable").when(raw_outcome == "unfavorable", "favorable").otherwise(raw_outcome)
    return F.when(passive, turned).otherwise(raw_outcome)


def materiality(progress: Column) -> Column:
    label = plain_label(progress)
    return ladder([(any_of(label, PROVISIONAL), "provisional"), (any_of(label, PROCEDURAL), "procedural"), (any_of(label, SUBSTANTIVE), "substantive")], "unknown")


def body_category(body: Column, collegiate: Column) -> Column:
    name = F.upper(body)
    return ladder([
        (any_of(name, ("PLENÁRIO VIRTUAL", "PLENARIO VIRTUAL")), "plenario_virtual"), (any_of(name, ("PLENÁRIO", "PLENARIO", "TRIBUNAL PLENO")), "plenario"),
        (any_of(name, ("TURMA",)), "turma"), (~collegiate, "monocratico"), (collegiate, "colegiado_outro"),
    ], "incerto")


def thematic_key(subject_list: Column, branch: Column, fallback: str = "INCERTO") -> Column:
    named = F.filter(F.transform(subject_list, lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.get(named, F.lit(0)), blank_to_null(branch), F.lit(fallback))


def group_status(count: Column, least: int = 5, most: int = 5000) -> Column:
    return F.when(count < least, "insufficient_cases").when(count > most, "too_broad").otherwise("valid")


def movement_category(description: Column) -> Column:
    text = F.lower(description)
    return ladder([(any_of(text, parts), name) for name, parts in MOVEMENTS], "outros")


def signals(description: Column, kind: str) -> Column:
    return F.coalesce(any_of(F.lower(description), SIGNALS[kind]), F.lit(False))


def collegiate(value: Column) -> Column:
    """True, false or unknown from a text that names the kind of decision."""
    text = F.upper(strip_accents(value))
    return F.when(any_of(text, ("MONOCRATIC", "NAO COLEGIAD")) | text.isin("N", "NAO", "FALSE", "0"), False).when(any_of(text, ("COLEGIAD",)) | text.isin("S", "SIM", "TRUE", "1"), True)


def resource(description: Column) -> Column:
    """(category, subtype, confidence) of a donated resource."""
    raw = F.upper(F.trim(description))
    label = F.regexp_replace(F.trim(F.regexp_replace(strip_accents(raw), r"\s+", " ")), r"^[.,;:\-–—/\\()\[\]{}\"']+|[.,;:\-–—/\\()\[\]{}\"']+$", "")
    answer = lambda category, subtype, confidence: F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"), F.lit(confidence).alias("confidence"))
    one_of = lambda c, table, category, level: [(c == k, answer(category, v, level)) for k, v in table.items()]
    rules = [
        (raw.isNull() | (raw == ""), answer("empty", "blank", "none")),
        (raw.isin("#NULO", "NULO", "NULL", "#NULO#"), answer("empty", "null_marker", "none")),
        *one_of(raw, PAYMENT_CODES, "payment_method", "high"),
        (label == "", answer("empty", "blank", "none")),
        *one_of(label, RESOURCE_SOURCES, "source_type", "high"),
        *one_of(label, PAYMENT_METHODS, "payment_method", "high"),
        *[(any_of(label, parts), answer("in_kind", name, "medium")) for name, parts in IN_KIND],
    ]
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(answer("unknown", "unclassified", "none"))


def document_kind(raw: Column) -> Column:
    """cpf, cnpj, masked or unknown by the digits of a number."""
    digits = F.length(F.regexp_replace(raw, r"\D+", ""))
    return F.when(F.contains(raw, F.lit("*")), "masked").when(digits == 11, "cpf").when(digits == 14, "cnpj").otherwise("unknown")


def person_kind(raw: Column) -> Column:
    first = F.substring(F.upper(F.trim(raw)), 1, 1)
    return F.when(F.upper(F.trim(raw)).isin("PF", "F") | (first == "F"), "PF").when(F.upper(F.trim(raw)).isin("PJ", "J") | (first == "J"), "PJ")


def inferred_type(texts: Column) -> Column:
    """The type that at least four in five of an array of texts have: integer, decimal, date, boolean or text."""
    shapes = (("integer", r"^-?\d+$"), ("decimal", r"^-?\d+[.,]\d+$"), ("date", r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}"), ("boolean", r"(?i)^(?:true|false|sim|nao|não)$"))
    share = lambda p: F.size(F.filter(texts, lambda x: x.rlike(p))) >= 0.8 * F.size(texts)
    return ladder([(share(p) & (F.size(texts) > 0), name) for name, p in shapes], "text")


def match_confidence(strategy: Column) -> Column:
    """How much a match by a strategy is worth."""
    return ladder([(strategy.isin("tax_id"), "high"), (strategy.isin("alias", "exact"), "high"), (strategy.isin("canonical_name"), "medium"), (strategy.isin("jaccard", "levenshtein"), "low")], "unknown")


def known_state(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(*STATES)


# States by name.
STATE_NAMES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF", "ESPIRITO SANTO": "ES", "GOIAS": "GO",
    "MARANHAO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG", "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE",
    "PIAUI": "PI", "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC",
    "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}
# The federal region of each state.
FEDERAL_REGION = {
    "AC": 1, "AM": 1, "AP": 1, "BA": 1, "DF": 1, "GO": 1, "MA": 1, "MG": 6, "MT": 1, "PA": 1, "PI": 1, "RO": 1, "RR": 1, "TO": 1, "ES": 2, "RJ": 2,
    "MS": 3, "SP": 3, "PR": 4, "RS": 4, "SC": 4, "AL": 5, "CE": 5, "PB": 5, "PE": 5, "RN": 5, "SE": 5,
}
# Words of agenda entries.
AGENDA = {
    "core": ("sessao plenaria", "sessao administrativa", "sessao virtual", "plenario virtual", "julgamento", "sessao do tse"),
    "external": ("agu", "pgr", "procurador-geral", "embaixador", "onu", "posse", "homenagem", "seminario", "congresso", "oab", "secretaria-geral"),
    "private": ("assunto:", "dr.", "dra.", "escritorio", "advogad"),
    "public_actor": ("agu", "pgr", "procurador-geral", "ministerio", "secretaria", "embaixador", "onu", "oab", "tribunal", "orgao", "governo"),
    "private_actor": ("dr.", "dra.", "escritorio", "advogad", "banca"),
    "ceremony": ("posse", "homenagem", "titulo", "cerimonia", "entrega"),
    "academic": ("seminario", "congresso", "palestra", "simposio"),
    "admin": ("administrativa", "administrativo", "reuniao interna"),
    "courtesy": ("cortesia", "visita de cortesia"),
}
# Procedural windows of events, and of movements in order of trial.
EVENT_WINDOWS = {"petition": "distribuicao", "oral_argument": "julgamento", "memorial": "pauta", "amicus_brief": "distribuicao", "procuracao": "distribuicao", "substabelecimento": "distribuicao", "withdrawal": "publicacao"}
MOVEMENT_WINDOWS = {
    "DISTRIBUICAO": "distribuicao", "REDISTRIBUICAO": "distribuicao", "DISTRIBUIDO": "distribuicao", "INCLUIDO_EM_PAUTA": "pauta", "PAUTA": "pauta", "RETIRADO_DE_PAUTA": "pauta",
    "ADIADO": "pauta", "PEDIDO_DE_VISTA": "vista", "VISTA": "vista", "DEVOLVIDO_DA_VISTA": "vista", "JULGAMENTO": "julgamento", "JULGADO": "julgamento",
    "PROCLAMACAO_DO_RESULTADO": "julgamento", "PUBLICACAO": "publicacao", "PUBLICADO": "publicacao", "TRANSITO_EM_JULGADO": "publicacao",
}


def session_event(description: Column) -> Column:
    """The kind of session event: a return before a request, then agenda signals, then the movement's category."""
    category = movement_category(description)
    return ladder([
        (signals(description, "review_return"), "devolvido_vista"), (signals(description, "review_request"), "pedido_de_vista"), (signals(description, "agenda_in"), "pauta_inclusion"),
        (signals(description, "agenda_out"), "pauta_withdrawal"), (category == "pauta", "pauta_inclusion"), (category == "vista", "pedido_de_vista"), (category == "decisao", "julgamento"),
    ], "outros")


def session_kind(description: Column) -> Column:
    text = F.lower(description)
    return ladder([(any_of(text, ("virtual",)), "plenario_virtual"), (any_of(text, ("plenário", "pleno", "plenario")), "plenario"), (text.rlike(r"1[ªa]\s*turma|primeira turma"), "turma_1"), (text.rlike(r"2[ªa]\s*turma|segunda turma"), "turma_2")])


def procedural_window(event: Column, movement: Column) -> Column:
    label = F.replace(F.upper(movement), F.lit(" "), F.lit("_"))
    return ladder([*[(event == k, v) for k, v in EVENT_WINDOWS.items()], *[(F.contains(label, F.lit(k)), v) for k, v in MOVEMENT_WINDOWS.items()]])


def representative_role(label: Column) -> Column:
    return F.when(any_of(F.upper(label), ("PROC",)), "public_attorney").when(any_of(F.upper(label), ("ADV", "DEF")), "counsel_of_record")


def state_of(description: Column) -> Column:
    """A state's code from its code, its name, or a text that names it; longer names first."""
    label = F.upper(strip_accents(description))
    names = sorted(STATE_NAMES, key=lambda n: (-len(n), n))
    return ladder([(label.isin(*STATES), label), *[(label == n, STATE_NAMES[n]) for n in names], *[(F.contains(label, F.lit(n)), STATE_NAMES[n]) for n in names]])


def origin_courts(court: Column, state: Column) -> Column:
    """The state and federal courts an origin may mean, as an array."""
    code = state_of(state)
    region = F.create_map(*[F.lit(x) for k, v in FEDERAL_REGION.items() for x in (k, f"trf{v}")])[code]
    local = F.concat(F.lit("tj"), F.lower(code))
    name = F.upper(strip_accents(court))
    both = F.array_compact(F.array(local, region))
    return F.when(F.contains(name, F.lit("REGIONAL FEDERAL")), F.array_compact(F.array(region))).when(any_of(name, ("JUSTICA ESTADUAL", "TRIBUNAL DE JUSTICA")), F.array_compact(F.array(local))).otherwise(both)


def meeting_nature(entry: Column) -> Column:
    text = F.lower(entry)
    has = lambda kind: any_of(text, AGENDA[kind])
    return ladder([
        (has("core"), "session"), (has("ceremony"), "ceremony"), (has("academic"), "academic_event"), (has("courtesy"), "courtesy_visit"), (has("admin"), "administrative_event"),
        (any_of(text, ("audiencia",)), "hearing"), (has("private_actor"), "private_meeting"), (any_of(text, ("reuniao",)) & has("public_actor"), "official_meeting"),
    ], "other")


def agenda_category(entry: Column, names_case: Column) -> Column:
    """The kind of an agenda entry by who takes part; ``names_case`` says whether it refers to a case."""
    text = F.lower(entry)
    has = lambda kind: any_of(text, AGENDA[kind])
    public, private = has("public_actor"), has("private_actor")
    return ladder([
        (public & private, "unclear"), (has("core"), "institutional_core"), (public & has("external"), "institutional_external_actor"), (private, "private_advocacy"),
        (has("private") & names_case, "private_advocacy"), (public, "institutional_external_actor"),
    ], "unclear")
