"""Gazette entries and oral arguments against Python's own patterns."""

import re

from pyspark.sql import functions as F

from assize.operators import records

TEXT = """DIÁRIO ELETRÔNICO DA OAB, quarta-feira, 3 de abril de 2024 | Pagina: 7
Registro da Sociedade Individual de Advocacia denominada “Ana Lima
Sociedade Individual de Advocacia”, pela advogado(a), Ana Lima, OABAM –20.075, com OAB/SP 145.785 e OAB nº 99/RJ.
Reg. nº 123 - Souza e Souza Advogados – São Paulo/SP. Sociedade de Advogados sem nome. sociedade Advogados denominada "Silva & Cia" OAB MG 7. OAB MG 7.
"""


def test_firms(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, 'sociedade advocacia denominada "Sem Número" ' + "x " * 400 + "OAB/SP 1")], "k int, t string")
    got = [tuple(r) for r in records.firm_records(df, "k", "t").orderBy("form", "turn", F.monotonically_increasing_id()).collect()]
    ana = ("Ana Lima Sociedade Individual de Advocacia", "individual", None)
    assert set(got) == {
        (1, "full", 0, "145785/SP", "Ana Lima", *ana, "SP", None), (1, "full", 0, "20075/AM", "Ana Lima", *ana, "AM", None), (1, "full", 0, "99/RJ", "Ana Lima", *ana, "RJ", None), (1, "full", 0, "7/MG", "Ana Lima", *ana, "MG", None),
        (1, "full", 1, "7/MG", None, "Silva & Cia", "plural", None, "MG", None), (1, "short", 0, None, None, "Souza e Souza Advogados", "plural", "123", "SP", "São Paulo"),
    }


def test_oral_arguments(spark):
    rows = ["Sustentação Oral - REQUERENTE(S): ANA - LIMA - recebida em 01/02/2024 10:00:00", "sustentacao oral - Réu : B: C - recebida em", "Sustentação Oral - : X - recebida em 1", "other", None]
    found = [r.o and (r.o.role, r.o.party) for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(records.oral_argument(F.col("t")).alias("o")).collect()]
    pattern = re.compile(r"Sustenta[cç][aã]o\s+Oral\s*-\s*([^:]+?)\s*:\s*(.+?)\s*-\s*recebida\s+em", re.I)
    want = [(m := pattern.search(t or "")) and m.group(1).strip() and (m.group(1).strip(), m.group(2).strip()) or None for t in rows]
    assert found == want
