"""Records within texts: firms in gazettes, bar numbers as they are printed, oral arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a bar number is printed, in order; whether its state comes first.
BAR_PATTERNS = ((r"OAB/([A-Z]{2})\s+([\d.]+)", True), (r"OAB([A-Z]{2})\s*[–\-]\s*([\d.]+)", True), (r"OAB\s*n[ºo.]?\s*([\d.]+)\s*/?\s*([A-Z]{2})", False), (r"OAB\s+([A-Z]{2})\s+([\d.]+)", True))
# What pages leave in a text.
PAGE_MARKS = (
    r"Documento assinado digitalmente conforme MP n[ºo]2\.200-2 de 24/08/2001,\s*que\s+instituiu a Infraestrutura de Chaves P[uú]blicas Brasileira\s*-\s*ICP-Brasil",
    r"(?iu)DI[AÁ]RIO ELETR[OÔ]NICO DA OAB\s+[^|]+\|\s*Pagina:\s*\d+", r"\|\s*Pagina:\s*\d+", r"(?iu)(?:segunda|ter[çc]a|quarta|quinta|sexta|s[aá]bado|domingo)-feira,\s*\d+\s+de\s+\w+\s+de\s+\d{4}",
)
# A firm's entry in full, its holder, and a firm's entry in short.
FIRM = r'(?iu)(sociedade\s+(?:individual\s+de\s+)?(?:advocacia|advogados)\s+denominada\s+["“”]([^"“”]+)["“”])(?=(.{0,500}))'
HOLDER = r"(?iu)advogado\s*\(a\)\s*,?\s*([^,]+?)\s*,\s*OAB"
SHORT = r"(?iu)Reg\.\s*n[ºo]\s*(\d+)\s*[-–]\s*(.+?(?:Sociedade|Advogados)[^-–]*?)[-–]\s*([^-–\n]+/[A-Z]{2})"
ORAL = r"(?iu)Sustenta[cç][aã]o\s+Oral\s*-\s*([^:]+?)\s*:\s*(.+?)\s*-\s*recebida\s+em"


def bar_numbers(c: Column) -> Column:
    """The bar numbers of a text as an array of (number, state), by pattern and then by place, each once; dots are dropped."""
    found = []
    for pattern, state_first in BAR_PATTERNS:
        one, two = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2))
        state, number = (one, two) if state_first else (two, one)
        found.append(F.zip_with(number, state, lambda n, s: F.struct(F.replace(n, F.lit("."), F.lit("")).alias("number"), s.alias("state"))))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x["number"] != ""))


def plain_page(c: Column) -> Column:
    """A text without what its pages left in it, with single spaces."""
    for mark in PAGE_MARKS:
        c = F.regexp_replace(c, mark, " ")
    return F.regexp_replace(c, r"\s+", " ")


def _kind(name: Column) -> Column:
    return F.when(F.contains(F.lower(name), F.lit("individual")), "individual").otherwise("plural")


def firm_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """Firms that gazettes name: (key, form, turn, bar_number, holder, firm, kind, registry, state, city).

    An entry in full is read with the 500 characters after it: each bar number there is a record, with the first holder named there; an
    entry without one gives none. An entry in short is a record of its own.
    """
    pages = df.select(key, plain_page(F.col(text)).alias("_t"))
    whole, name, after = (F.regexp_extract_all("_t", F.lit(FIRM), F.lit(k)) for k in (1, 2, 3))
    entries = pages.select(key, F.posexplode(F.arrays_zip(whole.alias("whole"), name.alias("name"), after.alias("after"))).alias("turn", "e"))
    context = F.concat("e.whole", "e.after")
    told = entries.select(key, "turn", F.trim("e.name").alias("firm"), F.nullif(F.trim(F.regexp_extract(context, HOLDER, 1)), F.lit("")).alias("holder"), F.explode(bar_numbers(context)).alias("bar"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    full = told.select(key, F.lit("full").alias("form"), "turn", F.concat_ws("/", "bar.number", "bar.state").alias("bar_number"), "holder", "firm", _kind(F.col("firm")).alias("kind"), none("registry"), F.col("bar.state").alias("state"), none("city"))
    number, firm, place = (F.regexp_extract_all("_t", F.lit(SHORT), F.lit(k)) for k in (1, 2, 3))
    short = pages.select(key, F.posexplode(F.arrays_zip(number.alias("number"), firm.alias("firm"), place.alias("place"))).alias("turn", "e"))
    at, named = F.trim("e.place"), F.trim("e.firm")
    return full.union(short.select(key, F.lit("short"), "turn", none("bar_number"), none("holder"), named, _kind(named), F.trim("e.number"), F.trim(F.substring_index(at, "/", -1)), F.trim(F.regexp_replace(at, "/[^/]*$", ""))))


def oral_argument(detail: Column) -> Column:
    """(role, party) of an oral argument's detail; null where it is none, or one of them is blank."""
    role, party = (F.trim(F.regexp_extract(detail, ORAL, k)) for k in (1, 2))
    return F.when((role != "") & (party != ""), F.struct(role.alias("role"), party.alias("party")))
