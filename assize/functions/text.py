"""Names, identifiers and free text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens and suffixes that do not tell companies apart.
SUFFIX_TOKENS = ("SA", "LTDA", "LTD", "ME", "EPP", "EIRELI", "EI", "SS")
SUFFIX_PATTERN = r"\s+(?:S\.?\s*A\.?|S/A|SA|S/S)\s*$"

# Federative units.
STATES = (
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
)

# Letters that do not stand for a name that begins with them.
NO_INITIALS = ("A", "E", "O")


def _accent_table() -> tuple[str, str]:
    """Characters of the Latin blocks that decompose to one base character, and these."""
    pairs = []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base != " ":
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _BASE = _accent_table()


def blank_to_null(c: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_non_null(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; other scripts stay. Free-standing combining marks go."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), r"\p{M}", "")


def entity_name(c: Column) -> Column:
    """Trimmed, without accents, with single spaces, in upper case."""
    return F.upper(F.regexp_replace(strip_accents(blank_to_null(c)), r"\s+", " "))


def canonical_name(c: Column) -> Column:
    """An entity name without legal suffixes and punctuation; if only suffixes are left they stay."""
    name = entity_name(c)
    cut = F.coalesce(F.nullif(F.trim(F.regexp_replace(name, SUFFIX_PATTERN, "")), F.lit("")), name)
    words = F.trim(F.regexp_replace(F.regexp_replace(cut, r"(?U)[^\w\s]+", " "), r"\s+", " "))
    tokens = F.split(F.nullif(words, F.lit("")), " ")
    kept = F.filter(tokens, lambda t: ~t.isin(*SUFFIX_TOKENS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(tokens), " ")


def tax_id(c: Column) -> Column:
    return F.nullif(F.regexp_replace(blank_to_null(c), r"\D+", ""), F.lit(""))


def _weighed(digits: Column, weights: list[int]) -> Column:
    return sum((F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))


def valid_person_id(c: Column) -> Column:
    """Eleven digits, not all the same, with two check digits modulo 11."""
    d = tax_id(c)
    digit = lambda k: F.substring(d, k + 1, 1).cast("int")
    check = lambda n: (_weighed(d, list(range(n + 1, 1, -1))) * 10 % 11) % 10
    shape = (F.length(d) == 11) & ~d.rlike(r"^(.)\1+$")
    return F.coalesce(shape & (check(9) == digit(9)) & (check(10) == digit(10)), F.lit(False))


def valid_company_id(c: Column) -> Column:
    """Fourteen digits, not all the same, with two weighed check digits modulo 11."""
    d = tax_id(c)
    digit = lambda k: F.substring(d, k + 1, 1).cast("int")

    def check(n: int) -> Column:
        # weights count down to 2 from the right, and start again at 9
        rest = _weighed(d, [(n - 1 - k) % 8 + 2 for k in range(n)]) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    shape = (F.length(d) == 14) & ~d.rlike(r"^(.)\1+$")
    return F.coalesce(shape & (check(12) == digit(12)) & (check(13) == digit(13)), F.lit(False))


def stable_id(prefix: str, value: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, length))


def record_hash(columns: list[str]) -> Column:
    """A digest of a row: JSON with sorted keys, without null fields."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def identity_key(name: Column, tax: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tax:"), tax_id(tax)), F.concat(F.lit("name:"), F.nullif(canonical_name(name), F.lit(""))))


def lawyer_identity_key(name: Column, bar: Column, tax: Column) -> Column:
    return F.coalesce(F.concat(F.lit("oab:"), bar_number(bar)), identity_key(name, tax))


def firm_identity_key(name: Column, company: Column, registry: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tax:"), tax_id(company)), F.concat(F.lit("cnsa:"), tax_id(registry)), F.concat(F.lit("name:"), F.nullif(canonical_name(name), F.lit(""))))


def process_code(c: Column) -> Column:
    """``CLASS NUMBER`` in upper case, without what follows."""
    text = F.upper(F.trim(c))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(text, r"^([A-Z]+\s+\d+)", 1), r"\s+", " "), F.lit("")), text)


def process_class(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)\s+\d+", 1)), F.lit(""))


def bar_number(c: Column) -> Column:
    """``DIGITS/STATE`` with one to six digits and a known state, else null."""
    text = F.upper(blank_to_null(c))
    number, state = F.regexp_replace(F.regexp_extract(text, r"^(.*)/", 1), r"\D+", ""), F.trim(F.regexp_extract(text, r"/([^/]*)$", 1))
    return F.when(number.rlike(r"^\d{1,6}$") & state.isin(*STATES), F.concat_ws("/", number, state))


def split_distinct(c: Column, pattern: str) -> Column:
    """The trimmed, non-empty parts of a text, the first of each."""
    parts = F.transform(F.split(c, pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def subjects(c: Column) -> Column:
    return F.array_distinct(F.transform(split_distinct(c, r"\|"), lambda x: F.upper(x)))


def party_names(c: Column) -> Column:
    """The sides of ``A x B`` or ``A vs. B``; of spellings that differ in case only, the first."""
    return first_of_each(split_distinct(c, r"(?i)\s+(?:x|vs\.?)\s+"))


def first_of_each(names: Column) -> Column:
    """The names of an array without those that an earlier one equals but for case."""
    upper = F.transform(names, lambda x: F.upper(x))
    return F.filter(names, lambda x, k: F.array_position(upper, F.upper(x)) == k + 1)


def name_list(c: Column) -> Column:
    return split_distinct(c, r"(?i);|\||\s+E\s+OUTRO\(A/S\)")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def column_label(label: str) -> str:
    """A header in snake case."""
    base = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).lower()
    return "_".join("".join(c if c.isalnum() else " " for c in base).split())


def column_labels(labels: list[str]) -> list[str]:
    """Headers in snake case; repeated ones are numbered from the second on."""
    seen: dict[str, int] = {}
    out = []
    for label in map(column_label, labels):
        seen[label] = seen.get(label, 0) + 1
        out.append(label if seen[label] == 1 else f"{label}_{seen[label]}")
    return out


def clean_cell(c: Column) -> Column:
    """A spreadsheet cell: escaped carriage returns as spaces, trimmed, with words for nothing as null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "_x000D_", " "), r"\s+", " "))
    return F.when(~F.lower(text).isin("", "nan", "none", "null", "n/a", "-"), text)


def even_places(c: Column, separator: str = ";#") -> Column:
    """``v;#id;#v`` lists: the values at even places."""
    return F.filter(F.split(c, separator), lambda x, k: k % 2 == 0)


def without_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def extract_tax_ids(c: Column) -> Column:
    """Formatted person and company numbers in free text, the first of each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\b"), F.lit(1)))


def extract_bar_numbers(c: Column) -> Column:
    """``OAB/SP 12.345`` in free text as DIGITS/STATE."""
    hits = F.regexp_extract_all(F.upper(c), F.lit(r"OAB\s*[/-]?\s*([A-Z]{2}\s*(?:N[º°.]*)?\s*[\d.]+)"), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda h: F.concat_ws("/", F.regexp_replace(h, r"\D+", ""), F.substring(h, 1, 2))))


def extract_process_refs(c: Column, classes: list[str], ascii_only: bool = False) -> Column:
    """References ``CLASS NUMBER`` in free text for the given classes, the first of each.

    A class begins where a word does: after no letter, digit or underscore of any script, or, ``ascii_only``, of ASCII alone, so
    that ``ère 33`` holds ``RE 33``, as in SQL's regular expressions; spaces are ASCII's then, without the vertical tab.
    """
    before, space = (r"(?<![A-Za-z0-9_])", r"[\t\n\f\r ]") if ascii_only else (r"(?<![\p{L}\p{M}\p{N}_])", r"\s")
    pattern = before + "((?:" + "|".join(sorted(classes, key=lambda x: (-len(x), x))) + rf"){space}+[0-9.]+)"
    hits = F.regexp_extract_all(F.upper(c), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda h: F.regexp_replace(F.regexp_replace(h, r"\.", ""), r"\s+", " ")))


def role_entries(c: Column) -> Column:
    """``LABEL: content`` runs of a text as an array of (label, content); content ends at the next label."""
    label = r"([A-ZÇÁÉÍÓÚÃÕÜ0-9./()\-]{3,})\s*:\s*"
    hits = F.regexp_extract_all(c, F.lit(label + r"(.*?)(?=[A-ZÇÁÉÍÓÚÃÕÜ0-9./()\-]{3,}\s*:|$)"), F.lit(0))
    return F.transform(hits, lambda h: F.struct(F.regexp_extract(h, label, 1).alias("label"), F.trim(F.regexp_replace(h, "^" + label, "")).alias("content")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(canonical_name(c), F.lit("")), " "), lambda t: t != "")


def greedy_jaccard(left: Column, right: Column) -> Column:
    """Token likeness of two token arrays: each token of the shorter takes the first fitting one left of the longer.

    A one-letter token, but for articles, fits a word that begins with it. A fold over the shorter array.
    """
    initial = lambda a, b: (F.length(a) == 1) & ~a.isin(*NO_INITIALS) & F.startswith(b, a)
    fits = lambda a, b: (a == b) | initial(a, b) | initial(b, a)
    swap = F.size(left) > F.size(right)
    small, large = F.when(swap, right).otherwise(left), F.when(swap, left).otherwise(right)
    none = F.lit(-1)

    def place(rest: Column, token: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(rest) - 1), lambda k: fits(token, F.get(rest, k)))
        return F.when(F.size(rest) > 0, F.coalesce(F.get(found, F.lit(0)), none)).otherwise(none)

    def take(rest: Column, token: Column) -> Column:
        at = place(rest, token)
        return F.when(at < 0, rest).otherwise(F.filter(rest, lambda _, k: k != at))

    rest = F.aggregate(small, large, take)
    matches = F.size(large) - F.size(rest)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(matches / (F.size(left) + F.size(right) - matches))
