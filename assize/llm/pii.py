"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap. Base rules decide some of them: e-mail addresses,
IP addresses, card numbers that pass the Luhn test, international phone numbers. A proposed candidate is
written out plainly (separators and spelled-out signs put right) and tested by its kind's rule: a checksum,
ranges of numbers, an international prefix, the make-up of a key. Boosted trees see none of what is tested,
but the candidate's format and the words and signs around it, and learn on all candidates of the corpus how
surely one of such a look passes. Models of each half of the candidates are tried on the other half; per
kind, the lowest threshold that keeps a precision there selects further spans, passed or not. So a mistyped
card number where card numbers stand is found, and a serial number that looks like one is not. Base spans
always stay.

All on the main path is DataFrame expressions. A text is cut at a generator's matches; the lengths of the
parts, summed up within the text, give the places. Patterns start at the first character a match can
start with and never back off into what they have read, so time is linear in a text's length.

Defined results: null texts count as empty and have no spans; repeated rows have the same spans each; an
empty table gives an empty table; without candidates there is no model and nothing is added; extra columns
are ignored by ``decided`` and kept by ``redact``. Texts are read whole; places are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assize.llm import boosting
from assize.llm.names import free
from assize.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Further kinds that the method's generators add.
MORE_KINDS = ("secret",)

# Patterns equal to these, but of linear time (possessive, and begun where a run begins):
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of high recall: what names the kind, the pattern, a sign that must be there.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+(?:@|\[at\]|\(at\)) ?+[A-Za-z0-9-]++(?: ?+(?:\.|\[dot\]|\(dot\)) ?+[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?+(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?+[0-9]{1,3}+){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .\-/]?+[0-9]{4}){2}(?:[ .\-/]?+[0-9]{1,7}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?+\(?+[0-9]{1,4}+\)?+[ .\-/]\(?+[0-9]{2,4}+\)?+[ .\-/][0-9]{2,4}+(?:[ .\-/][0-9]{2,4}+)?+(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-zA-Z_\-]{32,}+",
}
#: The share of candidates that pass their rule, among those a threshold selects.
PRECISION = 0.9
FOLDS = 2
#: Combinations of features told apart at most.
COMBINATIONS = 50_000
FEATURES = ["kind", "groups", "marks", "head", "left", "right", "cue", "long"]
_AROUND = 24


def _found(text: Column, name: str, pattern: str, base: bool) -> tuple[Column, Column]:
    """A pattern's matches in a text and the parts between them; null where a sign that it needs is missing."""
    sign = F.contains(text, F.lit("@")) if (name, base) == ("email", True) else F.lit(True) if name in ("email", "secret") else text.rlike("[0-9]")
    return F.when(sign, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(sign, F.split(text, pattern, -1))


def _items(hits: str, parts: str, name: str, base: bool) -> Column:
    """For every match the length of the part before it, itself and what is around."""

    def item(hit: Column, at: Column) -> Column:
        before = F.get(F.col(parts), at)
        return F.struct(
            F.lit(name).alias("kind"), F.lit(base).alias("base"), at.alias("at"), hit.alias("hit"),
            F.length(before).alias("gap"), F.right(before, F.lit(_AROUND)).alias("before"), F.left(F.get(F.col(parts), at + 1), F.lit(1)).alias("after"),
        )

    return F.transform(F.col(hits), item)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"


def _valid() -> Column:
    """Whether a base candidate stands."""
    size, kind = F.length("digits"), F.col("kind")
    return F.when(kind == "email", True).when(kind == "ip", F.col("hit").rlike(_OCTETS)).when(kind == "card", F.col("card")).when(kind == "phone", (size >= 9) & (size <= 15)).otherwise(False)


def _passes() -> Column:
    """Whether a proposed candidate, written out plainly, passes its kind's rule."""
    hit, kind = F.col("hit"), F.col("kind")
    dotted = F.regexp_replace(hit, r" ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?", ".")
    email = F.regexp_replace(dotted, r" ?(?:@|\[at\]|\(at\)) ?", "@").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")
    size = F.length("digits")
    phone = (size >= 9) & (size <= 15) & hit.rlike(r"^(?:\+|00)")
    secret = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.length(F.regexp_replace(hit, "[0-9]", "")) <= 0.95 * F.length(hit))
    return F.when(kind == "email", email).when(kind == "ip", dotted.rlike(_OCTETS)).when(kind == "card", F.col("card")).when(kind == "phone", phone).when(kind == "secret", secret).otherwise(False)


def _features() -> dict[str, Column]:
    """The features of a candidate, each a small number. None says what the rule of its kind tests."""
    hit, before = F.col("hit"), F.lower("before")
    marks = F.when(hit.rlike("[(\\[]"), 4).when(F.contains(hit, F.lit("/")), 3).when(F.contains(F.regexp_replace(hit, "@.*", ""), F.lit(".")), 2).when(hit.rlike("[ -]"), 1).otherwise(0)
    first = F.regexp_extract(hit, r"^(?:\+|00)?\(?(.)", 1)
    head = F.when(F.col("kind").isin("ip", "secret"), 0).when(first.rlike("[0-9]"), first.cast("int")).when(first.rlike("[A-Z]"), 10).otherwise(11)
    side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"\s$"), 1).when(c.rlike(r"[A-Za-z0-9]$"), 2).otherwise(3)
    cue = (
        F.when(before.rlike(r"(?:token|secret|passw\w*|api.?key|key)\W*$"), 1)
        .when(before.rlike(r"(?:tel|phone|call|fax|mobile|whatsapp)\w*\W*$"), 2)
        .when(before.rlike(r"(?:card|visa|credit|iban|account)\w*\W*$"), 3)
        .when(before.rlike(r"(?:e-?mail|contact|write to|from|to)\W*$"), 4)
        .when(before.rlike(r"(?:serial|part|order|invoice|version|isbn|ref|no)\w*\W*$"), 5)
        .otherwise(0)
    )
    kinds = (*KINDS, *MORE_KINDS)
    kind = sum((F.when(F.col("kind") == k, n).otherwise(0) for n, k in enumerate(kinds)), F.lit(0))
    groups = F.least(F.regexp_count(hit, F.lit("[A-Za-z0-9]+")), F.lit(7))
    return {
        "f_kind": kind, "f_groups": groups, "f_marks": marks, "f_head": head,
        "f_left": side(F.right("before", F.lit(1))), "f_right": side(F.col("after")), "f_cue": cue, "f_long": F.least(F.floor(F.length(hit) / 8), F.lit(6)).cast("int"),
    }


def candidates(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, row, kind, base, valid, passes, fold, start, stop, features) of all candidates; every row of ``docs`` has one at least, of null kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    patterns = [*[(k, p, True) for k, p in BASE.items()], *[(k, p, False) for k, p in GENERATORS.items()]]
    # matches and parts are columns of their own, so that each is made once
    cuts = [c for n, p in enumerate(patterns) for c in zip((f"hits_{n}", f"parts_{n}"), _found(F.col("_text"), *p))]
    matched = rows.select("row", *keys, *[c.alias(name) for name, c in cuts])
    nothing = F.array().cast("array<struct<kind:string,base:boolean,at:int,hit:string,gap:int,before:string,after:string>>")
    every = F.concat(*[F.coalesce(_items(f"hits_{n}", f"parts_{n}", k, base), nothing) for n, (k, _, base) in enumerate(patterns)])
    rows = matched
    each = rows.select("row", *keys, F.explode_outer(every).alias("c")).select("row", *keys, "c.*")
    order = W.partitionBy("row", "kind", "base").orderBy("at")
    stop = F.sum(F.col("gap") + F.length("hit")).over(order)
    placed = each.withColumn("stop", stop.cast("long")).withColumn("start", F.col("stop") - F.length("hit"))
    fold = F.pmod(F.xxhash64("hit", "before"), F.lit(FOLDS)).cast("int")
    placed = placed.withColumn("digits", F.when(F.col("kind").isin("card", "phone"), _digits(F.col("hit"))))
    placed = placed.withColumn("card", F.when((F.col("kind") == "card") & F.length("digits").between(12, 19), luhn(F.col("digits"))).otherwise(False))
    described = placed.withColumns({**_features(), "valid": F.col("base") & _valid(), "passes": ~F.col("base") & _passes(), "fold": fold})
    return described.select("row", *keys, "kind", "base", "valid", "passes", "fold", "start", "stop", *[f"f_{n}" for n in FEATURES])


def _combinations(proposed: DataFrame, names: list[str], most: int = COMBINATIONS) -> DataFrame:
    """(fold, names, n, ones): how often each combination of features occurs, and passes.

    Those that hold less than one in ``most`` of the candidates are merged by kind, fold and their second feature, the
    others being put to their least value; so no more than ``most`` and those merged reach the driver, whatever the corpus.
    """
    counted = cut(proposed.groupBy("fold", *names).agg(F.count("*").alias("n"), F.count_if("passes").alias("ones")))
    total, *least = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.min(n), F.lit(0)) for n in names]).first()
    rare = F.col("n") < total / most
    merged = [F.when(rare & F.lit(k > 1), F.lit(low)).otherwise(F.col(n)).alias(n) for k, (n, low) in enumerate(zip(names, least))]
    return counted.select("fold", *merged, "n", "ones").groupBy("fold", *names).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def decided(docs: DataFrame, keys: list[str], text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(keys, row, spans): an array of (start, order, stop, kind, base, reach) a row, sorted; base spans and what the model adds.

    ``reach`` is where the spans before end.
    """
    found = cut(candidates(docs, keys, text_col))
    names = [f"f_{n}" for n in FEATURES]
    proposed = found.where("not base")
    counted = _combinations(proposed, names).collect()
    folds = [[(tuple(r[n] for n in names), r["n"], r["ones"]) for r in counted if r["fold"] == k] for k in range(FOLDS)]
    chosen = proposed.where("false")
    rank = F.create_map(*[F.lit(x) for pair in enumerate((*KINDS, *MORE_KINDS)) for x in (pair[1], pair[0])])
    if counted:
        model = boosting.fit([c for fold in folds for c in fold], names)
        held, kinds = boosting.cross_fitted(folds, names), (*KINDS, *MORE_KINDS)
        bars = {k: boosting.threshold([(p, n, ones) for values, p, n, ones in held if kinds[values[0]] == k], precision) for k in GENERATORS}
        bar = F.create_map(*[F.lit(x) for pair in bars.items() for x in pair])[F.col("kind")]
        # what a base span of the kind covers is found already
        base = found.where("valid").select(F.col("row").alias("r"), F.col("kind").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"))
        inside = (F.col("row") == F.col("r")) & (F.col("kind") == F.col("k")) & (F.col("s") <= F.col("start")) & (F.col("stop") <= F.col("e"))
        chosen = proposed.where(model.column() >= bar).join(base, inside, "left_anti")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank[F.col("kind")].alias("order"), "stop", "kind", F.col("base").alias("base")))
    every = found.select("row", *keys, F.when(F.col("valid"), span).alias("span")).union(chosen.select("row", *keys, span.alias("span")))
    order = W.partitionBy("row").orderBy("span")
    reach = F.coalesce(F.max("span.stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = every.withColumn("reach", reach).withColumn("again", F.coalesce(F.lag("span").over(order) == F.col("span"), F.lit(False)))
    full = F.when(F.col("span").isNotNull() & ~F.col("again"), F.struct("span.*", "reach"))
    return placed.groupBy("row").agg(*[F.first(k).alias(k) for k in keys], F.array_sort(F.collect_list(full)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its numbers of base spans, their digest, and all spans, those that the model adds among them."""
    found = decided(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


#: Code points of a text that are looked up together.
PIECE = 1_000


def redacted(text: Column, spans: Column) -> Column:
    """A text with every span, or run of overlapping spans, replaced by the first one's kind in brackets.

    ``spans`` is sorted. A span's part is what lies between the end of all spans before it and its start. The
    text is first cut into pieces, so a place is found within its piece and time is linear in the text.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(start: Column, stop: Column) -> Column:
        a, b = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
        head = F.substring(F.get(pieces, a), (start - a * PIECE + 1).cast("int"), F.when(a == b, (stop - start).cast("int")).otherwise(PIECE))
        middle = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        tail = F.when(a < b, F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), (stop - b * PIECE).cast("int"))).otherwise("")
        return F.concat(F.coalesce(head, F.lit("")), middle, tail)

    part = lambda s: F.when(s["start"] >= s["reach"], F.concat(between(s["reach"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
    last = F.greatest(F.element_at(spans, -1)["reach"], F.element_at(spans, -1)["stop"])
    rest = between(last, F.length(text).cast("long"))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, part), ""), rest)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` with personal data replaced in the texts; columns and their order stay."""
    keyed = docs.select(F.col(id_col).alias("pii_id"), F.xxhash64(F.col(text_col)).alias("pii_hash"), F.col(text_col).alias("pii_text"))
    found = decided(keyed, ["pii_id", "pii_hash"], "pii_text", precision).where(F.size("spans") > 0)
    found = found.groupBy("pii_id", "pii_hash").agg(F.first("spans").alias("pii_spans"))
    key, digest, spans = free(docs, "pii_id", "pii_hash", "pii_spans")
    rows = docs.withColumns({key: F.col(id_col), digest: F.xxhash64(F.col(text_col))})
    met = rows.alias("rows").join(found.toDF("f_id", "f_hash", "f_spans").alias("found"), F.col(f"rows.{key}").eqNullSafe(F.col("found.f_id")) & (F.col(f"rows.{digest}") == F.col("found.f_hash")), "left")
    both = met.select(*[F.col(f"rows.`{c}`") for c in docs.columns], F.col("found.f_spans").alias(spans))
    clean = F.when(F.col(spans).isNotNull(), redacted(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    return both.withColumn(text_col, clean).select(*docs.columns)
