"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (digits and signs among letters, drawn-out letters, letters set apart by
spaces or points) becomes a lattice: every character may stand for itself, for the letters it is used
for, for nothing if it is a separator, and a run of one letter may stand for one or two. The Viterbi
path through the lattice under a character trigram model and the channel's costs is the restored token.
A plain token has one path only and stays as it is. The model is counted over the words of all rows; letters
beyond the most frequent ones count as one class.
A token that may join several words is also read as these: cut at its signs, and by the path through a
lattice whose separators may end a word. Signs at a token's edge that are used for letters are read both
as punctuation and as letters. Restored words of all readings, and their beginnings of some lengths, then
enter a logistic model fitted to labels.

Defined results: null and empty texts score the model's intercept; repeated rows and ties score alike;
an empty table gives an empty table; without labels every score is 0. Labels are read by id alone; equal
texts of different labels count as toxic; extra columns are ignored. Very long texts and tokens are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.llm.memory import returning
from assize.session import cut

# Characters and the letters they are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i",
}
SEPARATORS = ".-_*~'`^/\\#%&=,:;"
LEET_COST, KEEP_SIGN_COST, DROP_COST, COLLAPSE_COST = 0.7, 3.0, 0.5, 0.5

#: Labelled rows a model is fitted to at most; those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Twice the gain in log likelihood that a feature must bring by itself: one in a thousand features without meaning does.
SIGNIFICANT = 10.83
PREFIXES = (4, 5, 6, 7, 8)
CACHE = 100_000
#: Words counted in one task before partial counts are handed on.
COUNTED_AT_ONCE = 300_000

_PLAIN = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|^[$@]{2,}|[$@]{2,}$|_+$|^_+")
_RUN = re.compile(r"(.)\1\1")
#: Signs, not digits, that are used for letters.
_SIGNS = "".join(c for c in LEET if not c.isalnum())
_AT_SIGNS, _AT_OTHERS = re.compile(r"[\W_]+"), re.compile(rf"(?:(?![{re.escape(_SIGNS)}])[\W_])+")
#: What stands for the end of a word within a lattice; no token has it.
BREAK = "\n"
#: What stands for every letter that the model does not tell apart; no token has it.
RARE = "\t"
#: Letters that the model tells apart.
ALPHABET = 120


class CharModel:
    """A character trigram model with word boundaries, interpolated with lower orders.

    Letters that are not among the model's own count as one class, ``RARE``.
    """

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.letters = {c for gram in trigrams for c in gram}
        self.two: Counter = Counter()
        self.context: Counter = Counter()
        self.one: Counter = Counter()
        for gram, count in trigrams.items():
            self.context[gram[:2]] += count
            self.two[gram[1:]] += count
            self.one[gram[2]] += count
        self.two_context: Counter = Counter()
        for gram, count in self.two.items():
            self.two_context[gram[0]] += count
        self.total = sum(self.one.values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """Negative log probability of a trigram's last character after its first two."""
        if (found := self.memo.get(gram)) is None:
            if len(self.memo) >= CACHE:
                self.memo.clear()
            whole, gram = gram, "".join(RARE if c not in self.letters and c.isalpha() else c for c in gram)
            p1 = (self.one[gram[2]] + 0.1) / (self.total + 100)
            p2 = (self.two[gram[1:]] + 4 * p1) / (self.two_context[gram[1]] + 4)
            p3 = (self.three.get(gram, 0) + 4 * p2) / (self.context[gram[:2]] + 4)
            found = self.memo[whole] = -math.log(p3)
        return found


def trigrams(words: Iterable[tuple[str, int]]) -> Counter:
    grams: Counter = Counter()
    for word, count in words:
        padded = f"^^{word}$"
        for k in range(len(padded) - 2):
            grams[padded[k : k + 3]] += count
    return grams


def edges(token: str, breaks: bool = False) -> list[list[tuple[int, str, float]]]:
    """The lattice of a token: from every position, (next position, letters, channel cost). With ``breaks``, separators may end a word."""
    lattice: list[list[tuple[int, str, float]]] = []
    n = len(token)
    for k, c in enumerate(token):
        out = [(k + 1, c, 0.0 if c.isalpha() else KEEP_SIGN_COST)]
        out += [(k + 1, x, LEET_COST) for x in LEET.get(c, "")]
        if c in SEPARATORS or c == " ":
            out.append((k + 1, "", DROP_COST))
            if breaks:
                out.append((k + 1, BREAK, DROP_COST))
        if (c.isalnum() or c in LEET) and (k == 0 or token[k - 1] != c):
            stop = k + 1
            while stop < n and token[stop] == c:
                stop += 1
            if stop - k >= 2:
                letters = ([(c, 0.0)] if c.isalpha() else []) + [(x, LEET_COST) for x in LEET.get(c, "")]
                out += [(stop, x * times, cost + COLLAPSE_COST) for x, cost in letters for times in (1, 2) if stop - k > times]
        lattice.append(out)
    return lattice


#: Places of a token after which the paths still open are traced back, to let go of what they share.
TRACED = 512


def viterbi(token: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest plain form of a token, with ``breaks`` of several words; of equal paths the one whose steps sort first.

    One pass over the whole token, of any length, with back-pointers. From time to time all open paths are
    followed back to where they meet: what lies before is decided, is put out and forgotten, so memory is
    bounded by the stretch that is still open.
    """
    lattice = edges(token, breaks)
    # at every place: of each state the cost, where it comes from (place and state), and the letters of that step
    best: list[dict[str, tuple[float, int, str, str]] | None] = [{} for _ in range(len(token) + 1)]
    best[0]["^^"] = (0.0, -1, "", "")
    done: list[str] = []
    decided, ahead = 0, set()
    for k, out in enumerate(lattice):
        ahead.discard(k)
        for state, (cost, *_) in best[k].items():
            for stop, letters, price in out:
                total, last = cost + price, state
                if letters == BREAK:
                    total += model.cost(state + "$")
                    letters, last = (BREAK, "^^") if state != "^^" else ("", state)
                else:
                    for x in letters:
                        total += model.cost(last + x)
                        last = last[1] + x
                entry = (total, k, state, letters)
                if (old := best[stop].get(last)) is None or entry < old:
                    best[stop][last] = entry
                    ahead.add(stop)
        if k % TRACED == TRACED - 1:
            heads = {(at, state) for at in ahead for state in best[at]}
            decided = _decide(best, heads, decided, done)
    _, state = min((cost + model.cost(state + "$"), state) for state, (cost, *_) in best[-1].items())
    _follow(best, len(token), state, decided, done)
    return "".join(done)


def _follow(best: list, at: int, state: str, decided: int, done: list[str]) -> None:
    """Put out the letters of the path from ``decided`` to a state at a place."""
    steps = []
    while at > decided:
        _, before, state_before, letters = best[at][state]
        steps.append(letters)
        at, state = before, state_before
    done.extend(reversed(steps))


def _decide(best: list, heads: set, decided: int, done: list[str]) -> int:
    """Follow all open paths back until they meet; put out and forget what lies before. Returns the place where they meet."""
    while len(heads) > 1:
        at, state = max(heads)
        heads.discard((at, state))
        if at <= decided:
            return decided
        heads.add(best[at][state][1:3])
    if not heads or (head := heads.pop())[0] <= decided:
        return decided
    at, state = head
    _follow(best, at, state, decided, done)
    best[decided:at] = [None] * (at - decided)
    best[at] = {state: best[at][state]}
    return at


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return _EDGE.sub("", token)


def tokens(text: str) -> Iterator[str]:
    """The tokens of a text without outer punctuation; three or more single letters in a row make one more token, joined by spaces."""
    alone: list[str] = []
    for raw in text.split():
        token = raw if raw.isalpha() else core(raw)
        if len(token) == 1:
            alone.append(token)
        elif token:
            if len(alone) > 2:
                yield " ".join(alone)
            alone = []
            yield token
    if len(alone) > 2:
        yield " ".join(alone)


def _stops(signs: str) -> list[int]:
    """Where a run of equal signs ends in ``signs``, and 0."""
    return [0, *(k for k in range(1, len(signs) + 1) if k == len(signs) or signs[k] != signs[k - 1])]


def disguised(text: str) -> Iterator[str]:
    """Further readings of a text's tokens: with signs at their edges that are used for letters."""
    alone: list[str] = []
    signed = False
    for raw in [*text.split(), ""]:
        token = raw if raw.isalpha() else core(raw)
        if token and token != raw:
            at = raw.index(token)
            before, after = raw[:at], raw[at + len(token) :]
            before = before[len(before.rstrip(_SIGNS)) :]
            after = after[: len(after) - len(after.lstrip(_SIGNS))]
            for a in _stops(before[::-1]):
                for b in _stops(after):
                    if a or b:
                        yield before[len(before) - a :] + token + after[:b]
        single = token or raw
        if len(single) == 1 and (token or single in LEET):
            alone.append(single)
            signed = signed or not token
        elif token or not raw:
            if len(alone) > 2 and signed:
                yield " ".join(alone)
            alone, signed = [], False


class Restorer:
    """Restores tokens under a model and names their features; remembers a bounded number of them."""

    def __init__(self, model: CharModel, known: dict[str, int] | None = None):
        self.model, self.known = model, known
        #: How the beginnings start that are features: a word that starts otherwise has none.
        self.heads = {x[: PREFIXES[0]] for x in known if x.endswith("*")} if known is not None else set()
        self.memo: dict[str, tuple[tuple, bool]] = {}

    def restore(self, token: str) -> str:
        if _PLAIN.fullmatch(token) and not _RUN.search(token):
            return token
        if not any(c.isalpha() for c in token):
            return token
        return viterbi(token, self.model)

    def words(self, token: str) -> set[str]:
        """The words that a token may join: its parts between signs, and the likeliest path with word breaks.

        The first and the last of letters set apart may each be a word of one letter.
        """
        if token.isalnum():
            return set()
        if " " in token:
            whole = {token[a:b] for a in (0, 2) for b in (len(token), len(token) - 2) if b - a > 3}
            return {self.restore(x) for x in whole} | {word for x in whole for word in self.broken(x)}
        parts = {x for by in (_AT_SIGNS, _AT_OTHERS) for x in by.split(token)} - {token}
        out = {self.restore(x) for x in parts if len(x) > 1}
        if any(c in SEPARATORS for c in token):
            out |= self.broken(token)
        return out - {""}

    def broken(self, token: str) -> set[str]:
        """The words on the likeliest path with word breaks."""
        return set(viterbi(token, self.model, True).split(BREAK)) - {""} if any(c.isalpha() for c in token) else set()

    def names(self, token: str) -> set:
        """The features of a token: of the known ones their numbers, or else all names."""
        return {x for word in {self.restore(token), *self.words(token)} for x in self.named(word)}

    def named(self, word: str) -> list:
        """The features of one plain word."""
        if self.known is None:
            return [f"={word}", *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]
        out = [self.known[x]] if (x := f"={word}") in self.known else []
        if word[: PREFIXES[0]] in self.heads:
            out += [self.known[x] for k in PREFIXES if len(word) >= k and (x := f"{word[:k]}*") in self.known]
        return out

    def of(self, raw: str) -> tuple[tuple, int]:
        """The features of all readings of what stands between two spaces, and whether it may be a letter set apart (1), is nothing (2), or neither (0)."""
        if (found := self.memo.get(raw)) is None:
            if len(raw) > 1 and raw.isalpha():
                found = tuple(self.names(raw) if _RUN.search(raw) else self.named(raw)), 0
            else:
                token = core(raw)
                alone = 1 if len(token) == 1 or (not token and len(raw) == 1 and raw in LEET) else 0 if token else 2
                found = tuple({x for token in {*tokens(raw), *disguised(raw)} for x in self.names(token)}), alone
            if len(self.memo) >= CACHE:
                self.memo.clear()
            self.memo[raw] = found
        return found

    def features(self, text: str | None) -> set:
        out: set = set()
        lower = (text or "").lower()
        raws = lower.split()
        odd: dict[str, int] = {}
        for raw in set(raws):
            names, alone = self.of(raw)
            if names:
                out.update(names)
            if alone:
                odd[raw] = alone
        if odd and _in_a_row(odd.get(raw, 0) for raw in raws):
            for token in {*tokens(lower), *disguised(lower)}:
                if " " in token:
                    out.update(self.names(token))
        return out


def _in_a_row(kinds: Iterable[int]) -> bool:
    """Whether three letters set apart come in a row; what is nothing does not break it."""
    run = 0
    for kind in kinds:
        run = run + 1 if kind == 1 else run if kind == 2 else 0
        if run > 2:
            return True
    return False


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows: words of letters alone, which have one reading only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").lower().split())
                if len(counts) >= COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(returning(count), "word string, n long")
    plain = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    return found.withColumn("word", plain).where(r"word rlike '^[\\p{L}]{2,}$'").groupBy("word").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text", alphabet: int = ALPHABET) -> CharModel:
    """The trigram model of all rows' words. The ``alphabet`` most frequent letters are told apart, all others are one class.

    At most (alphabet + 3) cubed trigrams exist; what reaches the driver does not grow beyond that.
    """
    words = cut(word_counts(docs, text_col))
    letters = words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    common = "".join(r[0] for r in letters.orderBy(F.desc("n"), "c").limit(alphabet).collect())
    known = F.regexp_replace("word", f"[^{common}]", RARE) if common else F.col("word")
    padded = F.concat(F.lit("^^"), known, F.lit("$"))
    grams = words.select(padded.alias("p"), "n").select(F.explode(F.expr("transform(sequence(1, length(p) - 2), i -> substring(p, i, 3))")).alias("g"), "n")
    return CharModel({r[0]: r[1] for r in grams.groupBy("g").agg(F.sum("n").alias("n")).toLocalIterator()})


class ToxicModel:
    """Weights of restored words and beginnings of words."""

    def __init__(self, chars: CharModel, weights: dict[str, float], intercept: float):
        self.trigrams, self.intercept = chars.three, intercept
        self.weights = {k: v for k, v in weights.items() if v}


def fit_logistic(rows: list[list[int]], y: np.ndarray, size: int, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sets of features, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    on = np.array([k for r in rows for k in r], np.int64)
    rate = 1.0 / (0.25 * (max([len(r) for r in rows], default=0) + 1) + ridge / max(1, len(rows)))
    w, b, seen, seen_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for step in range(steps):
        z = np.bincount(at, seen[on], len(rows)) + seen_b
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        pull = (np.bincount(on, miss[at], size) + ridge * seen) / len(rows)
        new, new_b = seen - rate * pull, seen_b - rate * miss.mean()
        share = step / (step + 3)
        seen, seen_b = new + share * (new - w), new_b + share * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def _held(every: DataFrame, strong: DataFrame) -> DataFrame:
    """(key, names): the ``strong`` names of every text. These reach the driver anyway, so they go to where the many rows of ``every`` lie."""
    return every.join(F.broadcast(strong), "name").groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"))


def fit(docs: DataFrame, labels: DataFrame, chars: CharModel, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS, significant: float = SIGNIFICANT) -> ToxicModel:
    """A model of ``labels`` (id, label): features are those that tell the labels apart beyond chance.

    Equal texts are one example, of the largest of their labels; of several texts of an id one is learned from. What
    reaches the driver is bounded by ``max_rows``.
    """
    marked = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    ids = marked.orderBy(F.xxhash64(F.col("id")), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct(F.md5("text").alias("key"), "text")).alias("row"), F.max("label").alias("label"))
    sample = one.groupBy("row.key").agg(F.first("row.text").alias("text"), F.max("label").cast("int").alias("label"))
    three = docs.sparkSession.sparkContext.broadcast(chars.three)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharModel(three.value))
        for batch in batches:
            # few texts at a time: their features are many
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                names = [sorted(restorer.features(x.as_py())) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.list_(pa.string()))], names=["key", "label", "names"])

    found = cut(sample.select("key", "label", "text").mapInArrow(returning(describe), "key string, label int, names array<string>"))
    rows, ones = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not rows or not ones or ones == rows:
        return ToxicModel(chars, {}, -40.0 if not ones else 40.0)
    every = found.select("key", "label", F.explode("names").alias("name"))
    each = every.groupBy("name").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where("a >= 3")
    expected = F.col("n") * F.lit(ones / rows)
    gain = F.col("a") * F.log(F.col("a") / expected) + F.when(F.col("n") > F.col("a"), (F.col("n") - F.col("a")) * F.log((F.col("n") - F.col("a")) / (F.col("n") - expected))).otherwise(0.0)
    strong = cut(each.where((F.col("a") > 2 * expected) & (2 * gain >= significant)).select("name"))
    names = sorted(r["name"] for r in strong.collect())
    known = {name: k for k, name in enumerate(names)}
    held = _held(every, strong)
    kept = sorted((r["key"], r["label"], r["names"] or []) for r in found.select("key", "label").join(held, "key", "left").collect())
    weights, intercept = fit_logistic([[known[x] for x in names_] for _, _, names_ in kept], np.array([label for _, label, _ in kept], float), len(names))
    return ToxicModel(chars, dict(zip(names, weights.tolist())), intercept)


def scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): how likely every row's whole text is toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.trigrams, model.weights, model.intercept))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weights, intercept = shipped.value
        names = list(weights)
        value = [weights[x] for x in names]
        restorer = Restorer(CharModel(grams), {x: k for k, x in enumerate(names)})
        for batch in batches:
            out = [1 / (1 + math.exp(-max(-40.0, min(40.0, intercept + sum(value[k] for k in restorer.features(x.as_py())))))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(returning(score), f"id {kind}, score double")


def _remainder(column: str, by: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % by


def trained(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model of this corpus: characters of all documents, labels of rows that are not held out."""
    learn = labels.where(_remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(docs, learn, char_model(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score, whether it was held out, and the prediction at one half."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), (_remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; columns and their order stay."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.trigrams, model.weights, model.intercept))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weights, intercept = shipped.value
        names = list(weights)
        value = [weights[x] for x in names]
        restorer = Restorer(CharModel(grams), {x: k for k, x in enumerate(names)})
        bar = math.log(limit / (1 - limit))
        for batch in batches:
            clean = [intercept + sum(value[k] for k in restorer.features(x.as_py())) < bar for x in batch.column(place)]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(returning(keep), docs.schema)
