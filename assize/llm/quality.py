"""Quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small trees are grown on labelled rows; every path from a root is a
rule, a conjunction of comparisons of statistics. A lasso logistic regression weighs the rules and leaves
most of them out; the rest are compiled into one Spark expression, so scoring runs without Python.

Defined results: null texts count as empty, and empty texts have a score like any other; repeated rows and
ties score alike; an empty table gives an empty table; without labels of both kinds the score is the share
of label 1, or one half without any. Labels are read by id alone, the largest of several of an id; of several rows of an
id that of the least statistics is learned from; equal texts of unlike labels are examples each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows a model is fitted to at most; those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, TREE_ROWS, CUTS, SEED = 60, 3, 2_000, 24, 5
#: Lasso penalties tried, each a share of a row's loss.
PENALTIES = (0.02, 0.008, 0.003, 0.001)


def statistics(text: Column) -> list[Column]:
    """A text's statistics by name, each made from columns ``s_text`` and ``s_words``; see ``described``."""
    n, words, size = F.length("s_text"), F.col("s_words"), F.greatest(F.size("s_words"), F.lit(1))
    without = lambda pattern: n - F.length(F.regexp_replace("s_text", pattern, ""))
    per_char = lambda c: c / F.greatest(n, F.lit(1))
    lines = F.split("s_text", "\n")
    twins = F.size(F.filter(words, lambda w, k: (k > 0) & (w == F.get(words, k - 1))))
    return [
        F.log1p(F.size(words)).alias("log_words"),
        (n / size).alias("chars_per_word"),
        (F.size(F.array_distinct(words)) / size).alias("distinct_words"),
        (twins / size).alias("repeated_words"),
        per_char(without(r"\p{Lu}+")).alias("upper"),
        per_char(without(r"[#$%&*+/<=>@\\^_`|~]+")).alias("signs"),
        per_char(without(r"[!?]+")).alias("shouts"),
        per_char(without(r"[.,;:]+")).alias("stops"),
        per_char(without(r"[0-9]+")).alias("digits"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
        (F.size(words) / F.size(lines)).alias("words_per_line"),
    ]


def described(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of every row's whole text."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("s_text"))
    rows = rows.withColumn("s_words", F.array_remove(F.split("s_text", r"[ \t-\r]+"), ""))
    return rows.select(*keep, *statistics(F.col("s_text")))


NAMES = ["log_words", "chars_per_word", "distinct_words", "repeated_words", "upper", "signs", "shouts", "stops", "digits", "distinct_lines", "words_per_line"]

Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """An intercept and weighed rules; a rule is a set of (statistic, above, cut)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The probability of label 1 from columns of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: Rule = ()) -> set[Rule]:
    """The rules of a tree grown on Gini impurity, each node on some of the statistics."""
    out = {path} if path else set()
    if not depth or len(y) < 20 or y.min() == y.max():
        return out
    best = (1e-9, -1, 0.0)
    for k in rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False):
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS))):
            left = x[:, k] <= cut
            n = left.sum()
            if 5 <= n <= len(y) - 5:
                p, q, r = y[left].mean(), y[~left].mean(), y.mean()
                gain = r * (1 - r) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = (gain, int(k), float(cut))
    if best[1] < 0:
        return out
    left = x[:, best[1]] <= best[2]
    for above, side in ((False, left), (True, ~left)):
        step = (NAMES[best[1]], above, best[2])
        out |= _paths(x[side], y[side], depth - 1, rng, tuple(sorted({*path, step})))
    return out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        value = x[:, NAMES.index(name)]
        out &= value > cut if above else value <= cut
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Lasso logistic regression by accelerated proximal gradient steps; the intercept is free."""
    centre = z.mean(axis=0)
    zc = z - centre
    rate = 4.0 / (np.linalg.norm(zc, 2) ** 2 / len(y) + 1)
    w, seen = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    b = seen_b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for step in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(zc @ seen + seen_b, -40, 40))) - y
        new = seen - rate * (zc.T @ miss) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = seen_b - rate * miss.mean()
        share = step / (step + 3)
        seen, seen_b, w, b = new + share * (new - w), new_b + share * (new_b - b), new, new_b
    return w, b - float(centre @ w)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from trees on random rows, weighed by the lasso; the penalty is chosen on every fourth row."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(SEED)
    rules: set[Rule] = set()
    for _ in range(TREES):
        some = rng.choice(len(y), min(len(y), TREE_ROWS), replace=False)
        rules |= _paths(x[some], y[some], DEPTH, rng)
    listed = sorted(rules)
    z = np.array([_holds(r, x) for r in listed], np.float32).T if listed else np.zeros((len(y), 0), np.float32)
    test = np.arange(len(y)) % 4 == 3
    loss = {}
    for penalty in PENALTIES:
        w, b = _lasso(z[~test], y[~test], penalty)
        p = 1 / (1 + np.exp(-np.clip(z[test] @ w + b, -40, 40)))
        # too few rows to hold any out leave the strongest penalty
        loss[penalty] = -float(np.mean(np.log(np.where(y[test] == 1, p, 1 - p) + 1e-9))) if test.any() else 0.0
    # the strongest penalty whose loss is near the best
    chosen = max((p for p in PENALTIES if loss[p] <= 1.02 * min(loss.values())), default=max(PENALTIES))
    w, b = _lasso(z, y, chosen)
    return RuleModel(b, tuple((listed[k], float(w[k])) for k in np.nonzero(w)[0]))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> RuleModel:
    """A model of ``labels`` (id, label), fitted to at most ``max_rows`` of them."""
    marked = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    ids = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows).select(F.col("id").alias("label_id"), F.col("label").alias("label_value"))
    texts = docs.select(id_col, text_col)
    sample = texts.join(F.broadcast(ids), texts[id_col] == F.col("label_id"))
    # one row a label, however many rows have its id
    one = described(sample, [id_col, "label_value"], text_col).groupBy(id_col, "label_value").agg(F.min(F.struct(*NAMES)).alias("row"))
    rows = one.orderBy(F.xxhash64(id_col)).select("label_value", "row.*").collect()
    return fit(np.array([[float(r[n]) for n in NAMES] for r in rows]).reshape(-1, len(NAMES)), np.array([float(r["label_value"]) for r in rows]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score, learned from labels whose crc32(doc_id) mod 4 is not 2; null texts count as empty.

    A null doc_id is of remainder 0 and has no label; rows of one id are scored each by its own text.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    part = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) % 4
    learn = labels.where(part("doc_id") != 2).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = trained(docs, learn)
    scored = described(docs, ["doc_id"]).select("doc_id", (part("doc_id") == 2).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
