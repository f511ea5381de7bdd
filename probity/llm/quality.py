"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Statistics of each text are Spark columns. Small regression trees are grown by gradient boosting on a bounded sample
of labelled rows; each path from a root becomes a conjunctive rule over statistics, and a lasso logistic
regression over all rules keeps a few of them. The score is the logistic of the kept rules' weights, as one
expression, so scoring is a projection over any number of documents.

The sample holds at most `max_rows` labelled rows, those with the smallest digest of their doc_id; the model is fitted to it in one
task, and only the model reaches the driver. Labels, lang, source and doc_id are no inputs of a score.

Cases: null and empty texts have all statistics 0 and get a score like any other; without labelled rows the score is 0.5, with one
class only it is that class's smoothed share; null labels are left out; a doc_id labelled twice counts twice; repeated
rows are scored alike; other columns pass through `score` untouched.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import SPACES, fresh, let, table, words
from probity.llm.rules import STOP_WORDS

MAX_ROWS = 20_000
FEATURES = (
    "n_words", "mean_word_length", "symbols", "capitals", "digits", "exclamations", "bars", "punctuation", "stop_words", "distinct_words",
    "repeated_neighbours", "short_words", "long_words", "distinct_lines", "words_a_line", "closed_lines",
)


def features(text: Column) -> Column:
    """Struct of the statistics of a text."""
    t = F.coalesce(text, F.lit(""))
    matched = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def of(w: Column, ls: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(F.array_join(w, "")), F.lit(1)).cast("double")
        n_lines = F.greatest(F.size(ls), F.lit(1)).cast("double")
        count = lambda test: F.size(F.filter(w, test))
        return F.struct(*[x.cast("double").alias(name) for name, x in zip(FEATURES, (
            F.size(w), F.length(F.array_join(w, "")) / n, matched(r"[#$%&*<>^~@{}\[\]]+") / chars, matched(r"\p{Lu}+") / chars, matched("[0-9]+") / chars, matched("!+") / chars,
            matched(r"\|+") / n, matched("[.,;:?]+") / n, count(lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))) / n, F.size(F.array_distinct(w)) / n,
            F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)) / n,
            count(lambda x: F.length(x) < 3) / n, count(lambda x: F.length(x) > 14) / n, F.size(F.array_distinct(ls)) / n_lines, F.size(w) / n_lines,
            F.size(F.filter(ls, lambda x: x.rlike(r"[.!?]\s*$"))) / n_lines,
        ), strict=True)])

    return let(F.struct(words(text).alias("w"), lines.alias("l")), lambda x: of(x["w"], x["l"]))


@dataclass(frozen=True)
class RuleEnsemble:
    """rules: ((feature, is_greater, threshold), ...) each; score = logistic(bias + weights of the rules that hold)."""

    bias: float
    weights: tuple[float, ...]
    rules: tuple[tuple[tuple[str, bool, float], ...], ...]

    def of(self, text: Column) -> Column:
        """The score of a text; its statistics stand in the plan once, whatever filters are pushed."""
        return let(features(text), self.column)

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for weight, rule in zip(self.weights, self.rules, strict=True):
            holds = F.lit(True)
            for name, greater, at in rule:
                holds = holds & ((stats[name] > F.lit(at)) if greater else (stats[name] <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _best_split(x: np.ndarray, residual: np.ndarray, least: int):
    """(gain, feature, threshold) of the split that lowers the squared error most."""
    best = (1e-9, -1, 0.0)
    total, n = residual.sum(), len(residual)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(residual[order])[:-1]
        k = np.arange(1, n)
        gain = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
        gain[(v[1:] <= v[:-1]) | (k < least) | (n - k < least)] = -np.inf
        if len(gain) and (i := int(np.argmax(gain))) >= 0 and gain[i] > best[0]:
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def _paths(x: np.ndarray, residual: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """Rules of all nodes below the root of a tree fitted to the residual, and the tree's predictions."""
    found, predicted = [], np.zeros(len(residual))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        predicted[rows] = residual[rows].mean()
        gain, f, at = _best_split(x[rows], residual[rows], least) if left and len(rows) >= 2 * least else (0, -1, 0)
        if f < 0:
            return
        high = x[rows, f] > at
        for greater, part in ((False, rows[~high]), (True, rows[high])):
            rule = (*path, (f, greater, at))
            found.append(rule)
            grow(part, rule, left - 1)

    grow(np.arange(len(residual)), (), depth)
    return found, predicted


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, at in rule:
        out &= (x[:, f] > at) == greater
    return out


def _lasso(full: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Lasso logistic regression by accelerated proximal gradient steps; the first column, of ones, is the bias and is not penalised."""
    n = len(y)
    scale = 0.25 * float(np.linalg.eigvalsh((full.T @ full).astype(float))[-1]) / n + 1e-9
    w = z = np.zeros(full.shape[1])
    w[0] = z[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ z.astype(full.dtype), -30, 30))) - y).astype(full.dtype) / n
        new = z - grad / scale
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / scale, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1e-3, seed: int = 7) -> RuleEnsemble:
    """Rules from boosted trees, each grown on half of the rows, then lasso weights; the same rows in any order give the same model."""
    if len(y) == 0:
        return RuleEnsemble(0.0, (), ())
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), (), ())
    rng, rules, margin = np.random.default_rng(seed), {}, np.zeros(len(y))
    for _ in range(trees):
        half = rng.random(len(y)) < 0.5
        if not half.any():
            continue
        residual = y - 1 / (1 + np.exp(-margin))
        found, _ = _paths(x[half], residual[half], depth, max(3, len(y) // 400))
        for rule in found:
            rules.setdefault(rule)
        leaves = [r for r in found if not any(o[: len(r)] == r and len(o) > len(r) for o in found)]
        for rule in leaves:
            inside = _holds(x, rule)
            p = 1 / (1 + np.exp(-margin[inside]))
            margin[inside] += rate * (y[inside] - p).sum() / max((p * (1 - p)).sum(), 1e-3)
    if not rules:
        share = y.mean()
        return RuleEnsemble(float(np.log(share / (1 - share))), (), ())
    kept, seen = [], set()
    for rule in rules:  # rules that hold for the same rows are one rule
        inside = _holds(x, rule)
        if 0 < inside.sum() < len(y) and (mark := hashlib.blake2b(np.packbits(inside).tobytes(), digest_size=16).digest()) not in seen:
            seen.add(mark)
            kept.append(rule)
    full = np.ones((len(y), len(kept) + 1), np.float32)  # filled in place: the driver's memory is small
    for k, rule in enumerate(kept, 1):
        full[:, k] = _holds(x, rule)
    bias, weights = _lasso(full, y, penalty)
    used = [i for i in np.argsort(-np.abs(weights), kind="stable") if abs(weights[i]) > 1e-6]
    return RuleEnsemble(bias, tuple(float(weights[i]) for i in used), tuple(tuple((names[f], g, at) for f, g, at in kept[i]) for i in used))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(label, statistics) of labelled rows that are not held out: at most max_rows labels, and at most 2 * max_rows rows of docs, whatever their length."""
    asked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    asked = asked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label").limit(max_rows)
    # at most max_rows pairs of numbers, so broadcasting them is safe at any size
    rows = docs.select("doc_id", "text").join(F.broadcast(asked), "doc_id").select("label", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")).alias("mark"), features(F.col("text")).alias("f")).select("label", "mark", "f.*")
    # a doc_id may occur more than once in docs: the bound holds for the rows that are fitted, too; a digest says which, so that no length is preferred
    return rows.orderBy("mark", "label").limit(2 * max_rows).select("label", *FEATURES)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, **how) -> RuleEnsemble:
    """Fits on the bounded sample, in one task."""
    rows = sample(docs, labels, label, max_rows).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", *FEATURES)]) for b in batches]
        table_ = np.concatenate(parts) if parts else np.empty((0, 1 + len(FEATURES)))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(fit(table_[:, 1:], table_[:, 0], **how)))])], ["model"])

    found = rows.mapInArrow(run, "model string").first()  # no row if no partition holds one
    if found is None:
        return fit(np.empty((0, len(FEATURES))), np.empty(0), **how)
    model = json.loads(found[0])
    return RuleEnsemble(model["bias"], tuple(model["weights"]), tuple(tuple((name, greater, at) for name, greater, at in rule) for rule in model["rules"]))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on)."""
    s, p = fresh(docs, "score", "predicted")
    return docs.withColumn(s, model.of(F.col("text"))).withColumn(p, (F.col(s) >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ORACLE = None
