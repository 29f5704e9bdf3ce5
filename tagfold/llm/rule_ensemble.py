"""Quality classifier: a sparse ensemble of rules.

Small trees on random parts of the training rows give conjunctive rules over text statistics; lasso logistic regression
keeps few of them; the result is compiled into one Spark column expression. It is fitted on at most LABELLED labelled
documents, those with the smallest hashes, and never on held-out ones; every document is scored. Labels, lang, source
and doc_id are no inputs of a score.

Defined cases: a null text counts as empty and gets a score too; with labels of one class only (or none) the score is
that class's smoothed rate for every document; a null doc_id is not held out and has no label; repeated rows are each
scored, and a doc_id that repeats is trained on with each of its texts; texts of any length are counted whole; equal
features give equal scores; an empty table gives no rows; extra columns of any name are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagfold.llm import text_stats
from tagfold.llm.common import sampled

LABELLED = 16_384
TREES, DEPTH, CUTS, ROWS_PER_TREE = 48, 3, 24, 2_048
#: Weight of the lasso penalty against the mean log loss.
PENALTY = 0.002
HELD_OUT = 1

Rule = tuple[tuple[int, bool, float], ...]  # (feature, whether above, value), all of which must hold


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == HELD_OUT


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """Rules of all nodes but the root of a tree: the split that lessens Gini impurity most, on a random half of the features."""
    if depth == 0 or len(y) < 16 or y.min() == y.max():
        return []
    best: tuple[float, int, float] | None = None
    for f in rng.permutation(x.shape[1])[: max(2, (x.shape[1] + 1) // 2)]:
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])):
            below = x[:, f] <= cut
            n = below.sum()
            if 4 <= n <= len(y) - 4:
                a, b = y[below].mean(), y[~below].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(cut))
    if best is None:
        return []
    _, f, cut = best
    below = x[:, f] <= cut
    low, high = (*path, (f, False, cut)), (*path, (f, True, cut))
    return [low, high, *grow(x[below], y[below], rng, depth - 1, low), *grow(x[~below], y[~below], rng, depth - 1, high)]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) == above
    return ok


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps; the bias is not penalised."""
    n, k = a.shape
    w, bias, v, vb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    top = np.linalg.norm(np.c_[a, np.ones(n)], 2) ** 2 / (4 * n)
    rate = 1 / max(top, 1e-9)
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(a @ v + vb, -30, 30))) - y
        step = v - rate * (a.T @ off) / n
        new, new_bias = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), vb - rate * off.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, float(bias)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Ensemble:
    """x: features of training rows, y: 0 or 1."""
    good = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(bias=float(np.log(good / (1 - good))))
    rng = np.random.default_rng(seed)
    # classes of any share get an equal say in the trees
    chance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(ROWS_PER_TREE, len(y)), p=chance)
        rules.update(dict.fromkeys(grow(x[rows], y[rows], rng, DEPTH)))
    columns: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=len):  # of rules that hold for the same rows, the shortest
        columns.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
    kept = list(columns.values())
    if not kept:
        return Ensemble(bias=float(np.log(good / (1 - good))))
    w, bias = lasso_logistic(np.stack([holds(r, x) for r in kept], 1).astype(float), y.astype(float))
    use = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([kept[i] for i in use], [float(w[i]) for i in use], bias)


def predicted(model: Ensemble, x: np.ndarray) -> np.ndarray:
    """The same score as compiled(), in numpy."""
    return 1 / (1 + np.exp(-(model.bias + sum((w * holds(r, x) for r, w in zip(model.rules, model.weights)), np.zeros(len(x))))))


def compiled(model: Ensemble, of: str = "") -> Column:
    """The score as a column over text_stats.COUNTS, or over those fields of the struct column that of names."""
    counts = re.compile(r"\b(" + "|".join(text_stats.COUNTS) + r")\b")
    names = [counts.sub(rf"`{of}`.\1" if of else r"\1", f) for f in text_stats.FEATURES.values()]

    def one(rule: Rule) -> str:
        return " AND ".join(f"({names[f]}) {'>' if above else '<='} {cut!r}D" for f, above, cut in rule)

    terms = [f"{model.bias!r}D", *(f"CASE WHEN {one(r)} THEN {w!r}D ELSE 0D END" for r, w in zip(model.rules, model.weights))]
    return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Ensemble:
    """Fits on labelled documents at most, which a hash chooses from those with a label that isn't held out."""
    may = labels.where("quality is not null and doc_id is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    # of these labels alone some are broadcast, twice labelled at most
    few = sampled(may, 2 * labelled, "doc_id")
    counted = text_stats.with_counts(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), ["doc_id", "_quality"])
    # documents that repeat a doc_id are more than that: the bound is on what is collected
    got = counted.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", *text_stats.COUNTS).limit(labelled).toPandas()
    x = text_stats.features(got[list(text_stats.COUNTS)].to_numpy(np.int64).reshape(len(got), len(text_stats.COUNTS)))
    return fit(x, (got["_quality"].to_numpy(int) > 0).astype(int))


def scored(docs: DataFrame, model: Ensemble, keep: list[str]) -> DataFrame:
    """The columns keep of docs and score (double), one row per row of docs. keep has no name of text_stats.COUNTS."""
    return text_stats.with_counts(docs, keep).select(*keep, compiled(model).alias("score"))


def filtered(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents with score >= cut, with all their columns, whatever these are called."""
    model, own = train(docs, labels), "_counts_of_text"
    return docs.withColumn(own, text_stats.counts_of("text")).where(compiled(model, own) >= cut).drop(own)
