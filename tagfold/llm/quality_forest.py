"""Quality rules with isolation forests over their statistics.

Two fixed rules reject short and repetitive texts (base_failed). Every other rule (RULES) looks at one or more statistics
of a text: a forest of random splits over them gives each document's mean path length, and rows that few splits set apart
are anomalous. A rule's threshold on that score is calibrated from labelled rows: rules are taken in the order of how many
rows labelled bad they find that no earlier one does, each with the score from which on it finds most while it loses
at most MOST_GOOD_LOST of the good ones; a rule that finds too few stays out. A document goes if any rule's score reaches
its threshold. Statistics, scores and thresholds cover all rows; only the trees grow on a sample, POOL rows at most.

Defined cases: a null or empty text has no words and fails the base rules; without a labelled row of each class no rule has
a threshold, so only the base rules reject; repeated rows are each judged, and labelled if their doc_id is; a null doc_id
has no label; a text of any length is counted whole; ties of a score fall on the same side; an empty table gives no rows;
extra columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm import text_stats
from tagfold.llm.common import sampled, saved

#: Most rows that the trees grow on: those with the smallest hash of doc_id and counts.
POOL = 8_192
TREES, PER_TREE = 48, 256
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Greatest share of rows labelled good that a rule may reject, and least share of those labelled bad that it must find anew.
MOST_GOOD_LOST, LEAST_FOUND = 0.002, 0.05
#: Scores are whole numbers from 0 to this.
TOP = 4_096
#: The statistics of each rule.
RULES = {
    "symbols": ("symbol_rate",),
    "lines": ("dup_line_rate",),
    "repeats": ("repeat_rate",),
    "words": ("mean_word", "unique_rate"),
    "case": ("upper_rate", "shout_rate"),
    "digits": ("digit_rate",),
    "marks": ("mark_rate",),
    "all": tuple(text_stats.FEATURES),
}


@dataclass
class Forest:
    """Random trees as arrays [tree, node]: split feature (-1: leaf), split value, left child, and the path length of leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    depth: int


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def fit(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1)
    feature, left = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32)
    value, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo, free = [(0, x[rng.choice(len(x), size, replace=False)], 0)], 1
        while todo:
            node, rows, d = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            usable = np.flatnonzero(high > low)
            if d >= depth or len(rows) <= 1 or not len(usable):
                length[t, node] = d + float(expected_path(len(rows)))
                continue
            f = rng.choice(usable)
            cut = rng.uniform(low[f], high[f])
            feature[t, node], value[t, node], left[t, node] = f, cut, free
            below = rows[:, f] <= cut
            todo += [(free, rows[below], d + 1), (free + 1, rows[~below], d + 1)]
            free += 2
    return Forest(feature, value, left, length, float(max(expected_path(size), 1e-9)), depth)


def scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly in 0..1: 2 ** -(mean path length / expected length); higher is stranger."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, value, left, length in zip(forest.feature, forest.value, forest.left, forest.length):
        at = np.zeros(len(x), np.int64)
        for _ in range(forest.depth):
            f = feature[at]
            go = f >= 0
            right = x[rows, np.maximum(f, 0)] > value[at]
            at = np.where(go, left[at] + right, at)
        total += length[at]
    return 2.0 ** -(total / len(forest.length) / forest.norm)


def threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray, all_good: int, most_good_lost: float = MOST_GOOD_LOST) -> tuple[int, int]:
    """The score from which on documents go and the bad rows that it finds, given numbers of good and bad rows by score.

    The most bad rows are found while at most the given share of all_good is lost; of equal cuts the highest counts.
    """
    order = np.argsort(-score, kind="stable")
    score, lost, found = score[order], np.cumsum(good[order]), np.cumsum(bad[order])
    fine = np.flatnonzero((lost <= most_good_lost * all_good) & (bad[order] > 0))
    if not len(fine):
        return TOP + 1, 0
    best = fine[-1]
    # halfway to the next score below, so that what is a little less strange than these goes too
    below = score[best + 1] if best + 1 < len(score) else score[best] - 1
    return int(score[best] + below + 1) // 2, int(found[best])


@dataclass
class Model:
    """A forest for each rule, and the thresholds of the rules that have one."""

    forests: dict[str, Forest] = field(default_factory=dict)
    cuts: dict[str, int] = field(default_factory=dict)

    def rule_scores(self, counts: np.ndarray, rules: list[str]) -> np.ndarray:
        """Whole-number scores, a column for each of rules."""
        x = text_stats.features(counts)
        return np.stack([np.round(TOP * scores(self.forests[r], x[:, of(r)])).astype(int) for r in rules], 1) if rules else np.zeros((len(counts), 0), int)

    def anomaly(self, counts: np.ndarray) -> np.ndarray:
        """The greatest share of a rule's threshold that a row reaches: 1 or more is anomalous."""
        rules = list(self.cuts)
        return (self.rule_scores(counts, rules) / np.array([self.cuts[r] for r in rules])).max(1, initial=0.0) if rules else np.zeros(len(counts))


def of(rule: str) -> list[int]:
    """Indices of a rule's statistics among the features."""
    return [list(text_stats.FEATURES).index(f) for f in RULES[rule]]


def grown(counts: np.ndarray) -> Model:
    """The forests of all rules on rows of counts; base-failed rows take no part, since they go anyway."""
    x = text_stats.features(counts[~failed(counts)])
    return Model({r: fit(x[:, of(r)]) for r in RULES} if len(x) >= 2 else {})


def fit_model(counted: DataFrame, labels: DataFrame, pool: int = POOL) -> Model:
    """counted: doc_id and text_stats.COUNTS of all rows, saved."""
    names = list(text_stats.COUNTS)
    got = sampled(counted.select("doc_id", *names), pool, "doc_id", *names).select(*names).toPandas()
    model = grown(got.to_numpy(np.int64).reshape(len(got), len(names)))
    if not model.forests:
        return model
    rules = list(RULES)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[1:]], 1) if b.num_rows else np.zeros((0, len(names)), np.int64)
            use = ~failed(x)
            found = model.rule_scores(x[use], rules)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[use] > 0), pa.array(list(found), pa.list_(pa.int32()))], names=["good", "scores"])

    labelled = saved(counted.join(known, "doc_id").select("_quality", *names).mapInArrow(score, "good boolean, scores array<int>"), "quality-scores")
    sizes = {r["good"]: r["n"] for r in labelled.groupBy("good").agg(F.count("*").alias("n")).collect()}
    while len(sizes) == 2 and len(model.cuts) < len(rules):
        caught = F.exists(F.array(*(F.col("scores")[rules.index(r)] >= c for r, c in model.cuts.items())), lambda x: x) if model.cuts else F.lit(False)
        # one row for each rule and score, whatever the number of labels
        by = labelled.where(~caught).select("good", F.posexplode("scores").alias("rule", "score")).groupBy("rule", "score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas()
        best = max(((found, -i, cut) for i, r in enumerate(rules) if r not in model.cuts for h in [by[by.rule == i]] if len(h) for cut, found in [threshold(h.score.to_numpy(), h.good.to_numpy(), h.bad.to_numpy(), sizes[True])]), default=(0, 0, 0))
        if best[0] < max(1, LEAST_FOUND * sizes[False]):
            break
        model.cuts[rules[-best[1]]] = best[2]
    return model


def failed(x: np.ndarray) -> np.ndarray:
    n, again = x[:, text_stats.COUNTS.index("n_words")], x[:, text_stats.COUNTS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def kept_by(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly and kept of rows of counts."""
    base, odd = failed(counts), model.anomaly(counts)
    return base, odd, ~base & (odd < 1)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, pool: int = POOL) -> DataFrame:
    """docs' columns keep (default doc_id), the base counts, base_failed, anomaly (double) and kept, one row per row of docs.

    Texts are counted once; keep has no name of text_stats.COUNTS.
    """
    keep = list(dict.fromkeys([*(keep or ["doc_id"]), "doc_id"]))
    counted = saved(text_stats.with_counts(docs, keep), "quality-counts")
    model = fit_model(counted, labels, pool)
    shown, n = text_stats.COUNTS[:5], len(text_stats.COUNTS)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in shown), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[-n:]], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + len(shown)], *map(pa.array, kept_by(model, x))], names=schema.names)

    return counted.mapInArrow(run, schema)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever these are called."""
    model = fit_model(saved(text_stats.with_counts(docs.select("doc_id", "text"), ["doc_id"]), "quality-counts"), labels)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        return pa.array(kept_by(model, text_stats.counted(text))[2])

    return docs.where(kept("text"))
