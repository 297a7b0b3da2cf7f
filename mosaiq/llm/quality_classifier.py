"""Quality by histogram gradient-boosted trees over document statistics.

The statistics of a text are computed in one pass over its words. Trees are grown on the driver
over a bounded sample (see ``labelled_sample``) from histograms of binned statistics, and kept as
flat arrays, through which workers send whole batches with one numpy step per level.

Defined cases: a null text is empty; an empty text, or one without words, has zero statistics and
is scored like any other; without labels of both kinds every text scores the share of label 1 (0.5
without labels); repeated rows score alike; an empty table gives an empty result. The stage returns the
columns it was given, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import fold, labelled_sample, own_names, plain_names, table
from mosaiq.plans.ship import ship

#: The training sample: rows, and the characters of all its texts.
SAMPLE, TOTAL_CHARS = 6000, 20_000_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 80, 4, 0.15, 64, 10, 1.0
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "n_words", "mean_word", "distinct_words", "distinct_windows", "same_as_next", "capital_words", "symbol_share", "pipe_words",
    "shouts", "stops", "commas", "digits", "n_lines", "distinct_lines", "words_per_line", "non_ascii", "longest_word", "title_words",
)


def statistics(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return (0.0,) * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = text.count
    return (
        n, sum(map(len, words)) / n, len(set(words)) / n**0.8, len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1),
        sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isupper, words)) / n, sum(map(count, SYMBOLS)) / n, count(" | ") / n,
        count("!") / n, (count(".") + count("?")) / n, count(",") / n, sum(map(count, "0123456789")) / size, len(lines),
        len(set(lines)) / len(lines), n / len(lines), (len(text.encode("utf-8", "replace")) - size) / size, min(max(map(len, words)), 1000), sum(map(str.istitle, words)) / n,
    )


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth as arrays [tree, node]; a row goes right where its value is above the node's."""

    base: float
    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, above, value in zip(self.feature, self.above, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the logistic loss; splits are sought in histograms of at most BINS bins."""
    inner = 2**DEPTH - 1
    none = np.zeros((0, inner), np.int64)
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if len(np.unique(y)) < 2:
        return Forest(base, none, none.astype(float), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # bin b: edges[b-1] < c <= edges[b]
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, above, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            local = node - first
            gains, places = np.full(many, 1e-6), np.full((many, 2), -1)
            for f in range(x.shape[1]):
                key = local * BINS + binned[:, f]
                g, h, c = (np.bincount(key, w, many * BINS).reshape(many, BINS).cumsum(1) for w in (grad, hess, None))
                gl, hl, cl, gt, ht, ct = g[:, :-1], h[:, :-1], c[:, :-1], g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = -1
                gain[:, len(edges[f]) :] = -1
                best = gain.argmax(1)
                better = gain[np.arange(many), best] > gains
                gains[better] = gain[np.arange(many), best][better]
                places[better, 0], places[better, 1] = f, best[better]
            for i, (f, b) in enumerate(places):
                if f >= 0:
                    feature[first + i], above[first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + PENALTY)
        total += value[leaf]
        trees.append((feature, above, value))
    return Forest(base, *(np.stack(a) for a in zip(*trees, strict=True)))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Forest:
    sample = labelled_sample(documents, labels, label, SAMPLE, TOTAL_CHARS)
    return fit(np.asarray([statistics(t) for t, _ in sample]).reshape(len(sample), len(FEATURES)), np.asarray([y for _, y in sample], float))


def with_score(documents: DataFrame, forest: Forest, text_col: str, keep: list[str], threshold: float | None = None, score_col: str = "__score") -> DataFrame:
    """The columns ``keep`` and ``score_col``; only rows from ``threshold`` on, where given."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(forest)  # some 10 KB, whatever the data
    names = [f"c{i}" for i in range(len(keep))]
    asked = documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray([statistics(t.as_py()) for t in batch.column(len(keep))], float)
                score = shared.value.predict(x)
                out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*names, "score"])
                yield out if threshold is None else out.filter(pa.array(score >= threshold))

    shape = "".join(f"{n} {asked.schema[n].dataType.simpleString()}, " for n in names)
    scored = asked.mapInArrow(run, f"{shape}score double")
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("score").alias(score_col))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    forest = train(documents, table(spark, sf_dir, "labels"))
    return with_score(documents, forest, "text", ["doc_id"], score_col="score").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more. Learned from the labelled rows of the whole corpus, as the rows handed over hold few bad ones."""
    forest = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain, of = plain_names(docs)
    return own_names(with_score(plain, forest, of["text"], plain.columns, 0.3), of)
