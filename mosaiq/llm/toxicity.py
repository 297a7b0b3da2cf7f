"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the document has a label. A sentence's score is a
logistic function of the weights of its distinct words; a word's weight is the sum of the weights
of its hashed character grams, so unseen forms of a known stem count too. Only grams that occur in
more toxic documents than chance explains are given a weight. A sentence counts by what its words add to the
score of a sentence without weighted words, so that a clean text does not turn toxic by its length. The document's score is
the noisy-or 1 - prod(1 - sentence score), and the gradient of the document's loss reaches each
sentence through it. In training a chance by document, whatever its length, stands for labels that no word explains.
Sentences with high scores are the located ones.

Training is on the driver over a bounded sample (see ``labelled_sample``); the model is one array
of fixed size. Scoring is one pass without a shuffle over whole texts.

Defined cases: a null or empty text, or one without words, scores 0; without labels of both kinds
every text scores 0; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import fold, labelled_sample, table
from mosaiq.plans.ship import ship

BITS = 22
#: The training sample: rows, and the characters of all its texts.
SAMPLE, TOTAL_CHARS = 6000, 20_000_000
#: A gram's words must occur so often (once per document), and speak for toxicity by a likelihood ratio of this size; at most MOST are kept.
LEAST_DOCS, LEAST_RATIO, MOST = 4, 20.0, 4000
ROUNDS, RATE, DECAY, START = 200, 0.1, 0.3, -5.0
KEPT_WORDS = 500_000
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W_]+")


def grams(word: str) -> list[int]:
    """Slots of the word, and of its character grams of 3 to 5 with both ends marked."""
    marked = f"<{word}>"
    parts = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
    return sorted({zlib.crc32(p.encode()) >> (32 - BITS) for p in parts})


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text.lower()) if s and not s.isspace()]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]

    def word(self, word: str) -> float:
        return sum(self.weights.get(s, 0.0) for s in grams(word))


def telling(sample: list[tuple[str, int]]) -> dict[int, int]:
    """The grams worth a weight, numbered: by the likelihood ratio of the labels of the documents with their words."""
    by_label: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in sample:
        by_label[y].update(set(WORD.findall(text.lower())))
    seen = np.zeros((2, 1 << BITS), np.int64)
    for y in (0, 1):
        for word, many in by_label[y].items():
            seen[y, grams(word)] += many
    share = by_label[1].total() / max(by_label[0].total() + by_label[1].total(), 1)
    slots = np.flatnonzero((seen.sum(0) >= LEAST_DOCS) & (seen[1] > share * seen.sum(0)))
    n, k = seen[:, slots].sum(0).astype(float), seen[1, slots].astype(float)
    ratio = 2 * (k * np.log(k / (n * share)) + np.where(n > k, (n - k) * np.log(np.maximum(n - k, 1) / (n * (1 - share))), 0))
    best = np.argsort(-ratio, kind="stable")[:MOST]
    return {int(slots[i]): j for j, i in enumerate(best[ratio[best] >= LEAST_RATIO])}


def fit(sample: list[tuple[str, int]]) -> Model:
    """Full-batch Adam on the noisy-or likelihood with a quadratic penalty; the last two states are the bias and the log of what no word explains."""
    number = telling(sample) if len({y for _, y in sample}) == 2 else {}
    if not number:
        return Model(-1e9, {})
    of_word: dict[str, list[int]] = {}
    slot_of, sentence_of, doc_of, y = [], [], [], np.asarray([label for _, label in sample], float)
    for d, (text, _) in enumerate(sample):
        for s in sentences(text):
            for w in set(WORD.findall(s)):
                if w not in of_word:
                    of_word[w] = [number[g] for g in grams(w) if g in number]
                slot_of += of_word[w]
                sentence_of += [len(doc_of)] * len(of_word[w])
            doc_of.append(d)
    slot_of, sentence_of, doc_of = (np.asarray(a, np.int64) for a in (slot_of, sentence_of, doc_of))
    state, moments = np.zeros(len(number) + 2), np.zeros((2, len(number) + 2))
    state[-2:] = START
    for step in range(1, ROUNDS + 1):
        z = state[-2] + np.bincount(sentence_of, state[slot_of], len(doc_of))
        above = z >= state[-2]
        none = np.bincount(doc_of, above * (np.logaddexp(0, z) - np.logaddexp(0, state[-2])), len(y))  # -log of the share of clean sentences
        none = np.maximum(none + np.exp(state[-1]), 1e-9)
        of_doc = (1 - y) - y / np.expm1(np.minimum(none, 500))
        g_z = above * of_doc[doc_of] / (1 + np.exp(-z)) / len(y)
        g_bias = g_z.sum() - (above * of_doc[doc_of]).sum() / (1 + np.exp(-state[-2])) / len(y)
        g_words = np.bincount(slot_of, g_z[sentence_of], len(number)) + DECAY / len(y) * state[:-2]
        g = np.append(g_words, [g_bias, np.exp(state[-1]) * of_doc.sum() / len(y)])
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.01 * (g * g - moments[1])
        state -= RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    return Model(float(state[-2]), {s: float(state[i]) for s, i in number.items()})


class Scorer:
    """A worker's copy of a model, with the weights of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def sentence(self, sentence: str) -> float:
        kept, z = self.kept, self.model.bias
        for w in set(WORD.findall(sentence)):
            v = kept.get(w)
            if v is None:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                kept[w] = v = self.model.word(w)
            z += v
        return z

    def document(self, text: str | None, least: float = 0.5) -> tuple[float, list[int], list[float]]:
        """Score, and the numbers and scores of the sentences that reach ``least``."""
        z = np.asarray([self.sentence(s) for s in sentences(text or "")])
        if not len(z):
            return 0.0, [], []
        none = np.maximum(np.logaddexp(0, z) - np.logaddexp(0, self.model.bias), 0)
        score, p = float(-np.expm1(-none.sum())), -np.expm1(-none)
        found = np.flatnonzero(p >= least)
        return score, found.tolist(), p[found].tolist()


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, n_sentences located, sentences: their numbers, sentence_scores)."""
    asked = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MOST weights, whatever the data

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                scores, found, of_found = zip(*[scorer.document(t.as_py()) for t in batch.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.int32())), pa.array(of_found, pa.list_(pa.float64()))],
                    names=["doc_id", "score", "sentences", "sentence_scores"],
                )

    return asked.mapInArrow(run, f"doc_id {kind}, score double, sentences array<int>, sentence_scores array<double>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", SAMPLE, TOTAL_CHARS))
    return score(documents, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )
