"""The learned operators against plain recomputation, and recall of near-duplicates against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import near_dedup as ND
from mosaiq.llm import quality_classifier as QC
from mosaiq.llm import quality_rules as QR
from mosaiq.llm import toxicity as TX

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(2)
    sample = []
    for i in range(600):
        t = [" ".join(rng.choice(WORDS, 12)) for _ in range(6)]
        if i % 3 == 0:
            t[i % 6] += f" grumm{'abcdefgh'[i % 8]}{i % 7}"
        sample.append((". ".join(t) + ".", int(i % 3 == 0)))
    return TX.fit(sample)


def test_toxicity_scores_are_the_noisy_or(spark, toxic_model):
    rng = np.random.default_rng(7)
    clean = ". ".join(" ".join(rng.choice(WORDS, 9)) for _ in range(3000))
    texts = [None, "", " \n ", "...", "w1 grummz3 w2! w3. grumma1 grummb2?", clean, clean + "\nw4 grummc4", "ｗ１。grummd5？", "GRUMME6 W1", "w1. " * 40]

    def want(text):
        keep = 1.0
        for s in re.split(r"[.!?\n]+", (text or "").lower()):
            if s.strip():
                words = {w for w in re.findall(r"[^\W_]+", s)}
                z = toxic_model.bias + sum(toxic_model.weights.get(g, 0.0) for w in words for g in TX.grams(w))
                keep *= min(1.0, (1 + math.exp(toxic_model.bias)) / (1 + math.exp(z)))
        return 1 - keep

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, texts[4])], "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    got = TX.score(docs, toxic_model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.score == pytest.approx(want(texts[r.doc_id]), abs=1e-9) and 0 <= r.score <= 1
    of = {r.doc_id: r for r in got}
    assert of[4].sentences == [0, 2] and of[5].score < 0.5 < of[6].score and of[0].score == of[1].score == 0


def test_forest_equals_a_walk_through_its_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(QC.FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    forest = QC.fit(x, y)

    def walk(row):
        total = forest.base
        for feature, above, value in zip(forest.feature, forest.above, forest.value, strict=True):
            node = 0
            for _ in range(QC.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > above[node] else 1)
            total += value[node - (2**QC.DEPTH - 1)]
        return 1 / (1 + math.exp(-total))

    assert forest.predict(x) == pytest.approx([walk(r) for r in x])
    assert ((forest.predict(x) > 0.5) == (y > 0.5)).mean() > 0.98


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, size=(200, len(QC.FEATURES))).astype(float)
    y = ((x[:, 7] > 4) & (rng.random(200) < 0.9)).astype(float)
    forest = QC.fit(x, y)
    share = y.mean()
    grad, hess = y - share, share * (1 - share)
    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if QC.LEAST_ROWS <= left.sum() <= 200 - QC.LEAST_ROWS:
                part = lambda m: grad[m].sum() ** 2 / (hess * m.sum() + QC.PENALTY)
                gain = part(left) + part(~left) - grad.sum() ** 2 / (hess * 200 + QC.PENALTY)
                if gain > best[0] + 1e-9:
                    best = (gain, f, left)
    right = x[:, forest.feature[0][0]] > forest.above[0][0]
    assert forest.feature[0][0] == best[1] and (right == ~best[2]).all()


def test_rules_model_equals_expectation_maximisation_over_documents():
    rng = np.random.default_rng(5)
    bad = rng.random(800) < 0.3
    votes = np.where(rng.random((800, len(QR.RULES))) < 0.2, 0, np.where(rng.random((800, len(QR.RULES))) < np.where(bad, 0.6, 0.03)[:, None], -1, 1))
    got = QR.fit(sorted(Counter(map(tuple, votes.tolist())).items()), rounds=20)
    good, ill, prior = np.tile(QR.START_GOOD, (len(QR.RULES), 1)), np.tile(QR.START_BAD, (len(QR.RULES), 1)), QR.START_PRIOR

    def odds():
        w = np.log(good / ill)
        return np.stack([np.minimum(w[:, 0], 0), w[:, 1], np.maximum(w[:, 2], 0)], axis=1)

    for _ in range(20):
        z = math.log(prior / (1 - prior)) + odds()[np.arange(len(QR.RULES))[None, :], votes + 1].sum(1)
        p = 1 / (1 + np.exp(-z))
        prior = min(0.95, max(0.05, p.mean()))
        count = lambda q: np.stack([[q[votes[:, r] == v].sum() for v in (-1, 0, 1)] for r in range(len(QR.RULES))])  # noqa: B023, E731
        good, ill = (np.asarray(s) + count(q) for s, q in ((QR.START_GOOD, p), (QR.START_BAD, 1 - p)))
        good, ill = good / good.sum(1, keepdims=True), ill / ill.sum(1, keepdims=True)
    assert got.prior == pytest.approx(math.log(prior / (1 - prior))) and np.asarray(got.weight) == pytest.approx(odds())
    z = got.prior + np.asarray(got.weight)[np.arange(len(QR.RULES))[None, :], votes + 1].sum(1)
    assert ((z < 0) == bad).mean() > 0.9


def test_posterior_column(spark):
    model = QR.LabelModel(0.7, tuple((-1.0 - i, 0.1 * i, 0.5) for i in range(len(QR.RULES))))
    texts = ["a b c d", "### *** $$$ a", None, "x " * 60 + "y", "WORD " * 55]
    rows = QR.with_stats(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "st.*")
    got = QR.judged(rows.select("*", *[r.vote().alias(r.name) for r in QR.RULES]), model).collect()
    for r in got:
        z = model.prior + sum(w[r[rule.name] + 1] for rule, w in zip(QR.RULES, model.weight, strict=True))
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-z))) and r.kept == (not r.base_failed and r.posterior >= 0.01)


def test_near_duplicates_find_all_links_of_a_query_set(spark):
    """Ids divisible by 50 against all rows of a test table: every pair of similarity 0.8 or more is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    of = {r.doc_id: grams(r.text) for r in docs.collect()}
    size = {i: c.total() for i, c in of.items()}
    where = {}
    for i, c in of.items():
        for g in c:
            where.setdefault(g, []).append(i)
    # the queries, and the first members of groups of shared shingles, so that there are pairs to be found
    queries = {i for i in of if i % 50 == 0} | {min(v) for v in where.values() if 1 < len(v) < 6}
    links = set()
    for q in queries:
        common = Counter()
        for g, n in of[q].items():
            for i in where[g]:
                common[i] += min(n, of[i][g])
        links |= {(q, i) for i, n in common.items() if i != q and n >= 0.8 * (size[q] + size[i] - n)}
    classes = {r["id"]: r["class"] for r in ND.classified(docs).collect()}
    missed = [p for p in links if classes[p[0]] != classes[p[1]]]
    assert len(links) > 50 and not missed
