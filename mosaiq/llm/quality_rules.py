"""Quality rules as weak supervision (DataFrame functions only).

Each rule looks at one statistic of a document and votes good (+1), bad (-1) or abstains (0).
The votes of all documents are counted by pattern; there are at most 3 ** len(RULES) patterns,
whatever the number of documents. Expectation-maximisation over these counts estimates how often
each rule is right, and a document's posterior probability of being good replaces a filter that
all rules must pass.

Defined cases: a null text has no words; a text without words fails the base test; a document on
which all rules abstain gets the prior; repeated rows are judged alike; an empty table gives an
empty result. Statistics are exact but for windows of three words, which are compared by a 64-bit
hash within one document. The stage returns the columns it was given, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import own_names, plain_names, table
from mosaiq.plans.scratch import materialise

WHITE = r"[\x20\x09-\x0D]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_marked", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """Bad from ``bad`` on, good up to ``good``, no vote between; where ``falling``, the other way round."""

    name: str
    value: str
    good: float
    bad: float
    falling: bool = False

    def vote(self) -> Column:
        value = F.expr(self.value)
        good, bad = (value >= self.good, value <= self.bad) if self.falling else (value <= self.good, value >= self.bad)
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")


RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.02, 0.1),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", 0.1, 0.3),
    Rule("marked_words", "n_marked / nullif(n_words, 0)", 0.02, 0.1),
    Rule("same_lines", "n_dup_lines / nullif(n_lines, 0)", 0.1, 0.3),
    Rule("long_words", "word_chars / nullif(n_words, 0)", 9.0, 12.0),
    Rule("short_words", "word_chars / nullif(n_words, 0)", 3.0, 2.0, falling=True),
    Rule("capitals", "n_upper / nullif(word_chars, 0)", 0.1, 0.3),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", 0.05, 0.2),
    Rule("variety", "case when n_words >= 50 then n_distinct / sqrt(n_words) end", 5.0, 2.5, falling=True),
)


def words(text: Column) -> Column:
    """Runs of non-white characters, with an empty string for each white character beyond the first of a run.

    Nearly all texts hold no white space but blanks and line ends, for which splitting needs no regular expression.
    """
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, WHITE)).otherwise(plain)


def with_stats(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with the columns STATS, as one struct column ``st`` so that no name can clash.

    Windows of three words are hashed; only texts whose hashes are not all distinct go on to find
    the places of the repeated ones, by sorting (hash, place).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = documents.select("*", text.alias("__t")).withColumn("__p", words(F.col("__t")))
    step = step.withColumn("__w", F.array_remove("__p", ""))
    n = F.size("__w")
    lines = F.split("__t", "\n")
    blank_lines = F.col("__t").rlike(r"(^|\n)[\x20\x09\x0B-\x0D]+(\n|\z)")
    step = step.withColumn("__l", F.when(blank_lines, F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.array_remove(lines, "")))
    hashes = F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    step = step.withColumn("__h", F.when(n >= 3, F.slice(hashes, F.lit(1), n - 2)))
    step = step.withColumn("__twice", F.size(F.array_distinct("__h")) < F.size("__h"))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__g", F.when(F.col("__twice"), placed))
    twin = lambda x, k: (x["h"] == F.get("__g", k - 1)["h"]) | (x["h"] == F.get("__g", k + 1)["h"])
    step = step.withColumn("__s", F.when(F.col("__twice"), F.transform(F.filter("__g", twin), lambda x: x["i"])))
    step = step.withColumn("__r", F.regexp_extract_all("__t", F.lit(r"[#*$%&|<>!]+"), F.lit(0))).withColumn("__j", F.array_join("__r", ""))
    covered = F.size(F.array_distinct(F.concat("__s", F.transform("__s", lambda i: i + 1), F.transform("__s", lambda i: i + 2))))
    n_symbols = F.length(F.replace("__j", F.lit("!"), F.lit("")))
    stats = {
        "n_words": n, "word_chars": F.length("__t") - F.size("__p") + 1, "n_symbols": n_symbols,
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")), "n_repeat_words": F.when(F.col("__twice"), covered).otherwise(0), "n_lines": F.size("__l"),
        "n_upper": F.regexp_count("__t", F.lit(r"\p{Lu}")), "n_shouts": F.length("__j") - n_symbols, "n_marked": F.size("__r"), "n_distinct": F.size(F.array_distinct("__w")),
    }
    return step.withColumn("st", F.struct(*[v.cast("long").alias(k) for k, v in stats.items()])).drop("__t", "__p", "__w", "__l", "__h", "__twice", "__g", "__s", "__r", "__j")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class LabelModel:
    """Log odds of the prior, and for each rule of a bad vote, an abstention and a good vote."""

    prior: float
    weight: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        odds = F.lit(self.prior)
        for rule, w in zip(RULES, self.weight, strict=True):
            odds = odds + F.get(F.array(*[F.lit(x) for x in w]), rule.vote() + 1)
        return 1 / (1 + F.exp(-odds))


#: Where the estimation starts: the shares of bad votes, abstentions and good votes on good and on bad documents.
START_GOOD, START_BAD, START_PRIOR = (0.01, 0.19, 0.8), (0.3, 0.1, 0.6), 0.8


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over (votes, count): how each rule votes on good and on bad documents.

    A rule's shares are smoothed by one vote, the prior stays within 0.05 and 0.95, and a bad vote
    never speaks for a document nor a good vote against it. No votes at all give the start values.
    """
    prior = START_PRIOR
    good, bad = [START_GOOD] * len(RULES), [START_BAD] * len(RULES)
    weigh = lambda: [(min(0.0, math.log(g[0] / b[0])), math.log(g[1] / b[1]), max(0.0, math.log(g[2] / b[2]))) for g, b in zip(good, bad, strict=True)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weight, odds = weigh(), math.log(prior / (1 - prior))
        fine = [1 / (1 + math.exp(-max(-500.0, odds + sum(w[v + 1] for v, w in zip(votes, weight, strict=True))))) for votes, _ in patterns]
        prior = min(0.95, max(0.05, sum(p * n for p, (_, n) in zip(fine, patterns, strict=True)) / total))

        def shares(r: int, p: list[float], start: tuple[float, ...]) -> tuple[float, ...]:
            seen = list(start)
            for q, (votes, n) in zip(p, patterns, strict=True):
                seen[votes[r] + 1] += q * n
            return tuple(x / sum(seen) for x in seen)

        good = [shares(r, fine, START_GOOD) for r in range(len(RULES))]
        bad = [shares(r, [1 - p for p in fine], START_BAD) for r in range(len(RULES))]
    return LabelModel(math.log(prior / (1 - prior)), tuple(weigh()))


def vote_patterns(stats: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Counts of at most 3 ** len(RULES) patterns, in a fixed order."""
    counted = stats.select(*[r.vote().alias(r.name) for r in RULES]).groupBy(*[r.name for r in RULES]).count()
    return sorted((tuple(row)[:-1], row["count"]) for row in counted.collect())


def judged(stats: DataFrame, model: LabelModel, threshold: float = 0.01) -> DataFrame:
    posterior = model.posterior()
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("posterior", posterior)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialise(with_stats(documents).select("doc_id", "st.*"), "rules")
    return judged(stats, fit(vote_patterns(stats))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model keeps; short ones too, unless it calls them bad.

    The base test is a part of the operator's verdict, so a document that fails it goes.
    """
    plain, of = plain_names(docs)
    every = materialise(with_stats(plain, of["text"]), "rules-docs")
    model = fit(vote_patterns(every.select("st.*")))
    return own_names(judged(every.select(*of.values(), "st.*"), model).where("kept"), of)
