"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor wrote, and all of it. Stages 1 to 4 return the columns of
``documents``, whatever these are called; the last returns the packed pieces with their token ids.

A stage's scratch tables are deleted when the next stage begins, as its result has been written then;
where a caller passes an unwritten result on, they stay. So they do where that can't be told: a result that is
cached or that went through an RDD or a checkpoint may still have to be computed, in part at least if executors
are lost. They go then with the next stage that gets a written table, or at the end.

Defined cases, in every stage: an empty table gives an empty result; repeated rows are rows of their
own. A null or empty text fails the rules, so only a direct call of a later stage meets one: there it
scores like any empty text, is a duplicate of other empty texts, has size 0 in the mix (taken where its
place falls below the threshold), and packs into its end id. Null ids and sources are allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from mosaiq.plans.scratch import drop, materialise, remove, tracked
from mosaiq.plans.ship import ship

#: Scratch tables that the last stage's result reads.
_left: list[str] = []


def _files(docs: DataFrame) -> list[str] | None:
    """The files that a plan reads, those of cached tables too; None if it reads anything else, such as an RDD, whose origin isn't known."""
    leaves, found = docs._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        found += leaf.relation().location().inputFiles()
    return found


def _work(stage: Callable, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    names = [path.rpartition("/")[2] for path in _left]
    if names and (files := _files(docs)) is not None and not any(name in file for file in files for name in names):
        drop(spark, _left)
        _left.clear()
    with tracked() as own:
        out = stage(spark, docs, sf_dir)
    _left.extend(own)
    return out


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules' label model rejects go."""
    return _work(quality_rules.stage, spark, docs, sf_dir)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score below 0.3 go."""
    return _work(quality_classifier.stage, spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group stays."""
    return _work(near_dedup.stage, spark, docs, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents of the mix, those taken twice standing twice."""
    return _work(mixing.stage, spark, docs, sf_dir)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of documents in sequences of 2048 tokens."""
    return _work(packing.stage, spark, docs, sf_dir)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Trees, signatures and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
