"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Each document has a pseudo-random position in 60 bits, the leading hex digits of an md5 of its
id and text. A source's words are summed by the leading bits of that position; the running sum over these
few histogram rows finds the bucket in which the source's budget ends. Only that boundary bucket
is summed again by the next bits, and so on, which gives one threshold per source. Selecting is
then the filter ``position < threshold``: nothing is sorted, and a larger budget always holds
what a smaller one held.

Defined cases: a null text has size 0, a null source is a source of its own (last in order), an
empty table gives an empty result, rows equal in id and text are rows of their own with equal
decisions, and a null id counts as empty. Documents that share all 36 refined bits are taken
or left together, whichever comes nearer to the target. The stage returns the columns it was
given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import own_names, plain_names, table
from mosaiq.plans.scratch import materialise

#: Bits of each refinement and of the whole position.
STEP_BITS, STEPS, ALL_BITS = 12, 3, 60
#: Weights of the sources in order, repeating; words asked for, and the most of a source, as shares of its size.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Thresholds are broadcast for at most this many sources, and joined by shuffle beyond.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(key: Column, text: Column, seed: str = "mix") -> Column:
    """60 pseudo-random bits of a key and a text, the same in every run; both, as a key may be null or stand more than once."""
    none = F.lit("")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), none), F.lit(":"), F.coalesce(text, none)).cast("binary"))
    return F.conv(F.substring(digest, 1, ALL_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the sources' order with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, target) from rows (skey, size): budgets by weight, none above ``most`` times its source.

    The windows without a partition run over one row per source.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    filled = (
        ranked.withColumn("n", F.row_number().over(by_fill))
        .withColumn("before", before)
        .withColumn("left_w", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("level", (F.col("all_size") * share - F.col("before")) / F.col("left_w"))
        .withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
        .withColumn("open_level", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("n"))).over(every))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("open_level") * F.col("w"), F.col("cap")))
    return filled.select("skey", "source_size", F.round(target, 6).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(skey, source_size, target, times, cut): take each document ``times`` times, once more if position < cut.

    ``sizes`` has skey, size, position; ``goals`` skey, source_size, target. Each step reads the
    histogram of the boundary buckets alone.
    """
    empty = F.col("source_size") <= 0
    times = F.when(empty, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    state = goals.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.withColumn("at", F.lit(0).cast("long"))
    for step in range(STEPS):
        shift, above = ALL_BITS - STEP_BITS * (step + 1), ALL_BITS - STEP_BITS * step
        inside = sizes
        if step:
            edges = state.select("skey", F.shiftright("at", above).alias("edge"))
            inside = sizes.join(edges, "skey").where(F.shiftright("position", above) == F.col("edge"))
        histogram = (
            inside.where(F.col("size") > 0)
            .groupBy("skey", F.shiftright("position", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        run = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossing = (
            histogram.withColumn("upto", F.sum("words").over(run))
            .join(state.select("skey", "need"), "skey")
            .where(F.col("upto") > F.col("need"))
            .groupBy("skey")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
            .select("skey", F.shiftleft("edge.bucket", shift).alias("found"), (F.col("edge.upto") - F.col("edge.words")).alias("below"), F.col("edge.words").alias("last"))
        )
        state = (
            state.join(crossing, "skey", "left")
            .withColumn("at", F.coalesce("found", "at"))
            .withColumn("need", F.col("need") - F.coalesce("below", F.lit(0)))
            .withColumn("edge_words", F.coalesce("last", F.lit(0)))
            .drop("found", "below", "last")
        )
        state = materialise(state, f"mix-step{step}")
    whole_edge = F.when(F.col("need") * 2 > F.col("edge_words"), F.lit(1 << (ALL_BITS - STEP_BITS * STEPS))).otherwise(0)
    nothing_more = F.col("target") <= F.col("times") * F.col("source_size")  # not even texts without words
    return state.select("skey", "source_size", "target", "times", F.when(nothing_more, 0).otherwise(F.col("at") + whole_edge).cast("long").alias("cut"))


def apply_mix(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with skey, position) with source_size, target and ``taken_times``, decided row by row."""
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    more = F.when(F.col("position") < F.col("cut"), 1).otherwise(0)
    return rows.join(side, "skey").withColumn("taken_times", F.col("times") + more).drop("times", "cut")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> tuple[DataFrame, DataFrame]:
    """(one row per document: id, skey, size, position; the sources' thresholds)."""
    rows = documents.select(
        F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("skey"),
        n_words(F.col(text_col)).alias("size"), position(F.col(id_col), F.col(text_col)).alias("position"),
    )
    rows = materialise(rows, "mix-sizes")
    goals = materialise(targets(rows, **kw), "mix-goals")
    return rows, thresholds(rows, goals)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = mix(table(spark, sf_dir, "documents"))
    return apply_mix(rows, cuts).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_times")).cast("long").alias("taken"),
        F.col("taken_times").cast("int").alias("times"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that the mix takes twice stands there twice."""
    plain, of = plain_names(docs)
    _, cuts = mix(docs)
    named = plain.withColumn("skey", source_key(F.col(of["source"]))).withColumn("position", position(F.col(of["doc_id"]), F.col(of["text"])))
    taken = apply_mix(named, cuts).where(F.col("taken_times") > 0)
    return own_names(taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("taken_times").cast("int")))), of)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS pos
  FROM documents),
per AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rnk FROM per),
weighed AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked),
filled AS (SELECT *, row_number() OVER f AS n,
                  coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
                  sum(source_size) OVER () AS all_size
           FROM weighed WINDOW f AS (ORDER BY cap / w, rnk)),
leveled AS (SELECT *, (all_size * 1.5::DOUBLE - before) / left_w AS lev FROM filled),
flagged AS (SELECT *, lev * w >= cap AS is_full FROM leveled),
goal AS (SELECT skey, source_size,
                round(CASE WHEN is_full THEN cap
                      ELSE least((SELECT arg_min(lev, n) FROM flagged WHERE NOT is_full) * w, cap) END, 6) AS target
         FROM flagged),
asked AS (SELECT *, CASE WHEN source_size <= 0 THEN 0 ELSE CAST(floor(target / source_size) AS INTEGER) END AS base FROM goal),
fine AS (SELECT skey, pos >> 24 AS bucket, sum(size) AS words FROM d WHERE size > 0 GROUP BY 1, 2),
running AS (SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM fine),
edge AS (SELECT r.skey, min(r.bucket) AS bucket, arg_min(r.upto, r.bucket) AS upto, arg_min(r.words, r.bucket) AS words,
                any_value(a.target - a.base * a.source_size) AS need
         FROM running r JOIN asked a USING (skey) WHERE r.upto > a.target - a.base * a.source_size AND a.target > a.base * a.source_size GROUP BY r.skey),
cut AS (SELECT a.*, coalesce((e.bucket << 24) + CASE WHEN (need - (upto - words)) * 2 > words THEN 1 << 24 ELSE 0 END, 0) AS cut
        FROM asked a LEFT JOIN edge e USING (skey))
SELECT d.doc_id, d.size, c.source_size, c.target,
       CAST(d.size * (c.base + CASE WHEN d.pos < c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(c.base + CASE WHEN d.pos < c.cut THEN 1 ELSE 0 END AS INTEGER) AS times
FROM d JOIN cut c USING (skey)
"""
