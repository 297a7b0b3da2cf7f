"""License scans by diagonal voting (DataFrame functions only).

All rolling hashes of K words of all documents are joined to the positions of the same hashes in
the templates. A hit votes for the diagonal document position - template position: the words of a
verbatim place all vote for one diagonal, inserted or missing words move to a neighbouring one.
Votes are summed by diagonal, diagonals at most SLACK apart are merged, and a merged place counts
when its template words are covered to the template's share within a span of matching length.

The templates are the fixed list below, so the joined side is bounded. One shuffle of hits (not of
words) follows the join. Defined cases: a null text is empty; texts shorter than K words have no
hits; repeated rows each get their own result row; an empty table gives an empty result. Words are
compared by 64-bit hashes of K words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import table

K, SLACK = 3, 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, words, share of the K-grams that must be covered, whether it is a base phrase)
TEMPLATES = (
    ("mit", "under the mit license", 1.0, True),
    ("apache-2", "apache license version 2", 1.0, True),
    ("cc-by-nc", "cc by nc", 1.0, True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.6, False),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.7, False),
    ("gpl", "gnu general public license", 1.0, False),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.7, False),
    ("gpl-2", "gnu general public license version 2", 1.0, False),
    ("gpl-3", "gnu general public license version 3", 1.0, False),
    ("lgpl", "gnu lesser general public license", 1.0, False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.6, False),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.7, False),
    ("cc-by-nc", "creative commons attribution noncommercial", 1.0, False),
    ("cc-by-sa", "cc by sa", 1.0, False),
    ("cc-by-sa", "creative commons attribution sharealike", 1.0, False),
)


def words_of(text: Column) -> Column:
    """Lower-cased words. Other letters than A-Z are lowered too, which neither joins nor parts words, nor concerns the templates."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def gram_hashes(words: str, k: int = K) -> Column:
    """The rolling hashes of k words of a column of words, in order."""
    n = F.size(words)
    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)]))
    return F.when(n >= k, F.slice(hashes, F.lit(1), n - k + 1)).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(h, tid, tpos): at most the number of words in the templates."""
    rows = [(i, text) for i, (_, text, _, _) in enumerate(templates)]
    split = spark.createDataFrame(rows, "tid int, text string").select("tid", words_of(F.col("text")).alias("w"))
    return split.select("tid", F.posexplode(gram_hashes("w")).alias("tpos", "th"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, places (array of label, base, first, last, share).

    A marker without a hash travels with each row's grams, so that documents without hits stay and
    repeated rows are counted, without a second pass over the texts. A text that shares no gram with
    the templates, as a set operation on the two arrays of hashes tells, has the marker alone.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words_of(F.col(text_col)).alias("w"))
    side = F.broadcast(template_grams(spark, templates))
    known = F.array(*[F.lit(r["th"]) for r in template_grams(spark, templates).select("th").distinct().collect()])
    rows = rows.withColumn("h", gram_hashes("w")).select("doc_id", "key", F.size("w").alias("n"), "h")
    mark = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("pos")))
    numbered = F.when(F.arrays_overlap("h", known), F.concat(mark, F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("pos"))))).otherwise(mark)
    every = rows.select("doc_id", "key", "n", F.explode(numbered).alias("g"))
    every = every.select("doc_id", "key", "n", F.col("g.h").alias("h"), F.col("g.pos").alias("pos"))
    hits = every.join(side, F.col("h") == F.col("th"), "left").where(F.col("tid").isNotNull() | (F.col("pos") < 0))
    diagonal = (
        hits.groupBy("doc_id", "key", "tid", (F.col("pos") - F.col("tpos")).alias("diag"))
        .agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("cover"))
    )
    own = Window.partitionBy("doc_id", "key", "tid").orderBy("diag")
    new = F.when(F.col("diag") - F.lag("diag").over(own) <= SLACK, 0).otherwise(1)
    info = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(base).alias("base"), F.lit(share).alias("least"), F.lit(len(t.split())).alias("len")) for lab, t, share, base in templates])
    # a base phrase counts on each exact diagonal; the other templates on merged ones
    is_base = F.array(*[F.lit(base) for _, _, _, base in templates])
    group = F.when(F.get(is_base, "tid"), F.row_number().over(own)).otherwise(F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = (
        diagonal.withColumn("step", new)
        .withColumn("place", group)
        .groupBy("doc_id", "key", "tid", "place")
        .agg(
            F.max("n").alias("n"), F.max("rows").alias("rows"), F.min("first").alias("first"), (F.max("last") + K).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("cover")))).alias("covered"),
        )
        .withColumn("t", F.get(info, "tid"))
        .withColumn("share", F.col("covered") / (F.col("t.len") - K + 1))
    )
    verified = (F.col("share") >= F.col("t.least")) & (F.col("end") - F.col("first") <= F.col("t.len") * 1.5 + SLACK)
    found = F.struct(F.col("t.label").alias("label"), F.col("t.base").alias("base"), "first", F.col("end").alias("end"), F.least(F.col("share"), F.lit(1.0)).alias("share"))
    per = merged.groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("tid").isNull(), F.col("rows"))).alias("copies"), F.max(F.when(F.col("tid").isNull(), F.col("n"))).alias("n_words"),
        F.collect_list(F.when(F.col("tid").isNotNull() & verified, found)).alias("places"),
    )
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "places")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    first = F.transform(base, lambda p: p["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates=TEMPLATES) -> str:
    """The same scan as SQL for DuckDB, with grams compared as texts."""
    rows = ", ".join(f"({i}, '{label}', '{text}', {share}::DOUBLE, {base}, {len(text.split())})" for i, (label, text, share, base) in enumerate(templates))
    return rf"""
WITH t(tid, label, txt, least_share, is_base, len) AS (VALUES {rows}),
tw AS (SELECT tid, string_split(txt, ' ') AS w FROM t),
ti AS (SELECT tid, w, unnest(range(1, len(w) - 1)) AS i FROM tw),
tg AS (SELECT tid, i - 1 AS tpos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM ti),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
di AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d),
hits AS (SELECT rid, tid, i - 1 AS pos, tpos FROM di JOIN tg ON g = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
diag AS (SELECT rid, tid, pos - tpos AS diag, min(pos) AS first, max(pos) AS last, list(DISTINCT tpos) AS cover FROM hits GROUP BY 1, 2, 3),
stepped AS (SELECT diag.*, t.is_base, t.label, t.least_share, t.len, row_number() OVER o AS n,
                   CASE WHEN diag - lag(diag) OVER o <= {SLACK} THEN 0 ELSE 1 END AS step FROM diag JOIN t USING (tid) WINDOW o AS (PARTITION BY rid, tid ORDER BY diag)),
placed AS (SELECT *, CASE WHEN is_base THEN n ELSE sum(step) OVER (PARTITION BY rid, tid ORDER BY diag ROWS UNBOUNDED PRECEDING) END AS place FROM stepped),
merged AS (SELECT rid, tid, place, any_value(is_base) AS is_base, any_value(label) AS label, any_value(least_share) AS least_share, any_value(len) AS len,
                  min(first) AS first, max(last) + {K} AS finish, len(list_distinct(flatten(list(cover)))) AS covered FROM placed GROUP BY 1, 2, 3),
found AS (SELECT *, covered / (len - {K} + 1)::DOUBLE AS share FROM merged WHERE covered / (len - {K} + 1)::DOUBLE >= least_share AND finish - first <= len * 1.5 + {SLACK}),
per AS (SELECT rid, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
               array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
               max(least(share, 1.0)) AS score FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score FROM d LEFT JOIN per USING (rid)
"""
