"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word bigram of a text is joined by hash (and by its two words, so a hash collision cannot
vote) to the positions it has in short license templates. A vote at text position p for template position
t falls on diagonal p - t. Votes are summed by diagonal, neighbouring diagonals (an inserted or missing word
moves the diagonal by one) are merged, and a merged span is verified: it counts when it covers enough of the template
within a bounded length, and of overlapping spans only those that cover most of their templates count. So a notice
of one licence does not get the label of another one that differs from it by a word or two.

Defined cases: a null text is empty; a text without words gives zero places, null positions, empty labels
and score 0; repeated rows and null doc_ids each give their own row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.llm.common import documents, whole_text

# The phrases of the contract and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Public license notices, lower-cased words only.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Word separators once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most this far apart are merged.
BAND = 2
#: A merged span counts from this share of the template's bigrams.
COVERAGE = 0.8
#: A merged span is at most this many times as long as its template.
STRETCH = 1.5


def _templates(spark: SparkSession, phrases, templates) -> DataFrame:
    """One row per template bigram: h, t, tp, tw1, tw2; the row of t = -1 matches each text's last position."""
    rows = []
    for t, (words, _) in enumerate([*phrases, *templates]):
        words = words.split()
        rows += [f"({t}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    listed = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(t, tp, tw1, tw2)")
    end = spark.sql("SELECT 0L AS h, -1 AS t, 0 AS tp, CAST(NULL AS STRING) AS tw1, CAST(NULL AS STRING) AS tw2")
    return listed.select(F.xxhash64("tw1", "tw2").alias("h"), "t", "tp", "tw1", "tw2").unionByName(end)


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, exact phrase places, labels by phrase and by template, best template coverage.

    The templates are a parameter of fixed, small size, so their bigrams are broadcast.
    """
    listed = [*phrases, *templates]
    n_base, bigrams = len(phrases), [len(w.split()) - 1 for w, _ in listed]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("t") + 1)
    lowered = F.translate(whole_text(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.array_remove(F.split(lowered, SEPARATORS), "").alias("w1"))
    pairs = words.select("row", "doc_id", F.posexplode_outer(F.arrays_zip("w1", F.slice("w1", 2, F.size("w1")).alias("w2"))).alias("pos", "w"))
    grams = pairs.select("row", "doc_id", "pos", "w.w1", "w.w2").withColumn("h", F.when(F.col("w2").isNull(), F.lit(0)).otherwise(F.xxhash64("w1", "w2")))
    votes = grams.join(F.broadcast(_templates(docs.sparkSession, phrases, templates)), "h").where(
        F.when(F.col("w2").isNull(), F.col("t") < 0).otherwise((F.col("w1") == F.col("tw1")) & (F.col("w2") == F.col("tw2")))
    )
    end = F.col("t") < 0
    diagonals = votes.groupBy("row", "doc_id", "t", F.when(end, 0).otherwise(F.col("pos") - F.col("tp")).alias("diag")).agg(
        F.collect_set("tp").alias("tps"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max(F.when(end, F.coalesce(F.col("pos") + 1, F.lit(0)))).alias("n")
    )
    by = Window.partitionBy("row", "t").orderBy("diag")
    islands = diagonals.withColumn("new", F.when((F.col("t") < n_base) | F.lag("diag").over(by).isNull() | (F.col("diag") - F.lag("diag").over(by) > BAND), 1).otherwise(0)).withColumn("island", F.sum("new").over(by))
    spans = islands.groupBy("row", "doc_id", "t", "island").agg(
        F.max("n").alias("n"), F.min("diag").alias("start"), F.max(F.size("tps")).alias("best"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tps")))).alias("merged"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    found = spans.where("t >= 0").select(
        "row", "doc_id", "t", "start", "lo", "hi",
        (F.when(F.col("hi") + 2 - F.col("lo") <= STRETCH * (of(bigrams) + 1), F.col("merged")).otherwise(F.col("best")) / of(bigrams)).alias("cover"), of([x for _, x in listed]).alias("label"),
    )
    base = (F.col("t") < n_base) & (F.col("cover") == 1)
    found = found.withColumn("fit", (F.col("t") >= n_base) & (F.col("cover") >= COVERAGE))
    along = Window.partitionBy("row", "fit").orderBy("lo", "hi", "t")
    apart = F.when(F.col("lo") > F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    found = found.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("most", F.max("cover").over(Window.partitionBy("row", "fit", "cluster")))
    kept = base | F.col("fit") & (F.col("cover") == F.col("most"))
    rows = found.select("row", "doc_id", F.lit(None).cast("int").alias("n"), base.alias("base"), "start", F.when(kept, F.col("label")).alias("label"), "cover").unionByName(
        spans.where("t < 0").select("row", "doc_id", "n", F.lit(False).alias("base"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("cover"))
    )
    at = F.when(F.col("base"), F.col("start").cast("long"))
    return rows.groupBy("row", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if("base").cast("long").alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    ).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _sql() -> str:
    values = []
    for t, (words, label) in enumerate([*PHRASES, *TEMPLATES]):
        words = words.split()
        values += [f"({t}, {i}, '{a}', '{b}', {len(words) - 1}, '{label}')" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    n = len(PHRASES)
    return f"""
WITH tm(t, tp, tw1, tw2, k, label) AS (VALUES {", ".join(values)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, w FROM d WHERE len(w) > 1),
v AS (SELECT doc_id, t, k, label, pos, tp, pos - tp AS diag FROM g JOIN tm ON w[pos + 1] = tw1 AND w[pos + 2] = tw2),
dg AS (SELECT doc_id, t, k, label, diag, list_distinct(list(tp)) AS tps, min(pos) AS lo, max(pos) AS hi FROM v GROUP BY ALL),
fl AS (SELECT *, CASE WHEN t < {n} OR lag(diag) OVER b IS NULL OR diag - lag(diag) OVER b > {BAND} THEN 1 ELSE 0 END AS new FROM dg WINDOW b AS (PARTITION BY doc_id, t ORDER BY diag)),
il AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diag) AS island FROM fl),
sp AS (SELECT doc_id, t, k, label, min(diag) AS start, max(len(tps)) AS best, len(list_distinct(flatten(list(tps)))) AS merged, min(lo) AS lo, max(hi) AS hi FROM il GROUP BY doc_id, t, k, label, island),
f0 AS (SELECT doc_id, t, label, start, lo, hi, CAST(CASE WHEN hi + 2 - lo <= {STRETCH} * (k + 1) THEN merged ELSE best END AS DOUBLE) / k AS cover FROM sp),
f1 AS (SELECT *, t >= {n} AND cover >= {COVERAGE} AS fit FROM f0),
f2 AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY doc_id, fit ORDER BY lo, hi, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS apart FROM f1),
f3 AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, fit ORDER BY lo, hi, t ROWS UNBOUNDED PRECEDING) AS clus FROM f2),
f AS (SELECT *, fit AND cover = max(cover) OVER (PARTITION BY doc_id, fit, clus) AS kept FROM f3),
s AS (SELECT doc_id, count(*) FILTER (t < {n} AND cover = 1) AS n_base, min(start) FILTER (t < {n} AND cover = 1) AS first_word, max(start) FILTER (t < {n} AND cover = 1) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (t < {n} AND cover = 1))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (t < {n} AND cover = 1 OR kept))), ',') AS labels, max(cover) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


ORACLE_SQL = _sql()
