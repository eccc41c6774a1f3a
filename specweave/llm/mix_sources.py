"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its weight's share of all words, capped at ``max_copies`` times its size with the excess
reshared by weight. Within a source the target is spread over priority classes the same way, which gives each
document an expected number of copies r. floor(r) copies are certain; for the rest, pi = r - floor(r) is the
inclusion probability and documents are ranked by q = odds(u) / odds(pi), u being a hash of the document.
The classes are graded by size, each doubling of a document's size raising its priority, so a source has about
twenty inclusion odds. Documents are taken in order of q until the source's remaining words are used up (the last
one if its middle lies inside), so the sample has a fixed size in words.

No document moves: per source only a threshold on (q, hash) is found, from sums over buckets of q and an
ordering inside the one bucket where the words run out; the documents are then kept by a filter. A hot
source is spread over all its buckets. The targets of the sources are set in one task, which sees a row for each
source; so sources are kinds of text, some millions at most, not hosts.

Defined cases: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, last
in order; repeated rows share one rank, and where the words run out among them as many are taken as fit; an empty
table gives an empty result; columns of the input are kept, whatever their names, those named as an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.llm.common import WORD, documents, small, stage, whole_text

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document counts more often than this.
MAX_COPIES = 3
#: Documents in a bucket of q, on average.
BUCKET = 4096
#: Sources whose plan is broadcast at most; with more the join shuffles, and Spark splits hot sources.
MAX_BROADCAST = 20_000
#: Priority of a document: so much more than the binary digits of its size.
PRIORITY = 6


def _fill(cells: DataFrame, keys: list[str], total: str, weight: str, cap: str, out: str) -> DataFrame:
    """Share ``total`` of each group over its cells by weight, none above its cap (closed form of the resharing)."""
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by = order.orderBy((F.col(cap) / F.col(weight)).asc(), F.col("rank").asc())
    level = (F.col(total) - (F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col(cap))) / F.sum(weight).over(by.rowsBetween(0, Window.unboundedFollowing))
    at = cells.withColumn("level", level).withColumn("full", F.col(cap) / F.col(weight) <= F.col("level"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(order)
    return at.withColumn(out, F.when(F.col("full"), F.col(cap).cast("double")).otherwise(rest * F.col(weight))).drop("level", "full")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, size: Column | None = None, seed: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken (words, repeats counted).

    size: words of a document; seed: a hex digest to rank it by. Both are taken from ``text`` if not given.
    """
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long") if size is None else size
    seed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), whole_text())) if seed is None else seed
    names = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in names]
    # Inside, columns have names of their own, so none clashes.
    inner = {c: f"_own{i}" for i, c in enumerate(kept)}
    base = docs.select(F.col("source"), size.alias("size"), seed.alias("_seed"), *(F.col(f"`{c}`").alias(n) for c, n in inner.items())).withColumn("_class", F.length(F.bin("size")) + PRIORITY)
    cells = stage(base.groupBy("source", "_class").agg(F.sum("size").alias("cell"), F.count(F.lit(1)).alias("n")), "mix-cells")
    # The sources, not their documents, meet in this window.
    sources = cells.groupBy("source").agg(F.sum("cell").alias("source_size")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * max_copies)
    sources = _fill(sources.withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(0)))), [], "all", "w", "cap", "target").select("source", "source_size", "target")
    cells = cells.join(small(sources, MAX_BROADCAST).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where("cell > 0")
    cells = cells.withColumn("rank", F.col("_class")).withColumn("g", F.col("cell") * F.col("_class")).withColumn("cap", F.col("cell") * max_copies)
    cells = _fill(cells, ["source"], "target", "g", "cap", "share").withColumn("r", F.least(F.col("share") / F.col("cell"), F.lit(float(max_copies))))
    cells = cells.withColumn("whole", F.floor("r")).withColumn("pi", F.col("r") - F.floor("r"))
    per = Window.partitionBy("source")
    plan = stage(
        cells.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("cell")).over(per)).withColumn("nb", F.ceil(F.sum("n").over(per) / BUCKET)).select("source", "_class", "source_size", "target", "whole", "pi", "rest", "nb"),
        "mix-plan",
    )
    sized = small(plan, MAX_BROADCAST)

    def ranked(rows: DataFrame) -> DataFrame:
        """Rows with the plan of their source and class, q and its bucket; sources without words have no plan."""
        p = sized.withColumnsRenamed({"source": "_s", "_class": "_c"})
        rows = rows.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")), "left").drop("_s", "_c")
        u = (F.conv(F.substring("_seed", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        rows = rows.withColumn("q", F.when((F.col("size") > 0) & (F.col("pi") > 0), u / (1 - u) / (F.col("pi") / (1 - F.col("pi")))))
        return rows.withColumn("b", F.floor(F.col("q") / (1 + F.col("q")) * F.col("nb")))

    slim = ranked(base.select("source", "_class", "size", "_seed")).where("q IS NOT NULL")
    sums = slim.groupBy("source", "b").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    along = per.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("before", F.sum("words").over(along) - F.col("words")).where("before <= rest").groupBy("source").agg(F.max_by(F.struct("b", "before"), "b").alias("e"))
    edge = stage(edge.select("source", F.col("e.b").alias("edge"), F.col("e.before").alias("before")), "mix-edge")
    e = small(edge, MAX_BROADCAST).withColumnRenamed("source", "_s")
    inside = slim.join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b") == F.col("edge"))).drop("_s")
    # Repeated rows are one row here with their number, so a group of copies of any size is one.
    inside = inside.groupBy("source", "q", "_seed", "size").agg(F.count(F.lit(1)).alias("n"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("q", "_seed").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("from", F.col("before") + F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size"))
    inside = inside.withColumn("fit", F.least(F.col("n"), F.floor((F.col("rest") - F.col("from")) / F.col("size") + 0.5))).where("fit > 0")
    last = inside.groupBy("source").agg(F.max(F.struct("q", "_seed", "fit", "n")).alias("last"))
    cut = stage(edge.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "edge", F.struct("last.q", "last._seed").alias("last"), "last.fit", "last.n"), "mix-cut")
    c = small(cut.drop("n"), MAX_BROADCAST).withColumnRenamed("source", "_s")
    done = ranked(base).join(c, F.col("source").eqNullSafe(F.col("_s")), "left")
    at_edge, here = F.col("b") == F.col("edge"), F.struct("q", "_seed")
    more = F.coalesce((F.col("b") < F.col("edge")) | at_edge & (here <= F.col("last")), F.lit(False))
    if not cut.where("fit < n").isEmpty():
        # Of the repeated rows where the words run out as many are taken as fit, numbered by task and within it.
        tied = F.coalesce(at_edge & (here == F.col("last")), F.lit(False))
        some = stage(done.where(tied).withColumn("_task", F.spark_partition_id()), "mix-tied")
        counts = some.groupBy("source", "_task").agg(F.count(F.lit(1)).alias("_k"))
        counts = counts.withColumn("_before", F.sum("_k").over(Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).withColumnsRenamed({"source": "_s2", "_task": "_t2"})
        some = some.join(counts, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_task") == F.col("_t2"))).withColumn("_more", F.row_number().over(Window.partitionBy("source", "_task").orderBy("_seed")) + F.col("_before") <= F.col("fit"))
        done = done.where(~tied).withColumn("_more", more).unionByName(some.drop("_k", "_before", "_s2", "_t2", "_task"))
    else:
        done = done.withColumn("_more", more)
    done = done.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)).cast("long") + F.col("_more").cast("long"))
    zero = lambda name, kind: F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)
    return done.select(*(F.col(n).alias(x) for x, n in inner.items()), "size", zero("source_size", "long"), zero("target", "double"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    seed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), whole_text()))
    slim = stage(docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), seed.alias("seed")), "mix-slim")
    return mix_sources(slim, size=F.col("size"), seed=F.col("seed")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS seed FROM documents),
b AS (SELECT *, length(bin(size)) + {PRIORITY} AS class FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM b GROUP BY source),
s1 AS (SELECT *, (rk - 1) % 3 + 1 AS w, source_size * {MAX_COPIES} AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, CAST(total - (sum(cap) OVER o - cap) AS DOUBLE) / CAST(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s1 WINDOW o AS (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN NOT (cap / w <= level) THEN level END) OVER () * w END AS target FROM s2),
c0 AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS cell FROM b GROUP BY source, class),
c1 AS (SELECT c0.*, source_size, target, cell * class AS g, cell * {MAX_COPIES} AS cap FROM c0 JOIN s3 ON c0.source IS NOT DISTINCT FROM s3.source WHERE cell > 0),
c2 AS (SELECT *, (target - CAST(sum(cap) OVER o - cap AS DOUBLE)) / CAST(sum(g) OVER (PARTITION BY source ORDER BY cap / g, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c1 WINDOW o AS (PARTITION BY source ORDER BY cap / g, class ROWS UNBOUNDED PRECEDING)),
c3 AS (SELECT *, least(CASE WHEN cap / g <= level THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN NOT (cap / g <= level) THEN level END) OVER (PARTITION BY source) * g END / cell, {MAX_COPIES}.0) AS r FROM c2),
c4 AS (SELECT *, floor(r) AS whole, r - floor(r) AS pi FROM c3),
c5 AS (SELECT *, target - sum(whole * cell) OVER (PARTITION BY source) AS rest FROM c4),
r0 AS (SELECT b.*, c5.* EXCLUDE (source, class), (CAST(('0x' || seed[1:12]) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE AS u FROM b LEFT JOIN c5 ON b.source IS NOT DISTINCT FROM c5.source AND b.class = c5.class),
r1 AS (SELECT *, CASE WHEN size > 0 AND pi > 0 THEN u / (1 - u) / (pi / (1 - pi)) END AS q FROM r0),
r2 AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, seed ROWS UNBOUNDED PRECEDING) END AS upto FROM r1)
SELECT doc_id, size, coalesce(source_size, 0)::BIGINT AS source_size, coalesce(target, 0)::DOUBLE AS target,
  CAST((coalesce(whole, 0) + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, CAST(coalesce(whole, 0) + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r2"""
