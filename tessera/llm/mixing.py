"""Mixing sources to target weights, by hash-threshold histograms.

Every source gets a target.  What a source gives is a whole number of copies of all its
documents, and of some documents one more: those whose hash is below the source's
threshold.  Thresholds are found without sorting documents: sizes are summed by source
and leading hash bits, the bucket in which the running sum passes the budget is the
boundary, and only that bucket is summed again by the next bits, until its hash is
determined.  A last pass filters by comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize, pick

BITS, LEVELS = 12, 5
#: Up to so many sources the per-source table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def hash_key() -> Column:
    """The first 60 bits of the MD5 of doc_id, or of the text where there is none."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size -> with target, in words: shares by weight, full sources capped.

    With sources ordered by the level at which they are full, the common level is that of
    the first source that it doesn't fill.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    full = Window.orderBy("at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("most", F.col("source_size") * most).withColumn("at", F.col("most") / F.col("weight"))
    t = t.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("level", F.col("rest") / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything))
    return t.select("source", "source_size", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def _boundary(sums: DataFrame) -> DataFrame:
    """sums by source and bucket, with budget and sum before -> each source's boundary bucket."""
    w = Window.partitionBy("source").orderBy("bucket")
    run = sums.withColumn("upto", F.col("before") + F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
    inside = run.filter((F.col("before") < F.col("budget")) & (F.col("upto") >= F.col("budget")))
    return inside.groupBy("source").agg(F.min(F.struct("bucket", "before", "words", "budget")).alias("b")).select("source", "b.*")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key of each row."""
    own = pick(docs, doc_id="long", text="string", source="string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return own.select("doc_id", "source", size.alias("size"), hash_key().alias("key"))


def with_plan(left: DataFrame, right: DataFrame, few: bool, *more: Column) -> DataFrame:
    """left joined with a per-source table on source, null included."""
    right = right.withColumnRenamed("source", "_source")
    condition = left["source"].eqNullSafe(right["_source"])
    for c in more:
        condition &= c
    return left.join(F.broadcast(right) if few else right, condition).drop("_source")


def plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, bool]:
    """source, source_size, target, whole, below for each source; and whether they are few.

    A document is taken `whole` times, and once more if its key is below `below`.
    """

    def prefix(level: int) -> Column:
        return F.shiftright("key", BITS * (LEVELS - 1 - level))

    sums = materialize(rows.groupBy("source", prefix(0).alias("bucket")).agg(F.sum("size").alias("words")))
    goal = materialize(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    wanted = goal.filter("budget > 0").select("source", "budget")
    edge = materialize(_boundary(with_plan(sums, wanted, few).withColumn("before", F.lit(0).cast("long"))))
    for level in range(1, LEVELS):
        near = edge.select("source", F.col("bucket").alias("_bucket"), F.col("before").alias("_before"), "budget")
        part = with_plan(rows.withColumn("_prefix", prefix(level - 1)), near, few, F.expr("_prefix = _bucket"))
        part = part.groupBy("source", prefix(level).alias("bucket")).agg(F.sum("size").alias("words"), F.first("_before").alias("before"), F.first("budget").alias("budget"))
        edge = materialize(_boundary(part))
    nearest = (F.col("before") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("before"))
    last = edge.select(F.col("source").alias("_source"), F.when(nearest, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("below"))
    found = goal.select("source", "source_size", "target", "whole").join(last, F.expr("source <=> _source"), "left").drop("_source")
    return materialize(found.withColumn("below", F.coalesce("below", F.lit(0)))), few


def _copies() -> Column:
    return (F.col("whole") + (F.col("key") < F.col("below")).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of docs.

    Sources, by code point and null last, take the weights in turn; their targets are
    shares of all words, at most `most` times what they have, the excess shared again.
    A null text has size 0; a source without words has target 0.  Rows that share a doc_id
    (or, without one, a text) are taken alike, so reruns agree.  Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = materialize(sizes(docs))
    planned, few = plan(rows, weights, most)
    return with_plan(rows, planned, few).select("doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"), _copies().alias("copies"))


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, all columns kept."""
    planned, few = plan(materialize(sizes(docs)), weights, most)
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = own.withColumn("key", hash_key()).drop("doc_id", "text")
    taken = with_plan(keyed, planned, few).withColumn("copies", _copies()).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


#: The same in DuckDB: running sums by hash instead of histograms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
a AS (SELECT *, source_size * 3 AS most, source_size * 3 / CAST(weight AS DOUBLE) AS brim FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY brim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY brim, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own
  FROM a),
g AS (SELECT source, source_size, coalesce(least(CAST(most AS DOUBLE), max(CASE WHEN own <= brim THEN own END) OVER () * weight), 0) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
k AS (SELECT source, key, sum(size) AS words FROM d GROUP BY source, key),
r AS (SELECT source, key, words, sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
e AS (
  SELECT r.source, min(key) AS key, arg_min(upto, key) AS upto, arg_min(words, key) AS words, min(target - whole * source_size) AS budget
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
  WHERE target - whole * source_size > 0 AND upto - words < target - whole * source_size AND upto >= target - whole * source_size
  GROUP BY r.source),
t AS (SELECT source, CASE WHEN upto - budget < budget - (upto - words) THEN key + 1 ELSE key END AS below FROM e)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST((b.whole + CASE WHEN d.key < coalesce(t.below, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken,
       CAST(b.whole + CASE WHEN d.key < coalesce(t.below, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
