"""Mixing sources to target weights: repetition rates from aggregated sizes, then floor(rate) copies and a Bernoulli one.

Only DataFrame functions. Sizes are counted once and kept as a narrow table; source totals, targets and the offset of
each source's hash seed are tables of one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, table

#: Fixed values of the contract: weights by rank of the source, share of all sizes, most times a source's size.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Offsets tried for the hash seed of each source; the one whose mix comes nearest to its target is used.
OFFSETS = 64
#: Equal rows over this part of all rows draw in turn; see spread.
EQUAL, GOLDEN = 4096, 0.6180339887498949
#: Sources up to this number are broadcast (a row of a few dozen bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def draw(key: Column, text: Column) -> Column:
    """Uniform in [0, 1) from id and text: 52 bits of MD5, the same in any SQL engine."""
    seed = F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def spread(sized: DataFrame) -> DataFrame:
    """Equal rows that are over 1 / EQUAL of all (EQUAL groups at most, so they are broadcast) draw one after the other in steps of the
    golden ratio instead of all alike. As they are equal they are counted and written anew, in parts of bounded size."""
    columns = sized.columns
    marked = sized.withColumn("_eq", F.xxhash64(*columns))
    many = marked.groupBy("_eq").agg(F.count(F.lit(1)).alias("_c")).where((F.col("_c") > 1) & (F.col("_c") * EQUAL > sized.count())).select("_eq")
    many = table(many, "equal")
    if not many.limit(1).count():
        return sized
    each = marked.join(F.broadcast(many), "_eq").groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
    parts = each.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / 10_000)))).repartition("_p", "u")
    rows = parts.withColumn("_j", F.explode(F.sequence(F.col("_p") * 10_000, F.least(F.col("_c"), (F.col("_p") + 1) * 10_000) - 1)))
    rows = rows.withColumn("u", (F.col("u") + F.col("_j") * GOLDEN) % 1.0).select(*columns)
    return table(marked.join(F.broadcast(many), "_eq", "left_anti").select(*columns).unionByName(rows), "spread")


def targets(totals: DataFrame) -> DataFrame:
    """totals (source, total) -> also target: min(MOST * total, level * weight), where the level makes them sum to SHARE.

    Closed form of resharing the excess until none is above: sources in order of MOST * total / weight are capped while
    the level that the others would get is above. One row a source, so the windows hold no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("double"))
    order = Window.orderBy(F.col("total") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (SHARE * F.sum("total").over(every) - MOST * F.coalesce(F.sum("total").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the first source that its level does not fill sets the level of all that follow
    t = t.withColumn("level", F.first(F.when(F.col("level") * 1.0 <= MOST * F.col("total") / F.col("weight"), F.col("level")), ignorenulls=True).over(every))
    return t.select("source", "total", F.least(MOST * F.col("total"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per input row; taken words are copies * size.

    Null texts have size 0 and null sources are a source of their own, last in order. The draw depends on id and text,
    so reruns agree; a few equal rows get the same copies, many (see spread) the share of them that the fraction asks. A source without words has target 0 and rate 0.
    """
    sized = table(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), F.col(text).alias("_t"), *keep).withColumn("u", draw(F.col("doc_id"), F.col("_t"))).drop("_t"), "sizes")
    sized = spread(sized)
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("total")))
    goal = table(goal.withColumn("rate", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)), "targets")
    few = goal.count() <= BROADCAST_SOURCES
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    j = _join(sized, small(goal))
    frac = F.col("rate") - F.floor("rate")
    extra = lambda k: F.when((F.col("u") + k) % 1.0 < frac, 1).otherwise(0)
    sums = j.groupBy("source").agg(F.first("target").alias("goal"), F.sum(F.col("size") * F.floor("rate")).alias("sure"), *[F.sum(F.col("size") * extra(F.lit(i / OFFSETS))).alias(f"s{i}") for i in range(OFFSETS)])
    miss = F.array(*[F.struct(F.abs(F.col("sure") + F.col(f"s{i}") - F.col("goal")).alias("d"), F.lit(i / OFFSETS).alias("k")) for i in range(OFFSETS)])
    offset = table(sums.select("source", F.array_min(miss)["k"].alias("k")), "offsets")
    out = _join(j, small(offset))
    return out.withColumn("copies", (F.floor("rate") + extra(F.col("k"))).cast("long")).select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "copies", *keep)


def _join(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    right = per_source.withColumnRenamed("source", "_s")
    return rows.join(right, rows["source"].eqNullSafe(right["_s"])).drop("_s")


def op7(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB.
OP7_SQL = r"""
WITH sized0 AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u0,
         count(*) OVER () AS every, count(*) OVER (PARTITION BY doc_id, text, source) AS equal, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth
  FROM documents),
sized AS (SELECT *, CASE WHEN equal > 1 AND equal * 4096 > every THEN (u0 + nth * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE ELSE u0 END AS u FROM sized0),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(total) OVER () - 2.0::DOUBLE * coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY total / weight, source NULLS LAST)),
chosen AS (SELECT level FROM levels WHERE level <= 2.0::DOUBLE * total / weight ORDER BY total / weight, source NULLS LAST LIMIT 1),
goal AS (SELECT source, total, least(2.0::DOUBLE * total, coalesce((SELECT level FROM chosen), 0) * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate FROM goal),
j AS (SELECT s.*, r.total, r.target, r.rate, r.rate - floor(r.rate) AS frac FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
tried AS (
  SELECT source, k, abs(sum(size * floor(rate)) + sum(CASE WHEN (u + k) % 1.0 < frac THEN size ELSE 0 END) - any_value(target)) AS d
  FROM j, (SELECT i / 64.0::DOUBLE AS k FROM range(64) t(i)) GROUP BY source, k),
best AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY d, k) = 1)
SELECT j.doc_id, j.size, j.total AS source_size, j.target,
       CAST((floor(j.rate) + CASE WHEN (j.u + b.k) % 1.0 < j.frac THEN 1 ELSE 0 END) * j.size AS BIGINT) AS taken
FROM j JOIN best b ON j.source IS NOT DISTINCT FROM b.source
"""
