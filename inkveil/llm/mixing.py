"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Each source has a weight. Together the sources get ``share`` times all sizes; a source's target stops
at ``most`` times its own size and what it would get beyond that goes to the others by weight, until no
source is above its stop. With the sources ordered by stop / weight, the result has a closed form: the
first k are at their stop and the rest get one level times their weight.

A source with target t and size s is repeated floor(t / s) times as a whole. The fractional
repetition takes its documents in the order of a seeded hash until the rest of the target is used; the
document at the edge is taken in part, so that the source's words are its target, rounded. Prefix
sums go over 65,536 hash buckets per source first; only documents of the bucket that holds the edge are
then ordered by a window, so a source with a third of all rows is never sorted in one task.

Defined results: null text has size 0; a null source is a source of its own, last in order; an empty
table gives no rows; equal rows are all kept, and rows that tie in hash and size are interchangeable;
other columns of the input are ignored or, with ``keep``, passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, their figures are broadcast (under 100 bytes each); more are joined by a sort-merge join, whose hot keys AQE splits.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """sizes: (source, weight, size), one row per source. Adds target; sources without words get 0."""
    by_stop = Window.orderBy((F.col("size") * most / F.col("weight")).asc(), F.col("place")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    filled = (
        sizes.withColumn("stop", F.col("size") * F.lit(most))
        .withColumn("all_size", F.sum("size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("stops_before", F.sum("stop").over(by_stop) - F.col("stop"))
        .withColumn("weights_before", F.sum("weight").over(by_stop) - F.col("weight"))
        .withColumn("level", (F.col("all_size") * F.lit(share) - F.col("stops_before")) / (F.col("all_weight") - F.col("weights_before")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("stop"))
    )
    # the first source that stays under its stop sets the level for itself and all after it
    level = F.min_by("level", F.when(F.col("open"), F.col("stop") / F.col("weight"))).over(everything)
    return filled.withColumn("fill", level).withColumn("target", F.least(F.col("stop"), F.coalesce(F.col("fill") * F.col("weight"), F.col("stop")))).drop("all_size", "all_weight", "stops_before", "weights_before", "level", "open", "fill", "stop")


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and the columns in ``keep``."""
    rows = docs.select(
        F.col("doc_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_hash"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("_bucket", F.substring("_hash", 1, 4))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("size")).withColumn("place", F.row_number().over(in_order)).withColumn("weight", cycle)
    plan = targets(sizes, share, most).select("source", F.col("size").alias("source_size"), "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("part", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))
    # the bucket in which the fractional repetition ends
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = buckets.withColumn("before", F.sum("words").over(earlier) - F.col("words")).join(plan.hint("merge"), F.col("_source").eqNullSafe(F.col("source")))
    edge = edge.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"), F.first("part").alias("part"),
        F.max_by("_bucket", F.when(F.col("before") <= F.col("part"), F.col("_bucket"))).alias("edge"),
        F.max(F.when(F.col("before") <= F.col("part"), F.col("before"))).alias("before"),
    )
    edge = edge.hint("broadcast") if sizes.count() <= BROADCAST_SOURCES else edge.hint("merge")
    out = rows.join(edge, F.col("_source").eqNullSafe(F.col("source")))
    inside = out.filter(F.col("_bucket") == F.col("edge"))
    run = Window.partitionBy("_source").orderBy("_hash", "_size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("room", F.col("part") - F.col("before") - (F.sum("_size").over(run) - F.col("_size")))
    outside = out.filter(F.col("_bucket") != F.col("edge")).withColumn("room", F.when(F.col("_bucket") < F.col("edge"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("room")))
    return outside.unionByName(inside).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target",
        (F.col("whole") * F.col("_size") + extra).cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source")],
    )


#: The same by one window per source, for DuckDB.
ORACLE = """
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM sizes
), levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - (sum(stop) OVER w - stop)) / ((sum(weight) OVER ()) - (sum(weight) OVER w - weight)) AS level
  FROM weighed WINDOW w AS (ORDER BY stop / weight, place ROWS UNBOUNDED PRECEDING)
), filled AS (
  SELECT *, least(stop, coalesce((min_by(level, stop / weight) FILTER (WHERE level * weight <= stop) OVER ()) * weight, stop)) AS target FROM levels
), plan AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled
), running AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.whole,
         CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size - (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.size ROWS UNBOUNDED PRECEDING) - r.size) AS room
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM running
"""
