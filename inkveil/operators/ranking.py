"""Row numbers and running sums within groups of any size, without one task for a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.sources.scratch import materialised


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], number: str = "n", sums: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``number``, the place of each row in its group from 1, and for each name of ``sums`` the sum of that column over the group up to the row.

    Rows are dealt by ranges of (groups, order), so a group that holds all of them lies in all partitions, in order. Partitions are
    counted, which is a row for each partition and group; what comes before is added to what each partition counts for
    itself. ``order`` should tell the rows of a group apart, or rows that tie are numbered in any order. Null is a group of its own.
    """
    sums = sums or {}
    placed = materialised(rows.repartitionByRange(*[F.col(c) for c in (*groups, *order)]).withColumn("_part", F.spark_partition_id()))
    keys = [*groups, "_part"]
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_{k}" for k in sums))])
    same: Column = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(before[f"_k{i}"]) for i, c in enumerate(keys)])
    own = Window.partitionBy(*keys).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(before.hint("merge"), same)
    out = out.withColumn(number, (F.row_number().over(own) + F.col("_before_n")).cast("int" if number == "n" else "long"))
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_before_{k}"))
    return out.select(*rows.columns, number, *sums)
