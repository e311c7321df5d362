"""Bounded samples of labelled rows for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: So many times the wanted rows lie under the threshold, so that enough are left.
MARGIN = 1.3


def least_hashed(rows: DataFrame, label: str, most: int, *values: str) -> list[Row]:
    """For each value of ``label`` at most ``most`` rows (label, h, values), those with the least ``h`` (a hash as a long), rows of one label and hash once.

    The different hashes of each label are counted first, so copies of a text, however many, neither count nor crowd out others. Only rows whose hash
    lies under a threshold of that count go on; where no more than about ``most`` are different, all do. Tasks and driver hold
    a few more rows than asked for, whatever the size of the table.
    """
    # of each label a sketch of fixed size; it errs by 2 %
    counts = rows.groupBy(label).agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not counts:
        return []
    below = [(r[label], min(2**63 - 1, int(2**64 * MARGIN * (most + 20) / max(1, r["n"])) - 2**63)) for r in counts]
    # one short row for each label
    bounds = rows.sparkSession.createDataFrame(below, rows.select(label).schema.add("_below", "long")).withColumnRenamed(label, "_label").hint("broadcast")
    under = rows.filter(F.col("h") <= below[0][1]) if len(below) == 1 else rows.join(bounds, F.col(label) == F.col("_label")).filter(F.col("h") <= F.col("_below"))
    few = under.select(label, "h", *values).dropDuplicates([label, "h"])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h"))
    return few.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n").orderBy(label, "h").collect()


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int, sample_bytes: int) -> dict[int, list[bytes]]:
    """For labels 0 and 1 at most ``most`` different texts each, as UTF-8. docs: doc_id, text; labels: doc_id, label. Only ids and hashes
    are joined; of each chosen text a stretch of ``sample_bytes`` is sent, from a place that hangs on its hash."""
    hashes = docs.select("doc_id", F.xxhash64("text").alias("h")).filter("text is not null")
    marks = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    chosen = least_hashed(hashes.join(marks.hint("merge"), "doc_id"), "label", most)
    # at most 2 * most short rows; a text that has both labels is learned from as both
    wanted = docs.sparkSession.createDataFrame([(r["label"], r["h"]) for r in chosen], "label int, h long").hint("broadcast")
    text = F.encode("text", "UTF-8")
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length(text) - F.lit(sample_bytes), F.lit(0)) + 1).cast("int") + 1
    found = docs.filter("text is not null").withColumn("h", F.xxhash64("text")).join(wanted, "h").select("label", "h", F.substring(text, begin, F.lit(sample_bytes)).alias("part"))
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in found.dropDuplicates(["label", "h"]).orderBy("label", "h").collect():
        out[r["label"]].append(bytes(r["part"]))
    return out
