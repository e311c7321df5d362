"""Continuous jobs: totals of the decision log, and masking of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from inkveil.functions.text import estimate_tokens
from inkveil.operators.audit import DECISIONS, READ, recommend
from inkveil.operators.masking import continue_sets, masked_text
from inkveil.sources.scratch import materialised, released


def read_decision_stream(spark: SparkSession, root: str, files: int = 1000) -> DataFrame:
    """The decision log as it grows, at most ``files`` new files in a batch."""
    rows = spark.readStream.schema(DECISIONS).option("timestampFormat", READ).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files).json(root)
    return rows.filter(F.col("_broken").isNull()).drop("_broken")


def _totals(grouped) -> DataFrame:
    masked = F.coalesce(F.col("decision") == "mask", F.lit(False))
    out = grouped.agg(F.count_if(masked).alias("mask_count"), F.count(F.lit(1)).alias("total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    ratio = F.col("mask_count") / F.col("total")
    return out.withColumn("mask_ratio", ratio).withColumn("recommendation", recommend(F.col("total"), ratio))


def decision_totals(rows: DataFrame) -> DataFrame:
    """Totals and recommendation per customer and term; for update or complete mode. State is a few numbers per term."""
    return _totals(rows.filter(F.coalesce("term", F.lit("")) != "").groupBy("customer_id", "term"))


def windowed_totals(rows: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """R1 by event time: tumbling or sliding windows; rows later than the watermark are dropped and old state goes."""
    windows = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _totals(rows.withWatermark("ts", late).filter(F.coalesce("term", F.lit("")) != "").groupBy(windows, "customer_id", "term"))


def mask_stream(docs: DataFrame) -> DataFrame:
    """R2: each document masked with tokens of its own; stateless, for append mode. Set-wide numbers: see ``mask_open_sets``."""
    out = masked_text(docs)
    return out.select(*[c for c in docs.columns if c != "text"], F.col("masked").alias("outbound_text"), F.size("seen").alias("n_replacements"), estimate_tokens(F.col("masked")).alias("estimated_input_tokens"))


def _written(spark: SparkSession, root: str, schema: str | StructType) -> DataFrame:
    """What the batches of a job have written so far, with the number of the batch."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*fields.fields, StructField("batch", LongType())])).parquet(root)


def _write(rows: DataFrame, root: str, batch: int) -> None:
    """A batch that runs again after a failure writes the same folder again."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")


LEDGER = "review_id {key}, placeholder string, original string, category string, n int, name string"


def mask_batch(docs: DataFrame, batch: int, root: str) -> None:
    """R2 for foreachBatch: sets that stay open. docs: review_id, doc_ord, name, text of any sets, whole or in part.

    Values that an earlier batch saw in the set keep their placeholders, new ones are numbered on. A batch reads only what earlier ones wrote and
    rewrites its own folders, so a batch that is repeated after a restart comes to the same result.
    """
    spark = docs.sparkSession
    with released():  # a stream runs on and on, its scratch tables must not
        masked = materialised(masked_text(docs))
        key = docs.schema["review_id"].dataType.simpleString()
        known = None
        if batch > 0:
            known = _written(spark, f"{root}/ledger", LEDGER.format(key=key)).filter(F.col("batch") < batch).drop("batch")
            known = materialised(known.join(masked.select("review_id").distinct().hint("merge"), "review_id", "left_semi"))
        documents, ledger = continue_sets(masked, known)
        _write(documents.select("review_id", "doc_ord", "name", F.col("masked").alias("outbound_text")), f"{root}/documents", batch)
        _write(ledger, f"{root}/ledger", batch)


def mask_open_sets(docs: DataFrame, root: str) -> DataStreamWriter:
    """R2 with set-wide numbers: masks a stream of documents into ``root``; results are read by ``masked_sets``."""
    return docs.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(lambda rows, i: mask_batch(rows, i, root))


def masked_sets(spark: SparkSession, root: str, key: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(documents, ledger) of all batches so far."""
    documents = _written(spark, f"{root}/documents", f"review_id {key}, doc_ord int, name string, outbound_text string").drop("batch")
    return documents, _written(spark, f"{root}/ledger", LEDGER.format(key=key)).drop("batch", "name")


def upsert_totals(totals: DataFrame, root: str) -> DataStreamWriter:
    """R1 in update mode: each batch writes the keys whose totals it changed; the newest row of a key counts (``current_totals``)."""
    return totals.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(lambda batch, i: _write(batch, f"{root}/changes", i))


def current_totals(spark: SparkSession, root: str, schema: str | StructType, keys: tuple[str, ...] = ("customer_id", "term")) -> DataFrame:
    """The newest row of each key; older ones are overtaken, by an aggregate with map-side sums."""
    rows = _written(spark, f"{root}/changes", schema)
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("_newest")).select(*keys, "_newest.*")


def compact_totals(spark: SparkSession, root: str, schema: str | StructType, keys: tuple[str, ...] = ("customer_id", "term")) -> None:
    """Writes the newest rows as one batch in place of those before it. Not to be called while the stream runs."""
    last = _written(spark, f"{root}/changes", schema).agg(F.max("batch")).first()[0]
    if last is not None:
        with released():
            materialised(current_totals(spark, root, schema, keys)).write.mode("overwrite").parquet(f"{root}/changes/batch={last}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{root}/changes")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(folder):
            if found.isDirectory() and found.getPath().getName() != f"batch={last}":
                files.delete(found.getPath(), True)
