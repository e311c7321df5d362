"""The corpus pipeline: STAGES, in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontaminate, language, mixing, ngram_join, secrets
from inkveil.llm.texts import unused
from inkveil.sources.scratch import materialised

#: The language model must be so far on the way from an even guess to certainty; below that a document is of no language that it knows.
LEAST_SURE = 0.2
#: Near duplicates: five words, a similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter or of no learned language. Learned from the rows that have a lang."""
    model = language.fit(docs)
    found = language.predict(docs, model, tuple(docs.columns), prefix="_of_")
    even = 1 / max(1, len(model.languages))
    return found.filter((F.col("_of_lang_pred") != language.NONE) & (F.col("_of_score") >= even + LEAST_SURE * (1 - even))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of linked documents, of several texts with that doc_id the one with
    the least hash. Equal rows count as one; rows without words and rows without a doc_id stay."""
    group = ngram_join.join_components(docs, SHINGLE, NUM, DEN).filter("doc_id is not null")
    first = group.filter("component is not null and doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    first = first.unionAll(group.filter("component is null").select("doc_id", "text_hash"))
    first = first.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"))
    mark = unused("_hash", docs.columns)
    rows = docs.withColumn(mark, F.xxhash64("text"))
    kept = rows.join(first.hint("merge"), (rows["doc_id"] == first["_id"]) & (rows[mark] == first["_of"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).unionByName(rows.filter("doc_id is null")).drop(mark)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or nearly."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; all stay, those of which nothing is taken with 0 words."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]
#: A neural network's predictions can't be told in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written and read again, as each may read it several times."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
