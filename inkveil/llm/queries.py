"""The numbered queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import centroids, chat, decontaminate, language, lm, mixing, neighbours, ngram_join, phrases, quality, repeats, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat.END + chat.START + "assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t) for c, t in more.dtypes]).unionAll(more)
    return chat.digests(rows)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, ("doc_id", "held_out"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"))
    model, counts = lm.fit(docs.filter(~F.col("held_out")))
    return lm.score(docs, model, counts, ("doc_id", "held_out"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["rank"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spans(base).cast("binary"), 256).alias("base_sha256"), secrets.spans(F.col("findings")).alias("spans"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(F.coalesce(_remainder("doc_id", 3) != 1, F.lit(True)))
    return quality.score(docs, quality.fit_by_id(docs, labels), ("doc_id", "held_out"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(F.coalesce(_remainder("doc_id", 3) != 1, F.lit(True)))
    return toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id", "held_out"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_nearest, op3_ngram_join, op4_chat_format, op5_language_id, op6_lm_score, op7_secret_scan, op8_source_mix, op9_decontaminate, op10_quality, op11_toxicity, op12_phrases, op13_centroids)}
ORACLES = {"op8_source_mix": mixing.ORACLE, "op12_phrases": phrases.ORACLE, "op13_centroids": centroids.ORACLE}
