"""The decision log: reading, appending, totals per term, recommendations and dictionary learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONSISTENT, OFTEN, EXAMPLES = 0.90, 5, 3
CUSTOMER_ID = r"^[A-Za-z0-9_\-]+$"
DECISIONS = T.StructType([T.StructField(n, T.TimestampType() if n == "ts" else T.StringType()) for n in ("schema_version", "ts", "user_id", "session_id", "doc", "term", "label", "source", "decision", "context", "customer_id", "date", "_broken")])
#: Times in the log, to the microsecond; logs with milliseconds or none are read too.
WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
READ = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"
#: Labels of decisions to the labels that seeds are known by.
SEED_LABELS = {"COMPANY": "ORG", "SITE": "GPE", "PERSON": "PERSON"}


def valid_customer_id(column: Column) -> Column:
    """F12."""
    return F.coalesce(column.rlike(CUSTOMER_ID), F.lit(False))


def read_audit(spark: SparkSession, root: str, customer: str | None = None) -> DataFrame:
    """All decisions, or one customer's (only its folder is opened). Broken and blank lines are skipped."""
    rows = spark.read.schema(DECISIONS).option("mode", "PERMISSIVE").option("timestampFormat", READ).option("columnNameOfCorruptRecord", "_broken").json(root)
    rows = rows.filter(F.col("_broken").isNull()).drop("_broken")
    return rows if customer is None else rows.filter(F.col("customer_id") == customer)


def append_decisions(decisions: DataFrame, root: str) -> DataFrame:
    """Appends under customer_id and day; rows of an invalid customer_id are returned, not written."""
    rows = decisions.withColumn("context", F.substring("context", 1, 120)).withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("schema_version", F.lit("1"))
    good = valid_customer_id(F.col("customer_id"))
    rows.filter(good).write.mode("append").partitionBy("customer_id", "date").options(**WRITTEN).json(root)
    return decisions.filter(~good)


def aggregate_decisions(rows: DataFrame, customer: str | None = None, session: str | None = None, order: str = "ts") -> DataFrame:
    """A1: per term the first label, counts, share of masks, first and last time, customers and up to three examples.

    Map-side partial sums throughout; only the examples are lists, and only of a term's first rows by ``order``.
    """
    if customer is not None:
        rows = rows.filter(F.col("customer_id") == customer)
    if session is not None:
        rows = rows.filter(F.col("session_id") == session)
    rows = rows.filter(F.coalesce(F.col("term"), F.lit("")) != "")
    masked = F.coalesce(F.col("decision") == "mask", F.lit(False))
    totals = rows.groupBy("term").agg(
        F.min_by("label", order).alias("label"), F.count_if(masked).alias("mask_count"), F.count_if(~masked).alias("skip_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.sort_array(F.collect_set("customer_id")).alias("customer_ids"),
    )
    example = rows.groupBy("term", "doc", "context", F.when(masked, "mask").otherwise("skip").alias("decision")).agg(F.min(order).alias("o"))
    first = example.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("o", "doc", "context", "decision"))).filter(F.col("k") <= EXAMPLES)
    examples = first.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc", "context", "decision"))), lambda x: F.struct(x["doc"].alias("doc"), x["context"].alias("context"), x["decision"].alias("decision"))).alias("examples"))
    totals = totals.withColumn("total", F.col("mask_count") + F.col("skip_count")).withColumn("mask_ratio", F.col("mask_count") / F.col("total"))
    return totals.join(examples.hint("merge"), "term", "left")


def recommend(total: Column, ratio: Column) -> Column:
    """A2. The lower bound is 1 - 0.9 in doubles, a little under 0.1: exactly one in ten depends on context."""
    return F.when(total < OFTEN, "insufficient_data").when(ratio >= F.lit(CONSISTENT), "promote_seed_mask").when(ratio <= F.lit(1.0 - CONSISTENT), "promote_seed_skip").otherwise("context_dependent")


def recommendation_counts(aggregated: DataFrame) -> DataFrame:
    """A3."""
    return aggregated.groupBy(recommend(F.col("total"), F.col("mask_ratio")).alias("recommendation")).agg(F.count(F.lit(1)).alias("terms"))


def session_summary(rows: DataFrame, session: str) -> DataFrame:
    """A4."""
    masked = F.coalesce(F.col("decision") == "mask", F.lit(False))
    return rows.filter(F.col("session_id") == session).agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("decisions"), F.count_if(masked).alias("masked"), F.count_if(~masked).alias("skipped"))


def history(aggregated: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """T5: the k terms with most decisions, and how many more there are."""
    return aggregated.orderBy(F.desc("total"), "term").limit(k), aggregated.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("remaining"))


def upsert_seeds(seeds: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all seeds, those added). new: customer_id, text, label; labels of decisions become labels of seeds, so that they are found again."""
    names = F.create_map(*[F.lit(x) for kv in SEED_LABELS.items() for x in kv])
    rows = new.select("customer_id", F.trim("text").alias("text"), F.coalesce(F.element_at(names, F.upper("label")), F.upper("label")).alias("label"), F.lit(None).cast("string").alias("canonical"), F.lit(True).alias("confirm"))
    added = rows.filter("text <> ''").dropDuplicates(["customer_id", "text"]).join(seeds.select("customer_id", "text").hint("merge"), ["customer_id", "text"], "left_anti")
    return seeds.unionByName(added), added


def upsert_allow(allowed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all allowed terms, those added). Rows: customer_id, category, term."""
    rows = new.select("customer_id", F.coalesce("category", F.lit("user")).alias("category"), F.trim("term").alias("term")).filter("term <> ''")
    added = rows.dropDuplicates(["customer_id", "term"]).join(allowed.select("customer_id", "term").hint("merge"), ["customer_id", "term"], "left_anti")
    return allowed.unionByName(added), added


def promotions(aggregated: DataFrame, customer: str) -> tuple[DataFrame, DataFrame]:
    """What the recommendations add to a customer's dictionaries: (seeds, allowed terms)."""
    told = aggregated.withColumn("r", recommend(F.col("total"), F.col("mask_ratio")))
    who = F.lit(customer).alias("customer_id")
    return told.filter("r = 'promote_seed_mask'").select(who, F.col("term").alias("text"), "label"), told.filter("r = 'promote_seed_skip'").select(who, F.lit("user").alias("category"), "term")


def feedback_key(*parts: Column) -> Column:
    """The first 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def with_feedback(issues: DataFrame, feedback: DataFrame, parts: tuple[str, ...] = ("source_document", "title", "details")) -> DataFrame:
    """Issues with a rating, 未評価 where there is none."""
    keyed = issues.withColumn("feedback_key", feedback_key(*[F.coalesce(F.col(p), F.lit("")) for p in parts]))
    return keyed.join(feedback.select("feedback_key", "rating").dropDuplicates(["feedback_key"]).hint("merge"), "feedback_key", "left").withColumn("rating", F.coalesce("rating", F.lit("未評価")))


def feedback_counts(rated: DataFrame) -> DataFrame:
    """Counts per rating with the total (null) by rollup."""
    return rated.rollup("rating").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") != "未評価").alias("n_rated"))
