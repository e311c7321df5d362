"""Dictionary files: names to mask and technical terms to keep, common ones and a customer's own.

    <root>/common/...                 for all
    <root>/customers/<customer>/...   for one customer

Every file is JSON. Names (seeds*.json): a list of entries with text, label, canonical and confirm. Terms (allow*.json): an object of lists by
category, or a plain list, which is the user's. Files are read and parsed by Spark; a file that is no such JSON is reported and the others count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.text import nfkc_trim
from inkveil.operators.audit import CUSTOMER_ID

ENTRY = "array<struct<text:string,label:string,canonical:string,confirm:boolean>>"
USER = "user"


def _files(spark: SparkSession, root: str, name: str, customer: str | None) -> DataFrame:
    """path, customer_id (null for common files) and text of the files; of other customers none is opened."""
    schema = "value string"
    paths = [f"{root}/common"] if customer is None else [f"{root}/common", f"{root}/customers/{customer}"]
    read = spark.read.schema(schema).option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    out = None
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):  # a customer may have no files
            rows = read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
            out = rows if out is None else out.unionAll(rows)
    if out is None:
        out = spark.createDataFrame([], "path string, text string")
    own = F.regexp_extract("path", r"/customers/([^/]+)/", 1)
    return out.withColumn("customer_id", F.nullif(own, F.lit("")))


def _checked(customer: str | None) -> None:
    import re

    if customer is not None and not re.fullmatch(CUSTOMER_ID, customer):
        raise ValueError(f"not a customer's id: {customer!r}")


def read_seed_files(spark: SparkSession, root: str, customer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(seeds, broken files: path, error). seeds: customer_id, text, label, canonical, confirm, which is true where it is not given.

    Entries without a text are left out; blank canonical names are null; an entry that stands in several files counts once.
    """
    _checked(customer)
    files = _files(spark, root, "seeds*.json", customer).withColumn("_e", F.from_json("text", ENTRY))
    # of a list with one entry that is none, from_json gives null too
    broken = files.filter(F.col("_e").isNull()).select("path", F.lit("not a list of entries").alias("error"))
    rows = files.select("customer_id", F.explode("_e").alias("e")).select("customer_id", F.trim("e.text").alias("text"), F.upper(F.trim("e.label")).alias("label"), F.nullif(F.trim("e.canonical"), F.lit("")).alias("canonical"), F.coalesce("e.confirm", F.lit(True)).alias("confirm"))
    return rows.filter(F.coalesce("text", F.lit("")) != "").distinct(), broken


def read_allow_files(spark: SparkSession, root: str, customer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(terms, broken files: path, error). terms: customer_id, category, term_norm (normalised, in lower case), each term once.

    Of a term in several files the common one counts, then the least category.
    """
    _checked(customer)
    files = _files(spark, root, "allow*.json", customer)
    lists = F.when(F.ltrim("text").startswith("["), F.create_map(F.lit(USER), F.from_json("text", "array<string>"))).otherwise(F.from_json("text", "map<string,array<string>>"))
    files = files.withColumn("_m", lists)
    good = F.col("_m").isNotNull() & ~F.exists(F.map_values("_m"), lambda x: x.isNull())
    broken = files.filter(~F.coalesce(good, F.lit(False))).select("path", F.lit("neither lists by category nor a list").alias("error"))
    rows = files.filter(good).select("customer_id", F.explode("_m").alias("category", "_t")).select("customer_id", "category", F.explode("_t").alias("_t"))
    rows = rows.select("customer_id", "category", F.lower(nfkc_trim(F.col("_t"))).alias("term_norm")).filter(F.coalesce("term_norm", F.lit("")) != "")
    first = F.min(F.struct(F.col("customer_id").isNotNull(), "customer_id", "category"))
    return rows.groupBy("term_norm").agg(first.alias("f")).select("f.customer_id", "f.category", "term_norm"), broken
