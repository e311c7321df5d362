"""Reading documents of many formats as tables, and writing review bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkveil.operators.remediation import ITEM_DEFAULTS

# What file names are taken as.
FORMATS = {
    "text": (".txt", ".md", ".log", ".yaml", ".yml", ".xml"), "table": (".csv",), "json": (".json",), "markup": (".html", ".htm"), "document": (".docx", ".pdf"), "workbook": (".xlsx",), "slides": (".pptx",), "image": (".png", ".jpg", ".jpeg"),
    "config": (".cfg", ".conf", ".config"), "code": (".py", ".ps1", ".psm1", ".psd1", ".sh", ".bash", ".bsh", ".ksh", ".zsh", ".vbs", ".vba", ".bas", ".cls", ".frm", ".sql", ".psql"),
}
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
EMPTY_BODY = "[本文を抽出できませんでした]"
PAGE_CAP = 300
# End of the fixed values.


@F.pandas_udf(StringType())
def _decode(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for name in ("utf-8-sig", "cp932", "utf-16"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return content.map(one)


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, in the JVM; else cp932, UTF-16 or Latin-1."""
    text = content.cast("string")
    good = F.is_valid_utf8(text)
    return F.when(good, F.regexp_replace(text, "^\\uFEFF", "")).otherwise(_decode(F.when(~good, content)))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, content and text of all files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content", decoded(F.col("content")).alias("text"))


def upload_content(content: Column, encoding: Column) -> tuple[Column, Column]:
    """Bytes of an upload, and a warning where base64 could not be read and the text is taken as it is."""
    as_bytes = F.try_to_binary(content, F.lit("base64"))
    binary = encoding == "base64"
    return F.when(binary, F.coalesce(as_bytes, content.cast("binary"))).otherwise(content.cast("binary")), F.when(binary & as_bytes.isNull(), "base64 could not be decoded")


def route_by_extension(docs: DataFrame) -> DataFrame:
    """Suffix, format and warnings; unknown suffixes are read as text."""
    dim = docs.sparkSession.createDataFrame([(s, f) for f, suffixes in FORMATS.items() for s in suffixes], "suffix string, format string")
    rows = docs.withColumn("suffix", F.regexp_extract(F.lower("name"), r"(\.[^./]*)$", 1)).join(F.broadcast(dim), "suffix", "left")
    warning = F.when(F.col("format").isNull(), F.array(F.concat(F.lit("unsupported extension: "), "suffix"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("warnings", warning).withColumn("format", F.coalesce("format", F.lit("text")))


def flatten_rows(cells: DataFrame, keys: tuple[str, ...] = ("name",), order: str = "row_ord") -> DataFrame:
    """S3: rows with an array ``cells`` become lines joined by bars, in order of rows."""
    line = F.array_join("cells", " | ")
    return cells.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def flatten_csv(docs: DataFrame) -> DataFrame:
    """S3 on texts of CSV files: every line's fields, quotes included, as one line."""
    fields = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    lines = F.filter(F.split("text", r"\r\n|\r|\n", -1), lambda x: x != "")
    return docs.withColumn("text", F.array_join(F.transform(lines, lambda x: F.array_join(fields(x), " | ")), "\n"))


def canonical_json(text: Column) -> tuple[Column, Column]:
    """Valid JSON written anew, other texts as they are with a warning."""
    parsed = F.try_parse_json(text)
    return F.coalesce(F.to_json(parsed), text), F.when(parsed.isNull(), "invalid JSON")


def strip_markup(html: Column) -> Column:
    """Text without scripts, styles and tags, entities resolved, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def with_context_header(docs: DataFrame) -> DataFrame:
    """Name, format and notes before the text; a fixed line for empty ones."""
    notes = F.when(F.size("warnings") > 0, F.concat(F.lit("Notes: "), F.array_join("warnings", "; ")))
    body = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit(EMPTY_BODY))
    return docs.withColumn("text", F.concat_ws("\n", F.concat(F.lit("File: "), "name"), F.concat(F.lit("Format: "), "format"), notes, F.lit(""), body))


def _sections(rows: DataFrame, number: str, title: str) -> DataFrame:
    part = F.concat(F.lit(f"# {title} "), F.col(number).cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.max(number).alias("last"))


def assemble_pages(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """S7. pages: doc, page_no, text. Texts of at most ``cap`` pages, with a warning where there are more."""
    total = pages.groupBy("doc").agg(F.max("page_no").alias("pages"))
    out = _sections(pages.filter(F.col("page_no") <= cap), "page_no", "Page")
    return out.drop("last").join(total, "doc").withColumn("warning", F.when(F.col("pages") > cap, F.format_string("only %d of %d pages", F.lit(cap), "pages")))


def assemble_slides(slides: DataFrame, notes: DataFrame) -> DataFrame:
    """S23. slides, notes: doc, slide_no, text."""
    both = slides.join(notes.select("doc", "slide_no", F.col("text").alias("note")), ["doc", "slide_no"], "left")
    return _sections(both.withColumn("text", F.concat_ws("\n", "text", F.when(F.trim("note") != "", F.concat(F.lit("Notes: "), "note")))), "slide_no", "Slide").drop("last")


def workbook_diagnostics(cells: DataFrame) -> DataFrame:
    """S8. cells: doc, sheet, state, row, col, value, formula, hyperlink, merged_range. Counts per sheet and per workbook (null sheet)."""
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    return cells.rollup("doc", "sheet").agg(
        F.countDistinct("sheet", "row").alias("rows"), F.count_if(filled).alias("non_empty"), F.count_if(F.coalesce("formula", F.lit("")) != "").alias("formulas"), F.count_if(F.coalesce("hyperlink", F.lit(False))).alias("links"),
        F.countDistinct("sheet", "merged_range").alias("merged_ranges"), F.array_sort(F.collect_set(F.when(F.col("state") != "visible", F.col("sheet")))).alias("hidden_sheets"),
    ).filter("doc is not null")


def without_diagnostics(text: Column) -> Column:
    """The part of a text that is its workbook diagnostics."""
    return F.trim(F.regexp_extract(text, r"(?s)# Workbook diagnostics\n(.*?)(?=\n# |\z)", 1))


def export_bundle(documents: DataFrame, candidates: DataFrame, issues: DataFrame, root: str) -> None:
    """Four tables of a review as JSON, one folder each, with the review_id in every row."""
    documents.select("review_id", "doc_ord", "name", "outbound_text").write.mode("overwrite").json(f"{root}/sanitized_text")
    candidates.write.mode("overwrite").json(f"{root}/mask_candidates")
    documents.select("review_id", "name", "decision", "reasons", "outbound_risk", "estimated_input_tokens").write.mode("overwrite").json(f"{root}/send_log")
    issues.write.mode("overwrite").json(f"{root}/review_result")


def read_remediation_plan(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved plans, every missing field with its default; a plan without items is an error when read."""
    fields = ", ".join(f"{c}: string" for c in ITEM_DEFAULTS)
    plans = spark.read.schema(f"headline string, items array<struct<{fields}>>").option("multiLine", "true").json(path)
    items = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, F.col("items")).otherwise(F.raise_error(F.lit("the plan has no items")))
    rows = plans.select("headline", F.posexplode(items).alias("item_ord", "i"))
    filled = [F.coalesce(F.nullif(F.trim(F.col("i")[c]), F.lit("")), F.lit(d)).alias(c) for c, d in ITEM_DEFAULTS.items() if c != "severity"]
    severity = F.lower(F.trim(F.col("i.severity")))
    return rows.select("headline", "item_ord", *filled, F.when(severity.isin("high", "medium", "low", "info"), severity).otherwise("medium").alias("severity"))
