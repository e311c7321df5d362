"""More registered queries: sources, exports and the smaller operators, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkveil.operators import dictionary, gate, remediation, replies, structure
from inkveil.plans import tables as T
from inkveil.plans.queries import _ISSUE_SQL, query
from inkveil.sources import files
from inkveil.sources.scratch import scratch_dir


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT page_id, 'page_id=' || page_id AS folder, html || chr(10) AS text FROM pages")
def s1_read_text_corpus(spark, sf_dir):
    """Pages written as one file each, and read back as bytes that are decoded."""
    root = _folder(spark)
    T.table(spark, sf_dir, "pages").select("page_id", "html").write.partitionBy("page_id").text(root)
    found = files.read_text_corpus(spark, root).filter(F.col("name").startswith("part-"))
    folder = F.regexp_extract("path", "(page_id=[0-9]+)/[^/]*$", 1)
    return found.select(F.substring(folder, 9, 20).cast("long").alias("page_id"), folder.alias("folder"), "text")


@query("""SELECT o_orderkey, string_agg(l_linenumber || ' | ' || 'a "' || l_returnflag || '", b' || ' | ' || ' | ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS text
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def s3_flattened_csv(spark, sf_dir):
    """S3 on texts of CSV: quoted fields with commas and quotes in them, empty fields, lines of both kinds of ends."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(',"a ""'), F.col("l_returnflag"), F.lit('"", b",,'), F.col("l_linestatus"))
    rows = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("rows"))
    docs = rows.select("o_orderkey", F.array_join(F.transform("rows", lambda x: x["t"]), "\r\n").alias("text"))
    return files.flatten_csv(docs.join(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{ "b": ' || user_id ELSE '{"a":[1,' || user_id || '],"b":"' || event_type || '"}' END AS text,
CASE WHEN event_id % 5 = 0 THEN 'invalid JSON' END AS warning FROM events""")
def s4_canonical_json(spark, sf_dir):
    """Objects with other orders and spaces become one form; what is no JSON stays, with a warning."""
    good = F.concat(F.lit('{ "b" : "'), "event_type", F.lit('",\n "a": [1, '), F.col("user_id").cast("string"), F.lit(" ] }"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{ "b": '), F.col("user_id").cast("string"))).otherwise(good)
    canonical, warning = files.canonical_json(F.col("said"))
    return T.table(spark, sf_dir, "events").select("event_id", text.alias("said")).select("event_id", canonical.alias("text"), warning.alias("warning"))


@query("""SELECT review_id, string_agg('# Slide ' || slide_no || chr(10) || text || CASE WHEN note IS NOT NULL THEN chr(10) || 'Notes: ' || note ELSE '' END, chr(10) || chr(10) ORDER BY slide_no) AS text
FROM (SELECT conv_id AS review_id, turn + 1 AS slide_no, text, CASE WHEN turn % 2 = 0 THEN role END AS note FROM conversations) GROUP BY review_id""")
def s23_slides(spark, sf_dir):
    """Turns as slides, roles as notes of every second one."""
    slides = T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("slide_no"), "text", "role")
    notes = slides.filter("slide_no % 2 = 1").select("doc", "slide_no", F.col("role").alias("text"))
    return files.assemble_slides(slides.drop("role"), notes).withColumnRenamed("doc", "review_id")


@query("""SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, count(*) AS documents, count(*) FILTER (doc_id % 11 = 0) AS blocked, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def s14_exported_bundle(spark, sf_dir):
    """The tables of a review written as JSON and read back."""
    root = _folder(spark)
    gated = T.gated_docs(spark, sf_dir)
    docs = gated.join(T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("outbound_text")).hint("merge"), "doc_id")
    docs = docs.select("review_id", F.col("doc_id").cast("int").alias("doc_ord"), "name", "outbound_text", "decision", F.array().cast("array<string>").alias("reasons"), "outbound_risk", "estimated_input_tokens")
    files.export_bundle(docs, docs.select("review_id", "name").limit(0), T.issues(spark, sf_dir), root)
    texts = spark.read.schema("review_id long, name string, outbound_text string").json(f"{root}/sanitized_text")
    log = spark.read.schema("review_id long, name string, decision string").json(f"{root}/send_log")
    both = texts.join(log.hint("merge"), ["review_id", "name"])
    chars = F.sum(F.coalesce(F.length("outbound_text"), F.lit(0))).alias("chars")
    return both.groupBy("review_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("decision") == "block").alias("blocked"), chars)


@query(f"""WITH {_ISSUE_SQL} SELECT 'plan ' || review_id AS headline, 'I' || doc_id AS item_id, CASE WHEN doc_id % 4 = 0 THEN 'medium' ELSE severity END AS severity, title, '中' AS effort FROM i""")
def s15_read_plan(spark, sf_dir):
    """A plan of each review set written as JSON, with fields left out and severities that are none, and read with its defaults."""
    root = _folder(spark)
    severity = F.when(F.col("doc_id") % 4 == 0, "grave").otherwise(F.upper("severity"))
    rows = T.issues(spark, sf_dir).withColumn("doc_id", F.col("issue_ord").cast("long"))
    item = F.struct(F.concat(F.lit("I"), F.col("doc_id").cast("string")).alias("item_id"), severity.alias("severity"), "title")
    plan = F.to_json(F.struct(F.concat(F.lit("plan "), F.col("review_id").cast("string")).alias("headline"), "items"))
    plans = rows.groupBy("review_id").agg(F.collect_list(item).alias("items")).select("review_id", plan.alias("value"))
    plans.write.partitionBy("review_id").text(root)
    return files.read_remediation_plan(spark, root).select("headline", "item_id", "severity", "title", "effort")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '送信禁止' WHEN doc_id % 3 = 0 THEN '要確認' WHEN doc_id % 17 = 0 THEN '未判定' ELSE '' END
 || CASE WHEN doc_id % 4 > 0 THEN '/uncertain ' || doc_id % 4 ELSE '' END || CASE WHEN doc_id % 6 > 0 THEN '/置換 ' || doc_id % 6 || ' 件' ELSE '' END AS reasons FROM documents""")
def f13_attention_reasons(spark, sf_dir):
    docs = T.gated_docs(spark, sf_dir).withColumn("replacements", F.array_repeat(F.lit("x"), F.col("n_replacements")))
    parts = gate.attention_reasons(docs)
    lead = F.when(F.col("decision").isin("block", "mask_and_continue") | F.col("decision").isNull(), F.lit("")).otherwise(F.when(F.size("reasons") > 0, "/").otherwise(""))
    return docs.withColumn("reasons", parts).select("doc_id", F.concat(lead, F.array_join("reasons", "/")).alias("reasons"))


@query("""SELECT conv_id AS review_id, count(*) AS total, count(*) FILTER (turn % 3 = 0) AS decided FROM conversations GROUP BY conv_id""")
def a17_decision_progress(spark, sf_dir):
    rows = T.talks(spark, sf_dir).select("review_id", "doc_ord", F.col("name").alias("text"))
    return dictionary.decision_progress(rows, rows.filter("doc_ord % 3 = 0"))


@query("SELECT p_partkey AS check_id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def f19_selected_checks(spark, sf_dir):
    """checks without profiles, and those for designs."""
    k = F.col("p_partkey")
    applies = F.when(k % 3 == 0, F.lit(None).cast("array<string>")).when(k % 2 == 0, F.array(F.lit("design"), F.lit("proposal"))).otherwise(F.array(F.lit("source_code")))
    return structure.select_checks(T.table(spark, sf_dir, "part").select(k.alias("check_id"), applies.alias("applies_to")), "design").select("check_id")


@query(f"""WITH {_ISSUE_SQL} SELECT 'I' || lpad(doc_id::VARCHAR, 12, '0') AS item_id FROM i
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, item_id LIMIT 12""")
def t4_display_order(spark, sf_dir):
    """T4: the first twelve items."""
    k = F.col("issue_ord") % 3
    effort = F.when(k == 0, "大").when(k == 1, "中").otherwise("小")
    items = T.issues(spark, sf_dir).select(F.concat(F.lit("I"), F.lpad(F.col("issue_ord").cast("string"), 12, "0")).alias("item_id"), "severity", effort.alias("effort"))
    return remediation.in_display_order(items, 12).select("item_id")


@query("""WITH k AS (SELECT p_partkey, (p_partkey % 13)::VARCHAR || '.' || (p_partkey // 13 % 17) || '.' || p_partkey AS item_id FROM part)
SELECT item_id, row_number() OVER (ORDER BY p_partkey % 13, p_partkey // 13 % 17, p_partkey) AS place FROM k QUALIFY place <= 100""")
def t8_chapter_order(spark, sf_dir):
    """The first hundred of many numbers in their order, 1.10 after 1.9."""
    k = F.col("p_partkey")
    item = F.concat_ws(".", (k % 13).cast("string"), (F.floor(k / 13) % 17).cast("string"), k.cast("string"))
    first = structure.in_chapter_order(T.table(spark, sf_dir, "part").select(item.alias("item_id"))).limit(100)
    part = lambda i: F.split("item_id", "[.]").getItem(i).cast("int")
    place = F.row_number().over(Window.orderBy(part(0), part(1), part(2)))  # over a hundred rows
    return first.withColumn("place", place.cast("long"))


@query(f"""WITH {_ISSUE_SQL}, model AS (SELECT * FROM i WHERE doc_id % 3 <> 0), static AS (SELECT * FROM i WHERE doc_id % 3 = 0),
useful AS (SELECT DISTINCT review_id FROM model WHERE severity <> 'info'),
b AS (SELECT *, 0 AS s FROM static UNION ALL SELECT *, 1 FROM model WHERE review_id IN (SELECT review_id FROM useful) OR review_id NOT IN (SELECT review_id FROM static)),
k AS (SELECT *, row_number() OVER (PARTITION BY review_id, title ORDER BY s, doc_id) AS k FROM b)
SELECT review_id, title, doc_id, s = 1 AS from_model FROM k WHERE k = 1""")
def u4_static_and_model(spark, sf_dir):
    """Rule findings and findings of a model, equal ones once, rule findings first."""
    rows = T.issues(spark, sf_dir).withColumn("source_document", F.lit("d")).withColumn("details", F.lit("")).withColumn("item_ord", F.col("issue_ord"))
    rows = rows.withColumn("from_model", F.col("issue_ord") % 3 != 0)
    found = replies.merge_static(rows.filter("not from_model"), rows.filter("from_model"))
    return found.select("review_id", "title", F.col("issue_ord").cast("long").alias("doc_id"), "from_model")


@query("""SELECT doc_id, source AS purpose, 'n' || doc_id AS scope, '' AS missing, lang AS diagnostics FROM documents""")
def n14_n16_sections(spark, sf_dir):
    """Sections of a template by label, and the workbook diagnostics of a text."""
    k = F.col("doc_id").cast("string")
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("【目的】 "), "source", F.lit("\n【範囲】\nn"), k).alias("template"), F.concat(F.lit("# Sheet\nx\n# Workbook diagnostics\n"), "lang", F.lit("\n# End\n"), "text").alias("text"))
    part = lambda label: remediation.template_section(F.col("template"), label)
    return docs.select("doc_id", part("目的").alias("purpose"), part("範囲").alias("scope"), part("期限").alias("missing"), files.without_diagnostics(F.col("text")).alias("diagnostics"))


@query("""SELECT n_nationkey AS key, 'NATION ' || n_nationkey AS canonical, n_regionkey = 0 AS confirm FROM nation WHERE n_regionkey < 3""")
def s11_u7_seeds(spark, sf_dir):
    """The dictionary common to all and that of one customer; another customer's entries are left out."""
    k = F.col("n_regionkey")
    owner = F.when(k == 1, "c1").when(~k.isin(0, 2), "c2")
    canonical = F.concat(F.lit("NATION "), F.col("n_nationkey").cast("string"))
    rows = T.table(spark, sf_dir, "nation").select(owner.alias("customer_id"), F.col("n_name").alias("text"), F.lit("GPE").alias("label"), canonical.alias("canonical"), (k == 0).alias("confirm"))
    seeds = dictionary.load_seeds(spark, rows, "c1")
    return seeds.select(F.regexp_extract("text", "([0-9]+)$", 1).cast("int").alias("key"), "canonical", "confirm")
