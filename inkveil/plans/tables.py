"""Tables of the library's own shapes, derived by Spark from the given ones; they grow with these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.text import estimate_tokens

# Words of the derived designs: those of the standard structure, and vague ones.
DESIGN_WORDS = ("目的と背景", "業務要件と機能要件", "全体構成と構成図", "ネットワークとVPC", "認証と権限", "適宜確認する", "監視とアラート", "可用性とDR、RTO", "必要に応じて切替える", "暗号と監査ログ", "運用とバックアップ", "冗長化する", "関係者と体制", "移行と切戻し", "リスクと前提")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key. A file may be one group of rows, which one task has to read; what is then done with the texts should run in all."""
    return rows.repartition(key)


def review_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in review sets of twenty: review_id, doc_ord, name, text."""
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".csv", ".pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(F.floor(F.col("doc_id") / 20).alias("review_id"), (F.col("doc_id") % 20).cast("int").alias("doc_ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), suffix).alias("name"), "text")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as review sets: a set per conversation, a document per turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").cast("int").alias("doc_ord"), F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string")).alias("name"), "text")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a decision log."""
    e = table(spark, sf_dir, "events")
    mask = (F.col("event_id") % 10 != 0) & ((F.col("user_id") % 3 == 0) | (F.col("event_id") % 2 == 0))
    return e.select(
        F.lit("1").alias("schema_version"), "ts", F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("customer_id"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"),
        F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")).alias("doc"), F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("term"), F.lit("ORG").alias("label"), F.lit("seed_dict").alias("source"),
        F.when(mask, "mask").otherwise("skip").alias("decision"), F.concat(F.lit("x"), (F.col("event_id") % 3).cast("string")).alias("context"), "event_id",
    )


def gated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a decision, a risk and numbers, as the gate would leave them."""
    d = table(spark, sf_dir, "documents")
    decision = F.when(F.col("doc_id") % 11 == 0, "block").when(F.col("doc_id") % 3 == 0, "mask_and_continue").when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise("safe")
    risk = F.when(F.col("doc_id") % 23 == 0, "high").when(F.col("doc_id") % 5 == 0, "medium").otherwise("low")
    return d.select(F.floor(F.col("doc_id") / 20).alias("review_id"), F.col("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), decision.alias("decision"), risk.alias("outbound_risk"), (F.col("doc_id") % 6).cast("int").alias("n_replacements"), (F.col("doc_id") % 4).cast("int").alias("n_uncertain"), estimate_tokens(F.col("text")).alias("estimated_input_tokens"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as issues of a review; the whole text, in thirds, is what the issue, its details and its recommendation say."""
    rows = spread(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "doc_id")
    severity = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").when(F.col("doc_id") % 5 == 0, "info").otherwise("low")
    third = F.ceil(F.length("text") / 3).cast("int")
    return rows.select(
        F.floor(F.col("doc_id") / 20).alias("review_id"), F.col("doc_id").cast("int").alias("issue_ord"), F.lit("").alias("issue_id"), severity.alias("severity"), F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("title"), F.substring("text", third + 1, third).alias("details"),
        F.substring("text", 2 * third + 1, third).alias("recommendation"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_document"), F.concat(F.lit("第 "), (F.col("doc_id") % 15 + 1).cast("string"), F.lit(" 章")).alias("section"), F.lit("").alias("current_state"),
        F.substring("text", 1, third).alias("issue"), F.lit("").alias("impact"), F.lit("initial").alias("origin"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IOS-like configuration of each order, from its lines: review_id, doc_ord, name, text."""
    line = F.concat(F.lit("interface Gi0/"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\n description to "), F.col("l_returnflag"))).otherwise(F.lit("")), F.lit("\n!"))
    body = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t"))))["t"], "\n").alias("lines"))
    o = table(spark, sf_dir, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    text = F.concat_ws(
        "\n", F.format_string("hostname core-sw-%d", k), "lines", F.lit("line vty 0 4"), F.when(k % 5 == 0, " transport input telnet ssh").otherwise(" transport input ssh"), F.when(k % 7 == 0, "snmp-server community public RO"), F.when(k % 3 == 0, "enable password x1"), F.when(k % 9 == 0, "enable secret y2"),
        F.when(k % 4 == 0, "ip http server"), F.when(k % 6 == 0, "access-list 101 permit ip any any"), F.when(k % 2 == 0, "aaa new-model"), F.when(k % 8 == 0, "logging host 10.0.0.9"), F.when(k % 10 == 0, "ntp server 10.0.0.8"), F.lit("router ospf 1"),
    )
    return o.select(F.floor(k / 20).alias("review_id"), (k % 20).cast("int").alias("doc_ord"), F.format_string("cisco-%d-config.cfg", k).alias("name"), text.alias("text"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FortiOS-like policy list of each order."""
    n = F.col("l_linenumber")
    one = F.concat(F.lit("    edit "), n.cast("string"), F.lit("\n        set srcintf \"a\"\n        set srcaddr \"all\"\n        set dstaddr "), F.when(n % 3 == 0, '"all"').otherwise('"net"'), F.lit("\n        set service \"ALL\"\n        set action accept\n    next"))
    body = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", one.alias("t"))))["t"], "\n").alias("lines"))
    k = F.col("l_orderkey")
    text = F.concat_ws("\n", F.lit("config firewall policy"), "lines", F.lit("end"), F.when(k % 2 == 0, "config system ntp\nend"), F.when(k % 3 == 0, "config system ha\nend"), F.when(k % 5 == 0, "config system snmp community\nend"), F.when(k % 4 == 0, "config system interface\n    edit \"port1\"\n        set allowaccess ping http\n    next\nend"))
    return body.select(F.floor(k / 20).alias("review_id"), (k % 20).cast("int").alias("doc_ord"), F.format_string("fortigate-%d.conf", k).alias("name"), text.alias("text"))


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design-like texts: a document's whole text in 3 to 14 chapters of equal length, with words of the standard structure that depend on its id."""
    k = F.col("doc_id")
    chapters = F.pmod(k, F.lit(12)) + 3
    # a column of its own, so that a text is not measured again for each chapter
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", F.ceil(F.length("text") / chapters).cast("int").alias("size"))
    size = F.col("size")
    chapter = lambda i: F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 章 "), F.element_at(F.array(*map(F.lit, DESIGN_WORDS)), (i + 1).cast("int")), F.lit("\n"), F.substring(F.col("text"), (i * size + 1).cast("int"), size), F.lit("\n"), F.element_at(F.array(*map(F.lit, DESIGN_WORDS)), (F.pmod(k + i, F.lit(15)) + 1).cast("int")))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), chapters - 1), chapter), "\n")
    return rows.select(F.floor(k / 20).alias("review_id"), (k % 20).cast("int").alias("doc_ord"), F.concat(F.lit("基本設計"), k.cast("string"), F.lit(".docx")).alias("name"), text.alias("text"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts made of events: a few calls each."""
    k = F.col("event_id")
    text = F.concat_ws("\n", F.format_string("def run_%d(event, context):", k), F.when(k % 2 == 0, "    print(event)"), F.when(k % 3 == 0, '    password = "abc123"'), F.when(k % 5 == 0, "    requests.get(url)"), F.when(k % 7 == 0, "    os.system(cmd)"), F.when(k % 11 == 0, "    try:\n        pass\n    except Exception:\n        pass"), F.when(k % 4 == 0, "    requests.post(url, timeout=3, verify=False)"), F.when(k % 13 == 0, '    run("rm -rf /tmp/x")'))
    return spread(table(spark, sf_dir, "events"), "event_id").select(F.floor(k / 20).alias("review_id"), (k % 20).cast("int").alias("doc_ord"), F.format_string("job%d.py", k).alias("name"), text.alias("text"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a reviewer, as JSON or lines, made of labelled documents: review_id, doc, doc_ord, reply, failed."""
    i = issues(spark, sf_dir)
    one = F.struct("severity", "title", F.lit("").alias("details"), F.col("title").alias("issue"), F.col("source_document").alias("source_document"), "section")
    obj = F.to_json(F.struct(F.struct(F.col("title").alias("purpose"), F.lit("ok").alias("overall_evaluation")).alias("summary"), F.array(one, F.struct(F.lit("severity").alias("severity"), F.lit("title").alias("title"), F.lit("").alias("details"), F.lit("").alias("issue"), F.lit("").alias("source_document"), F.lit("").alias("section"))).alias("issues")))
    text = F.when(F.col("issue_ord") % 7 == 0, F.concat(F.lit("ISSUE|"), "severity", F.lit("|"), "title", F.lit("|d|r|"), "source_document")).when(F.col("issue_ord") % 5 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj)
    return i.select("review_id", F.col("source_document").alias("doc"), F.col("issue_ord").alias("doc_ord"), text.alias("reply"), (F.col("issue_ord") % 19 == 0).alias("failed"))
