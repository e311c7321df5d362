"""Work items from issues and findings, and their comparison with later texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.matching import containing_pairs

# Words and wordings of items.
CONNECTIVES = "(および|及び|ならびに|または|について|として|すること|してください|あります|できます)"
STOPWORDS = ("この", "その", "ため", "もの", "こと", "以下", "以上", "対象", "対象文書", "該当", "該当箇所", "文書", "修正", "追記", "確認", "再レビュー", "レビュー", "計画", "方針", "内容", "現状", "問題点", "完了条件", "判断基準", "記載", "必要", "不足")
CURRENT_STATE = (r"(?s)【現状】\s*(.+?)(?=(?:\n|\s*)【(?:問題点|影響|推奨対応|詳細|対応)】|\z)", r"(?m)^\s*現状[:：]\s*(.+?)(?=\n|\z)", r"(?m)^\s*現状の記載[:：]\s*(.+?)(?=\n|\z)")
STEPS = {"high": ("必須再レビュー", "必須再解析"), "medium": ("差分レビュー", "差分確認"), "": ("完了確認", "動作確認")}
HEADLINES = {"high": ("重要指摘から修正計画を作成しました", "コード解析結果から修正チェックリストを作成しました"), "medium": ("確認候補の修正計画を作成しました", "コード解析結果から確認チェックリストを作成しました"), "low": ("軽微な改善計画を作成しました", "軽微なコード改善チェックリストを作成しました"), "": ("大きな修正アクションはありません", "大きなコード修正アクションはありません")}
NOWHERE = ("該当箇所", "文書全体")
# End of the fixed values.
MAX_ITEMS, MAX_TERMS, SHOWN_TERMS = 12, 14, 10
ITEM_DEFAULTS = {"item_id": "ITEM", "source_type": "review_issue", "severity": "medium", "title": "レビュー指摘", "target_document": "対象文書", "target_section": "該当箇所", "problem": "", "fix_policy": "", "template": "", "re_review_scope": "", "re_review_condition": "", "effort": "中", "origin": "initial", "current_state": "", "impact": "", "completion_condition": "", "review_mode": "", "code_language": "", "evidence_snippet": "", "evidence_line": "", "basis": "", "confidence": ""}


def _or(column: str | Column, default: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def severity_rank(column: Column) -> Column:
    return F.when(column == "high", 0).when(column == "medium", 1).when(column == "low", 2).when(column == "info", 3).otherwise(9)


def effort(severity: Column) -> Column:
    """N12."""
    return F.when(severity == "high", "大").when(severity == "medium", "中").otherwise("小")


def current_state(details: Column) -> Column:
    """What the details say about the present state; null if nothing."""
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(details, p, 1), r"\s+", " ")), F.lit("")) for p in CURRENT_STATE]
    return F.coalesce(*found)


def fallback_issue_id(*parts: Column) -> Column:
    """N5."""
    return F.concat(F.lit("ISSUE-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 8)))


def evidence_line(evidence: Column) -> Column:
    """The line number that an evidence text tells."""
    return F.regexp_extract(F.coalesce(evidence, F.lit("")), r"(\d+)\s*行目", 1)


def evidence_basis(issue_origin: Column, evidence: Column) -> Column:
    """How a code finding is known; its confidence follows."""
    return F.when(issue_origin == "static_code_analysis", "static").when(evidence_line(evidence) != "", "line").otherwise("model")


def confidence(basis: Column) -> Column:
    return F.when(basis == "static", "high").when(basis == "line", "medium").otherwise("low")


def items_from_issues(issues: DataFrame, code: Column) -> DataFrame:
    section = _or("section", "該当箇所")
    rows = issues.filter(F.col("severity").isin("high", "medium", "low"))
    doc = _or("source_document", "対象文書")
    evidence = _or("current_state", "")
    basis = F.when(code, evidence_basis(F.col("origin"), evidence)).otherwise("")
    return rows.select(
        "review_id", _or("issue_id", fallback_issue_id(F.col("source_document"), F.col("section"), F.col("title"))).alias("item_id"), F.lit("review_issue").alias("source_type"), "severity", _or("title", "レビュー指摘").alias("title"),
        doc.alias("target_document"), section.alias("target_section"), _or("issue", _or("details", F.col("title"))).alias("problem"), _or("recommendation", "指摘箇所に、判断根拠・設計方針・完了条件を追記してください。").alias("fix_policy"),
        F.format_string("【%s】\n%s", section, _or("recommendation", "")).alias("template"), F.concat(doc, F.lit(" / "), section).alias("re_review_scope"), _condition(F.col("severity"), section).alias("re_review_condition"), effort(F.col("severity")).alias("effort"), _or("origin", "initial").alias("origin"),
        F.when(code, evidence).otherwise(_or("current_state", F.coalesce(current_state(F.col("details")), F.lit("")))).alias("current_state"), _or("impact", "未対応時の影響を記載してください。").alias("impact"), F.lit("読み手が設計判断、根拠、運用時の判断基準を追えること。").alias("completion_condition"),
        F.when(code, "code_analysis").otherwise("").alias("review_mode"), F.when(code, evidence_line(evidence)).otherwise("").alias("evidence_line"), basis.alias("basis"), F.when(code, confidence(basis)).otherwise("").alias("confidence"),
    )


def _condition(severity: Column, section: Column) -> Column:
    """N13."""
    return F.when(severity == "high", F.format_string("「%s」の修正後に必ず再レビュー", section)).when(severity == "medium", F.format_string("「%s」の差分を再レビュー", section)).otherwise(F.format_string("「%s」を次回レビュー時に確認", section))


def items_from_findings(findings: DataFrame) -> DataFrame:
    kind = F.col("kind")
    title = (
        F.when(kind == "missing_chapter", F.concat(F.lit("不足観点: "), _or("chapter_name", "未指定"))).when(kind == "required_item_gap", F.concat(F.lit("必須要素不足: "), _or("item_name", _or("chapter_name", "未指定"))))
        .when(kind == "structure_template_suggestion", "章立てテンプレート案").when(kind == "structure_organization_suggestion", F.concat(F.lit("構成整理: "), _or("chapter_name", "関連記述"))).otherwise(_or("chapter_name", _or("item_name", "構成チェック指摘")))
    )
    section, doc = _or("chapter_name", _or("item_name", "文書全体")), _or("source_document", "文書全体")
    rows = findings.filter(F.col("severity").isin("high", "medium"))
    empty = F.lit("")
    return rows.select(
        "review_id", _or("item_id", _or("chapter_id", F.col("kind"))).alias("item_id"), F.lit("structure_check").alias("source_type"), "severity", title.alias("title"), doc.alias("target_document"), section.alias("target_section"), title.alias("problem"), _or("expected_content", "").alias("fix_policy"),
        F.format_string("【%s】\n%s", section, _or("expected_content", "")).alias("template"), F.concat(doc, F.lit(" / "), section).alias("re_review_scope"), _condition(F.col("severity"), section).alias("re_review_condition"), effort(F.col("severity")).alias("effort"), F.lit("initial").alias("origin"),
        empty.alias("current_state"), F.lit("章立てや必須要素が不足すると、読み手が設計判断・責任範囲・運用条件を追いにくくなります。").alias("impact"), F.lit("不足観点が独立した見出しまたは明確な本文として確認できること。").alias("completion_condition"),
        empty.alias("review_mode"), empty.alias("evidence_line"), empty.alias("basis"), empty.alias("confidence"),
    )


def in_work_order() -> list[Column]:
    """T3."""
    return [severity_rank(F.col("severity")), F.when(F.col("source_type") == "structure_check", 0).otherwise(1), F.col("target_document"), F.col("target_section"), F.col("item_id"), F.col("title")]


def in_display_order(items: DataFrame, k: int = MAX_ITEMS) -> DataFrame:
    """T4: severity, then effort from large to small, then id."""
    return items.orderBy(severity_rank(F.col("severity")), F.when(F.col("effort") == "大", 0).when(F.col("effort") == "中", 1).otherwise(2), "item_id").limit(k)


def build_remediation(issues: DataFrame, findings: DataFrame, profiles: DataFrame, most: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P14. profiles: review_id, document_profile. (items, steps, one row per set with headline and counts)."""
    coded = issues.join(profiles.select("review_id", (F.col("document_profile") == "source_code").alias("_code")).hint("merge"), "review_id", "left")
    items = items_from_issues(coded, F.coalesce("_code", F.lit(False)))
    prose = findings.join(profiles.filter("document_profile = 'source_code'").select("review_id").hint("merge"), "review_id", "left_anti")
    items = items.unionByName(items_from_findings(prose))
    once = F.row_number().over(Window.partitionBy("review_id", "source_type", "target_document", "target_section", "title").orderBy(*in_work_order()))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy(*in_work_order()))
    items = items.withColumn("_k", once).filter("_k = 1").drop("_k").withColumn("work_ord", place).filter(F.col("work_ord") <= most)
    counts = severity_counts(items)
    sets = profiles.select("review_id", (F.col("document_profile") == "source_code").cast("int").alias("_code")).join(counts.hint("merge"), "review_id", "left").fillna(0)
    said = lambda key: F.element_at(F.array(*map(F.lit, HEADLINES[key])), F.col("_code") + 1)
    headline = F.when(F.col("high") > 0, said("high")).when(F.col("medium") > 0, said("medium")).when(F.col("low") > 0, said("low")).otherwise(said(""))
    sets = sets.withColumn("headline", headline)
    step = lambda key, o, n: F.struct(F.lit(o).alias("step_ord"), F.element_at(F.array(*map(F.lit, STEPS[key])), F.col("_code") + 1).alias("step"), n.alias("n_items"))
    steps = sets.select("review_id", F.explode(F.filter(F.array(F.when(F.col("high") > 0, step("high", 1, F.col("high"))), F.when(F.col("medium") > 0, step("medium", 2, F.col("medium"))), step("", 3, F.col("high") + F.col("medium") + F.col("low"))), lambda x: x.isNotNull())).alias("s")).select("review_id", "s.*")
    return items, steps, sets.drop("_code")


def severity_counts(items: DataFrame) -> DataFrame:
    """A9."""
    return items.groupBy("review_id").pivot("severity", ["high", "medium", "low"]).count().fillna(0)


def squeezed_lower(column: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"(?U)\s+", ""))


def remediation_terms(*columns: Column) -> Column:
    """At most 14 useful words of an item, each once."""
    source = F.regexp_replace(F.concat_ws("\n", *columns), CONNECTIVES, " ")
    found = F.transform(F.regexp_extract_all(source, F.lit("[A-Za-z][A-Za-z0-9_-]{1,}|[一-龥ぁ-んァ-ヶー]{2,}"), F.lit(0)), lambda x: F.btrim(x, F.lit(" _-:：・、。,.()（）[]【】「」『』")))
    useful = F.filter(found, lambda x: F.length(x).between(2, 32) & ~F.lower(x).isin(*STOPWORDS))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))
    once = F.aggregate(useful, start, lambda s, x: F.when(F.array_contains(s["keys"], F.lower(x)), s).otherwise(F.struct(F.concat(s["keys"], F.array(F.lower(x))).alias("keys"), F.concat(s["out"], F.array(x)).alias("out"))), lambda s: s["out"])
    return F.slice(once, 1, MAX_TERMS)


#: Bit of the section among the bits of an item's terms.
SECTION_BIT = 62


def _probes(items: DataFrame, keys: list[str]) -> DataFrame:
    """What is looked for in the texts of ``keys``: all terms of all items there in one list, each with its item and bit."""
    wanted = F.transform("_terms", lambda x, k: F.struct(squeezed_lower(x).alias("word"), k.alias("bit")))
    wanted = F.when(F.col("_section") != "", F.concat(wanted, F.array(F.struct(F.col("_section").alias("word"), F.lit(SECTION_BIT).alias("bit"))))).otherwise(wanted)
    rows = items.select(*keys, "_item", F.explode(wanted).alias("w"))
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("_item", "w.word", "w.bit")).alias("_probes"))


def compare_remediation(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether the words of each item are now in its document, or, where that isn't there or is empty, in any document of the set.

    Documents are asked where they stand for all terms of their set's items, and answer with an item's terms as bits, which are put together by item;
    no text leaves its row, and a set's texts are never in one.
    """
    terms = remediation_terms(*[F.col(c) for c in ("title", "target_section", "problem", "fix_policy", "template", "re_review_condition")])
    section = F.when((F.col("target_section") != "") & ~F.col("target_section").isin(*NOWHERE), squeezed_lower(F.col("target_section"))).otherwise("")
    rows = items.withColumn("_terms", terms).withColumn("_section", F.coalesce(section, F.lit(""))).withColumn("_item", F.xxhash64("review_id", "item_id", "title", "target_document", "target_section"))
    # the last document of a name is meant
    last = docs.groupBy("review_id", F.col("name").alias("target_document")).agg(F.max_by(F.struct("doc_ord", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("full")), "doc_ord").alias("_l"))
    last = last.filter("_l.full").select("review_id", "target_document", F.col("_l.doc_ord").alias("doc_ord"))
    rows = rows.join(last.withColumnRenamed("doc_ord", "_own").hint("merge"), ["review_id", "target_document"], "left")
    texts = docs.select("review_id", "doc_ord", squeezed_lower(F.col("text")).alias("_t"))
    own = texts.join(_probes(rows.filter("_own is not null").withColumnRenamed("_own", "doc_ord"), ["review_id", "doc_ord"]).hint("merge"), ["review_id", "doc_ord"])
    wide = texts.join(_probes(rows.filter("_own is null"), ["review_id"]).hint("merge"), "review_id")
    found = own.select("_t", "_probes").unionAll(wide.select("_t", "_probes"))
    found = found.select(F.explode(F.filter("_probes", lambda p: F.contains("_t", p["word"]))).alias("p")).groupBy("p._item").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))).alias("_bits"))
    rows = rows.join(found.hint("merge"), "_item", "left").withColumn("_bits", F.coalesce("_bits", F.lit(0).cast("long")))
    has = lambda bit: F.shiftrightunsigned(F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    hits = F.array(*[F.when(has(k), F.get("_terms", F.lit(k))) for k in range(MAX_TERMS)])
    rows = rows.withColumn("_matched", F.filter(hits, lambda x: x.isNotNull()))
    n, m = F.size("_terms"), F.size("_matched")
    score = F.when(n > 0, m / n).otherwise(0.0)
    status = F.when(n == 0, "needs_review").when((score >= 0.55) | (has(SECTION_BIT) & (score >= 0.35)) | (m >= 5), "improved").when((score >= 0.25) | (m >= 2), "partial").otherwise("not_confirmed")
    return rows.select("review_id", "item_id", "title", "severity", "target_document", "target_section", status.alias("status"), F.round(score, 3).alias("score"), F.slice("_matched", 1, SHOWN_TERMS).alias("matched_terms"), F.slice(F.array_except("_terms", "_matched"), 1, SHOWN_TERMS).alias("missing_terms"))


def comparison_counts(compared: DataFrame) -> DataFrame:
    """A10."""
    return compared.groupBy("review_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("improved", "partial", "not_confirmed", "needs_review")])


def items_to_chapters(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first chapter, in order of documents and chapters, whose document and label an item names.

    Names of documents are found in each other by their beginnings, so an item meets the chapters of the documents that it names, not all of its set.
    """
    named = containing_pairs(items.select("review_id", F.col("target_document").alias("text")), chapters.select("review_id", F.col("name").alias("text")), ["review_id"])
    named = named.select("review_id", F.col("left").alias("target_document"), F.col("right").alias("_d"))
    own = chapters.select("review_id", "doc_ord", F.col("name").alias("_d"), "chapter_ord", "chapter_id", "chapter_label")
    both = items.join(named.hint("merge"), ["review_id", "target_document"]).join(own.hint("merge"), ["review_id", "_d"])
    section, label = squeezed_lower(F.col("target_section")), squeezed_lower(F.col("chapter_label"))
    both = both.filter(F.contains(section, label) | F.contains(label, section))
    first = F.min_by(F.struct("chapter_id", "chapter_label"), F.struct("doc_ord", "chapter_ord"))
    return both.groupBy("review_id", "item_id").agg(first.alias("c")).select("review_id", "item_id", "c.*")


def template_section(template: Column, label: str) -> Column:
    """What stands under a label of a template."""
    return F.regexp_extract(template, rf"(?s)【\Q{label}\E】\s*(.*?)\s*(?=【|\z)", 1)
