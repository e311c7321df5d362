"""Reply tables of a reviewer: parsing, filtering against facts, merging; and the payload table that goes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import estimate_tokens, excerpt, normalise_placeholders, unapproved_placeholders
from inkveil.operators.gate import max_risk, unique_findings
from inkveil.operators.masking import PREVIEW_CHARS, masked_text
from inkveil.operators.ranking import ranked
from inkveil.operators.rules import assign_issue_ids, code_language, defined_functions
from inkveil.operators.structure import extract_chapters

# Enums, echoed words and wordings.
SEVERITIES = ("high", "medium", "low", "info")
STATUSES = ("pass", "partial", "fail", "not_applicable", "needs_human_review", "unknown")
VERDICTS = ("missing", "not_needed", "covered_elsewhere")
ECHOED = ("severity", "title", "details", "recommendation", "source_document", "<severity>", "<title>", "<details>", "<recommendation>", "<source_document>", "<重大度>", "<タイトル>", "<詳細>", "<推奨対応>", "<出典文書名>")
TRUE_WORDS = ("true", "1", "yes", "要", "必要")
UNPARSED = "LLM応答形式を解析できませんでした"
SYNTAX_CLAIMS = ("構文エラー", "syntax error", "syntaxerror", "構文不正")
MISSING_SOURCE_CLAIMS = ("ソースコードがありません", "コードが提供されていません", "ソースコードが提供されていない", "no source code")
ARTEFACT_CLAIMS = ("プレースホルダ", "placeholder", "[secret_", "[mask_")
UNDEFINED_CLAIMS = ("未定義", "undefined", "not defined", "定義されていません")
# End of the fixed values.
ISSUE_SCHEMA = "severity string, title string, details string, recommendation string, source_document string, section string, current_state string, issue string, impact string, required_timing string, re_review_required string"
SUMMARY_SCHEMA = "purpose string, purpose_section_in_document string, purpose_divergence string, content_outline string, overall_evaluation string, verdict string"


def json_object(reply: Column) -> Column:
    """The reply from its first { to its last }, without code fences."""
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^\s*```[A-Za-z]*\s*$", "")
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def _trimmed(column: Column) -> Column:
    return F.trim(F.coalesce(column, F.lit("")))


def valid_severity(column: Column) -> Column:
    """F16."""
    return F.lower(_trimmed(column)).isin(*SEVERITIES)


def placeholder_echo(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(_trimmed(c)).isin(*ECHOED)
    return out


def _items(replies: DataFrame, field: str, schema: str) -> DataFrame:
    """One row per object of an array in the reply. Every value is read as text."""
    fields = ", ".join(f"{part}" for part in schema.split(", "))
    parsed = F.from_json(json_object(F.col("reply")), f"{field} array<struct<{fields.replace(' string', ':string')}>>", {"mode": "PERMISSIVE", "primitivesAsString": "true"})
    kept = [c for c in replies.columns if c != "reply"]
    return replies.select(*kept, F.posexplode(parsed[field]).alias("item_ord", "i")).filter(F.col("i").isNotNull()).select(*kept, "item_ord", "i.*")


def parse_issues(replies: DataFrame) -> DataFrame:
    """S16. replies: review_id, doc (default source), reply. Issues; broken objects, severities and echoes are left out."""
    rows = _items(replies, "issues", ISSUE_SCHEMA)
    rows = rows.filter(valid_severity(F.col("severity")) & ~placeholder_echo(*[F.col(c) for c in ("title", "details", "recommendation", "current_state", "issue", "impact")]))
    for c in ISSUE_SCHEMA.replace(" string", "").split(", "):
        rows = rows.withColumn(c, _trimmed(F.col(c)))
    parts = F.concat_ws(" ", *[F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c))) for c, label in (("current_state", "【現状】"), ("issue", "【問題点】"), ("impact", "【影響】"))])
    rows = rows.withColumn("details", F.when(F.col("details") == "", parts).otherwise(F.col("details"))).filter((F.col("title") != "") | (F.col("details") != ""))
    default = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v) if isinstance(v, str) else v)
    return rows.withColumns({
        "severity": F.lower("severity"), "title": default("title", "(無題の指摘)"), "details": default("details", "(詳細なし)"), "recommendation": default("recommendation", "(推奨対応の記載なし)"),
        "source_document": default("source_document", F.coalesce("doc", F.lit("-"))), "re_review_required": F.lower("re_review_required") == "true", "origin": F.lit("initial"),
    })


def parse_summary(replies: DataFrame) -> DataFrame:
    """The structured summary, or the text of an old one as overall_evaluation; M5 emptiness."""
    body = json_object(F.col("reply"))
    kept = [c for c in replies.columns if c != "reply"]
    s = F.from_json(F.get_json_object(body, "$.summary"), SUMMARY_SCHEMA)
    names = SUMMARY_SCHEMA.replace(" string", "").split(", ")
    text = F.get_json_object(body, "$.summary")
    is_object = F.coalesce(text, F.lit("")).rlike(r"(?s)^\s*\{")
    rows = replies.select(*kept, *[F.when(is_object, _trimmed(s[n])).otherwise(_trimmed(text) if n == "overall_evaluation" else F.lit("")).alias(n) for n in names])
    empty = F.lit(True)
    for n in names:
        empty = empty & (F.col(n) == "")
    return rows.withColumn("is_empty", empty)


def parse_pipe_issues(replies: DataFrame) -> DataFrame:
    """Lines ISSUE|severity|title|details|recommendation|document; a row PARSE-001 for replies without any."""
    kept = [c for c in replies.columns if c != "reply"]
    lines = replies.select(*kept, "reply", F.posexplode(F.split(F.coalesce("reply", F.lit("")), r"\r\n|\r|\n", -1)).alias("item_ord", "line")).filter(F.col("line").startswith("ISSUE|"))
    p = F.transform(F.split("line", r"\|", 6), lambda x: F.trim(x))
    rows = lines.withColumn("p", p).filter(F.size("p") == 6)
    rows = rows.filter(valid_severity(F.col("p")[1]) & ~placeholder_echo(F.col("p")[2], F.col("p")[3], F.col("p")[4]))
    or_else = lambda i, v: F.coalesce(F.nullif(F.col("p")[i], F.lit("")), v)
    rows = rows.select(*kept, "item_ord", F.lower(F.col("p")[1]).alias("severity"), or_else(2, F.lit("Review issue")).alias("title"), or_else(3, F.substring("reply", 1, 200)).alias("details"), or_else(4, F.lit("Please confirm the intended configuration.")).alias("recommendation"), or_else(5, F.coalesce("doc", F.lit("-"))).alias("source_document"), F.lit(None).cast("string").alias("issue_id"))
    bare = replies.join(rows.select("review_id", "doc").distinct().hint("merge"), ["review_id", "doc"], "left_anti")
    told = bare.select(*kept, F.lit(0).alias("item_ord"), F.lit("info").alias("severity"), F.lit(UNPARSED).alias("title"), F.coalesce(F.nullif(F.substring("reply", 1, 500), F.lit("")), F.lit("No review text was returned.")).alias("details"), F.lit("").alias("recommendation"), F.coalesce("doc", F.lit("-")).alias("source_document"), F.lit("PARSE-001").alias("issue_id"))
    return rows.unionByName(told)


def parse_checklist(replies: DataFrame) -> DataFrame:
    """S18."""
    rows = _items(replies, "checklist_results", "item_id string, item_name string, source_document string, status string, reason string, evidence string")
    return rows.withColumn("status", F.lower(_trimmed(F.col("status")))).filter((_trimmed(F.col("item_id")) != "") & F.col("status").isin(*STATUSES))


def parse_missing_chapters(replies: DataFrame) -> DataFrame:
    """S19."""
    rows = _items(replies, "missing_chapters", "chapter_id string, verdict string, justification string, suggested_content string")
    return rows.withColumn("verdict", F.lower(_trimmed(F.col("verdict")))).filter((_trimmed(F.col("chapter_id")) != "") & F.col("verdict").isin(*VERDICTS))


def parse_chapter_overviews(replies: DataFrame) -> DataFrame:
    """Flags are true for a few words in any case."""
    rows = _items(replies, "chapter_overviews", "source_document string, chapter_id string, chapter_label string, summary string, review string, needs_deep_dive string")
    return rows.withColumn("needs_deep_dive", F.lower(_trimmed(F.col("needs_deep_dive"))).isin(*TRUE_WORDS))


def with_standard_names(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Names of standard items or chapters; the dimension is a fixed table of under 100 rows."""
    return rows.join(F.broadcast(dim), key, "left")


def parse_masker_response(replies: DataFrame) -> DataFrame:
    """sanitized_text, findings, outbound_risk; what isn't JSON is the text itself, with medium risk."""
    body = json_object(F.col("reply"))
    p = F.from_json(body, "sanitized_text string, findings array<string>, outbound_risk string")
    one = F.from_json(body, "findings string")["findings"]
    good = F.coalesce(F.try_parse_json(body).isNotNull() & p["sanitized_text"].isNotNull(), F.lit(False))
    level = F.lower(_trimmed(p["outbound_risk"]))
    kept = [c for c in replies.columns if c != "reply"]
    return replies.select(
        *kept, F.when(good, p["sanitized_text"]).otherwise(F.trim("reply")).alias("sanitized_text"),
        F.when(good, F.coalesce(p["findings"], F.when(F.trim(one) != "", F.array(one)), F.array().cast("array<string>"))).otherwise(F.array(F.lit("Local model reply was not JSON."))).alias("findings"),
        F.when(good & level.isin("low", "medium", "high"), level).otherwise("medium").alias("outbound_risk"),
    )


def parse_gate_response(replies: DataFrame) -> DataFrame:
    """Decision, reasons, actions; what isn't a known decision is mask_and_continue."""
    body = json_object(F.col("reply"))
    p = F.from_json(body, "decision string, reasons array<string>, recommended_actions array<string>")
    one = F.from_json(body, "reasons string, recommended_actions string")
    decision = F.lower(_trimmed(p["decision"]))
    many = lambda f: F.coalesce(p[f], F.when(F.trim(one[f]) != "", F.array(one[f])), F.array().cast("array<string>"))
    return replies.select(*[c for c in replies.columns if c != "reply"], F.when(decision.isin("safe", "mask_and_continue", "block"), decision).otherwise("mask_and_continue").alias("decision"), many("reasons").alias("reasons"), many("recommended_actions").alias("actions"))


def merge_masker_output(documents: DataFrame, replies: DataFrame) -> DataFrame:
    """P17. documents: as mask_documents makes them; replies: review_id, doc_ord and what parse_masker_response gives.

    The reply is masked again, odd placeholders are told, findings and risks are merged; without a reply (or an empty one) the rules' text stays.
    """
    again = masked_text(replies.select("review_id", "doc_ord", normalise_placeholders(F.col("sanitized_text")).alias("text"), F.col("findings").alias("_f"), F.col("outbound_risk").alias("_r")))
    again = again.select("review_id", "doc_ord", F.col("masked").alias("_t"), "_f", "_r", unapproved_placeholders(F.col("masked")).alias("_odd"))
    rows = documents.join(again.hint("merge"), ["review_id", "doc_ord"], "left")
    used = F.coalesce(F.trim("_t"), F.lit("")) != ""
    odd = F.when(F.size("_odd") > 0, F.array(F.concat(F.lit("Unapproved placeholders: "), F.array_join("_odd", ", ")))).otherwise(F.array().cast("array<string>"))
    text = F.when(used, F.col("_t")).otherwise(F.col("outbound_text"))
    return rows.withColumns({
        "findings": F.when(used, unique_findings(F.col("findings"), F.col("_f"), odd)).otherwise(F.col("findings")), "outbound_risk": F.when(used, max_risk(F.col("outbound_risk"), F.col("_r"))).otherwise(F.col("outbound_risk")),
        "outbound_text": text, "sanitized_excerpt": F.substring(text, 1, PREVIEW_CHARS), "estimated_input_tokens": estimate_tokens(text),
    }).drop("_t", "_f", "_r", "_odd")


def actionable(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("severity").isin("high", "medium", "low"))


def against_facts(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Drops claims that the texts refute: syntax errors, missing source, marks of masking, "undefined" functions that are defined."""
    facts = docs.select("review_id", F.col("name").alias("source_document"), defined_functions(F.coalesce("text", F.lit(""))).alias("_functions"), (F.length(F.trim("text")) > 0).alias("_has_text"), code_language(F.col("name"), F.col("text")).alias("_language"))
    facts = facts.dropDuplicates(["review_id", "source_document"])
    rows = issues.join(facts.hint("merge"), ["review_id", "source_document"], "left")
    said = F.lower(F.concat_ws("\n", "title", "details", "recommendation"))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    known = F.exists(F.coalesce("_functions", F.array().cast("array<string>")), lambda f: F.contains(said, F.lower(f)))
    refuted = says(SYNTAX_CLAIMS) | (says(MISSING_SOURCE_CLAIMS) & F.coalesce("_has_text", F.lit(False))) | says(ARTEFACT_CLAIMS) | (says(UNDEFINED_CLAIMS) & known)
    return rows.filter(~refuted).drop("_functions", "_has_text", "_language")


def merge_static(static: DataFrame, model: DataFrame) -> DataFrame:
    """U4: rule findings first; a set whose model found nothing to act on has only these. Equal issues count once."""
    useful = actionable(model).select("review_id").distinct()
    alone = static.select("review_id").distinct().join(useful.hint("merge"), "review_id", "left_anti")
    kept = model.join(alone.hint("merge"), "review_id", "left_anti")
    both = static.withColumn("_s", F.lit(0)).unionByName(kept.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("review_id", "source_document", "title", F.coalesce(F.nullif("current_state", F.lit("")), F.col("details"))).orderBy("_s", "item_ord"))
    return both.withColumn("_k", rank).filter("_k = 1").drop("_k", "_s")


def with_origins(**parts: DataFrame) -> DataFrame:
    """Issues of several passes, tagged."""
    out = None
    for origin, rows in parts.items():
        tagged = rows.withColumn("origin", F.lit(origin))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def combine_reviews(parsed: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P21. replies: review_id, doc, doc_ord, failed. (issues with ids assigned after merging, one row per set with its failures and status)."""
    issues = parsed.join(replies.filter(~F.col("failed")).select("review_id", "doc", "doc_ord").hint("merge"), ["review_id", "doc"])
    if "document_profile" not in issues.columns:
        issues = issues.withColumn("document_profile", F.lit(None).cast("string"))
    issues = assign_issue_ids(issues, ("doc_ord", "item_ord"))
    sets = replies.groupBy("review_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if("failed").alias("failed"))
    return issues, sets.withColumn("status", F.when(F.col("failed") == F.col("documents"), "error").when(F.col("failed") > 0, "partial").otherwise("complete"))


def chapter_overviews(docs: DataFrame, parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """An overview of each chapter, the reviewer's or an excerpt, with the structure findings on it; findings ask for a deep dive."""
    rows = extract_chapters(docs.select("review_id", "doc_ord", "name", "text"), whole=True).select("review_id", "doc_ord", F.col("name").alias("source_document"), "chapter_ord", "chapter_id", "chapter_label", excerpt(F.col("body")).alias("_x"))
    given = parsed.groupBy("review_id", "source_document", "chapter_id").agg(F.first("summary").alias("summary"), F.first("review").alias("review"), F.bool_or("needs_deep_dive").alias("needs_deep_dive"))
    rows = rows.join(given.hint("merge"), ["review_id", "source_document", "chapter_id"], "left")
    # chapter and (no source or the same source): two equi joins
    own = findings.filter(F.coalesce("source_document", F.lit("")) != "").groupBy("review_id", "chapter_id", "source_document").agg(F.count(F.lit(1)).alias("n_own"))
    wide = findings.filter(F.coalesce("source_document", F.lit("")) == "").groupBy("review_id", "chapter_id").agg(F.count(F.lit(1)).alias("n_wide"))
    rows = rows.join(own.hint("merge"), ["review_id", "chapter_id", "source_document"], "left").join(wide.hint("merge"), ["review_id", "chapter_id"], "left")
    n = F.coalesce("n_own", F.lit(0)) + F.coalesce("n_wide", F.lit(0))
    return rows.select("review_id", "doc_ord", "source_document", "chapter_ord", "chapter_id", "chapter_label", F.coalesce(F.nullif("summary", F.lit("")), "_x").alias("summary"), F.coalesce("review", F.lit("")).alias("review"), n.alias("n_findings"), (F.coalesce("needs_deep_dive", F.lit(False)) | (n > 0)).alias("needs_deep_dive"))


def deep_dive_candidates(overviews: DataFrame) -> DataFrame:
    """Chapters to look at again and why."""
    why = F.when(F.col("n_findings") > 0, F.concat(F.col("n_findings").cast("string"), F.lit(" findings"))).when(F.col("review") != "", F.col("review")).otherwise("reviewer asks")
    return overviews.filter("needs_deep_dive").withColumn("reason", why)


def issues_of_chapter(issues: DataFrame, chapters: DataFrame) -> DataFrame:
    """Issues that name a chapter of their document, by id, label or number."""
    said = F.concat_ws("\n", "section", "title", "details")
    names = chapters.select(F.col("review_id").alias("_r"), F.col("name").alias("_d"), "chapter_id", "chapter_label", "number")
    test = (F.col("review_id") == F.col("_r")) & (F.col("source_document") == F.col("_d")) & (F.contains(said, F.col("chapter_label")) | F.contains(said, F.concat(F.lit("第 "), F.col("number").cast("string"), F.lit(" 章"))) | F.contains(said, F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("章"))))
    return issues.join(names.hint("merge"), test, "left_semi")


def best_chapter(issues: DataFrame, chapters: DataFrame, least: int = 2) -> DataFrame:
    """Issue to chapter of its document: the named section, the number in it, else most words in common (two at least)."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_-]{2,}|[一-龥ァ-ヶー]{2,}"), F.lit(0)))
    keyed = issues.withColumn("_n", F.nullif(F.regexp_extract(F.coalesce("section", F.lit("")), r"第\s*(\d{1,2})\s*章", 1), F.lit("")).cast("int"))
    own = chapters.select("review_id", F.col("name").alias("source_document"), "chapter_ord", "chapter_id", "chapter_label", "number", words(F.col("body")).alias("_w"))
    both = keyed.select("review_id", "source_document", "issue_id", "section", "_n", words(F.concat_ws("\n", "title", "details", "issue")).alias("_i")).join(own.hint("merge"), ["review_id", "source_document"])
    rank = F.when(F.coalesce("section", F.lit("")) == F.col("chapter_label"), 1000).when(F.col("_n") == F.col("number"), 900).otherwise(F.size(F.array_intersect("_i", "_w")))
    return both.withColumn("_s", rank).filter(F.col("_s") >= least).groupBy("review_id", "issue_id").agg(F.max_by(F.struct("chapter_id", "chapter_label"), F.struct("_s", -F.col("chapter_ord"))).alias("c")).select("review_id", "issue_id", "c.*")


def by_importance(issues: DataFrame) -> DataFrame:
    """T2."""
    return issues.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "source_document", "section", "issue_id", "title")


def issues_per_document(issues: DataFrame) -> DataFrame:
    """A16."""
    return issues.groupBy("review_id", "source_document").agg(F.count(F.lit(1)).alias("n"))


def local_summary(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Purpose, outline of at most five documents, and an overall comment from severity counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # ranked first: the texts of all but five documents are not looked at
    first = docs.select("review_id", "doc_ord", "name", "text").withColumn("_k", F.row_number().over(Window.partitionBy("review_id").orderBy("doc_ord"))).filter("_k <= 5")
    inline = F.regexp_extract(text, r"(?mU)^\s*(?:#+\s*)?(?:[\d.]+\s*)?(?:本書の)?目的\s*[:：]\s*(\S[^\n]*)$", 1)
    block = F.regexp_extract(text, r"(?mU)^\s*(?:#+\s*)?(?:[\d.]+\s*)?(?:本書の)?目的\s*$\n+((?:[^\n]+\n?){1,3})", 1)
    stated = F.regexp_extract(text, r"(本(?:書|資料|手順書)は[^。\n]*。?)", 1)
    purpose = F.coalesce(F.nullif(F.trim(inline), F.lit("")), F.nullif(excerpt(block, 180), F.lit("")), F.nullif(stated, F.lit("")), excerpt(text, 180))
    rows = extract_chapters(first.select("review_id", "_k", "name", purpose.alias("purpose"), excerpt(text, 120).alias("_x"), "text"), whole=True).filter("chapter_ord < 5")
    label = F.when(F.col("chapter_id") != "whole", F.struct("chapter_ord", "chapter_label"))
    rows = rows.groupBy("review_id", "_k").agg(*[F.first(c).alias(c) for c in ("name", "purpose", "_x")], F.collect_list(label).alias("labels"))
    rows = rows.withColumn("labels", F.when(F.size("labels") > 0, F.array_join(F.transform(F.array_sort("labels"), lambda x: x["chapter_label"]), " / ")))
    sets = rows.groupBy("review_id").agg(F.min_by("purpose", "_k").alias("purpose"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat("name", F.lit(": "), F.coalesce("labels", "_x")).alias("line")))), lambda x: x["line"]), "\n").alias("content_outline"))
    counts = issues.groupBy("review_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    comment = F.substring(F.concat(F.lit("high "), F.coalesce("high", F.lit(0)).cast("string"), F.lit(", medium "), F.coalesce("medium", F.lit(0)).cast("string"), F.lit(", low "), F.coalesce("low", F.lit(0)).cast("string")), 1, 260)
    return sets.join(counts.hint("merge"), "review_id", "left").select("review_id", "purpose", "content_outline", comment.alias("overall_evaluation"))


def payload_parts(documents: DataFrame, findings: DataFrame, caps: int = 20) -> DataFrame:
    """What a set's payload is made of, in order: review_id, part, text. Every document is a part, with a header of k of N (W8), its masked text and its chapters;
    the last part lists at most ``caps`` findings and how many more. No row holds more than one document."""
    rows = ranked(documents.select("review_id", "doc_ord", "name", "outbound_text"), ["review_id"], ["doc_ord", "name"], "part")
    total = documents.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    chapters = extract_chapters(documents.select("review_id", "doc_ord", F.col("outbound_text").alias("text"))).groupBy("review_id", "doc_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_ord", "chapter_label"))), lambda x: x["chapter_label"]), "\n").alias("chapters"))
    rows = rows.join(total.hint("merge"), "review_id").join(chapters.hint("merge"), ["review_id", "doc_ord"], "left")
    bodies = rows.select("review_id", "part", F.concat_ws("\n", F.format_string("文書 %d/%d: %s", "part", "n", "name"), "outbound_text", "chapters").alias("text"))
    # Spark cuts each task's rows of a set to the first ``caps`` before they meet
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "kind", "chapter_id", "item_id"))
    listed = findings.withColumn("k", rank).filter(F.col("k") <= caps).groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "severity", "kind", "chapter_name", "item_name").alias("t")))), lambda x: x["t"]), "\n").alias("findings"))
    more = findings.groupBy("review_id").agg(F.greatest(F.count(F.lit(1)) - caps, F.lit(0)).alias("more"))
    last = total.join(listed.hint("merge"), "review_id").join(more.hint("merge"), "review_id")
    return bodies.unionAll(last.select("review_id", F.col("n") + 1, F.concat_ws("\n\n", "findings", F.when(F.col("more") > 0, F.concat(F.lit("n more: "), F.col("more").cast("string"))))))


def review_payload(documents: DataFrame, findings: DataFrame, caps: int = 20) -> DataFrame:
    """The parts of each set as one text, for a set that one call of a reviewer can take; ``payload_parts`` has no such bound."""
    parts = payload_parts(documents, findings, caps)
    return parts.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n\n").alias("payload"))
