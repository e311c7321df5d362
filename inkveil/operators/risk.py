"""Risks of texts for their readers: vague expressions, reader personas, premortem scenarios."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import abbreviations, cjk_runs, contains_any_bounded, context, folded, has_bounded, is_cjk
from inkveil.operators.structure import extract_chapters
from inkveil.sources.scratch import materialised

# Expressions, the evidence that each needs (label: words), scenarios and personas.
AMBIGUOUS = {
    "必要に応じて": {"判断条件": ("条件", "基準", "閾値", "しきい値"), "判断者": ("判断者", "責任者", "承認者", "担当"), "期限・タイミング": ("期限", "タイミング", "何分", "何時間", "までに")},
    "適宜": {"判断条件": ("条件", "基準", "閾値", "しきい値"), "実施者": ("担当", "責任者", "実施者"), "実施タイミング": ("タイミング", "時点", "毎", "都度")},
    "原則": {"例外条件": ("例外", "ただし", "除く", "対象外"), "承認条件": ("承認", "判断", "責任者")},
    "可能な限り": {"目標値": ("目標", "KPI", "SLA", "%", "以内"), "下限条件": ("最低", "下限", "必須", "閾値", "しきい値")},
    "片寄せ": {"方式": ("Active-Standby", "Active-Active", "待機系", "現用系"), "切替条件": ("切替", "フェイルオーバー", "条件", "障害"), "戻し方": ("切戻", "切り戻", "復旧", "戻し")},
    "冗長化": {"冗長構成": ("台数", "AZ", "ゾーン", "系", "構成"), "障害時動作": ("障害", "切替", "フェイルオーバー", "SPOF"), "検証方法": ("試験", "確認", "訓練", "検証")},
    "常時稼働": {"稼働時間": ("24時間", "365日", "稼働時間", "SLA"), "例外停止": ("メンテナンス", "停止", "例外", "保守")},
}
SCENARIOS = {
    "PM-001": ("将来、DR切替時に復旧目標を満たせない", ("DR", "災害", "復旧", "バックアップ", "RTO", "RPO", "切替"), {"RTO/RPO": ("RTO", "RPO", "復旧目標", "目標復旧"), "切替手順": ("切替手順", "切り替え手順", "切戻", "切り戻"), "訓練": ("訓練", "演習", "DRテスト", "復旧試験")}, ("RTO/RPO",)),
    "PM-002": ("将来、アラート発報後に一次対応者が判断できない", ("監視", "アラート", "障害", "運用"), {"一次対応": ("一次対応", "初動", "対応者"), "エスカレーション": ("エスカレーション", "連絡", "通知先"), "判断基準": ("判断基準", "閾値", "条件")}, ("一次対応", "判断基準")),
    "PM-003": ("将来、認証基盤障害で業務ログインが停止する", ("認証", "SAML", "OIDC", "MFA", "Active Directory", "AD"), {"代替経路": ("代替", "迂回", "非常時", "緊急"), "冗長/切替": ("冗長", "切替", "フェイルオーバー", "待機系"), "監視": ("監視", "ヘルスチェック", "アラート")}, ()),
    "PM-004": ("将来、通信経路の例外設定が増えセキュリティ境界が曖昧になる", ("VPN", "Firewall", "ファイアウォール", "セキュリティ", "通信", "ネットワーク"), {"通信許可方針": ("許可", "拒否", "最小権限", "ポリシー"), "暗号化": ("暗号", "TLS", "IPsec"), "証跡": ("ログ", "監査", "証跡")}, ()),
}
OPERATIONS = ("障害", "復旧", "切戻", "切り戻", "監視", "アラート", "運用")
PERSONAS = {
    "二次運用者": {"判断基準": ("判断基準", "条件", "閾値", "しきい値"), "責任者": ("責任者", "担当", "一次対応", "運用者"), "連絡/エスカレーション": ("連絡", "通知", "エスカレーション")},
    "監査人": {"承認": ("承認", "承認者", "決裁"), "証跡": ("証跡", "ログ", "監査"), "変更履歴": ("改訂履歴", "変更履歴", "版番号")},
    "上長・承認者": {"目的": ("目的", "背景", "狙い"), "意思決定材料": ("判断", "選定理由", "代替案", "リスク"), "効果/コスト": ("効果", "費用", "コスト", "KPI")},
}
WHOLE_SET, WHOLE_DOC, RELATED = "レビュー対象全体", "文書全体", "関連章"
# End of the fixed values.
AMBIGUOUS_CAP, SCENARIO_CAP, HINTS, MANY_ABBREVIATIONS, SOME_ABBREVIATIONS = 12, 4, 2, 16, 8


def missing_labels(folded_text: Column, needed: dict[str, Sequence[str]]) -> Column:
    """The labels none of whose words a text has; the text as ``folded`` makes it."""
    return F.filter(F.array(*[F.when(~contains_any_bounded(folded_text, words), label) for label, words in needed.items()]), lambda x: x.isNotNull())


def _having(found: Column, tests: dict[str, Sequence[str]]) -> Column:
    """Names of the tests of which a word is among those found."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(F.array(*map(F.lit, words)), found), k) for k, words in tests.items()]), lambda x: x.isNotNull())


def _by_script(words: Iterable[str]) -> tuple[list[str], list[str]]:
    """Different words of ideographs and kana alone, which are searched as they are, and others."""
    each = list(dict.fromkeys(words))
    return [w for w in each if is_cjk(w)], [w for w in each if not is_cjk(w)]


def _plain(text: Column, words: Column) -> Column:
    """The words of ideographs and kana that a text has; the text as it is or as ``cjk_runs`` makes it."""
    return F.filter(words, lambda w: F.contains(text, w))


def _edged(folded_text: Column, words: Sequence[str], among: Column | None = None) -> Column:
    """The other words that a text has, the text as ``folded`` makes it; if given, only those ``among`` the words of a longer text are looked for."""
    has = lambda w: has_bounded(folded_text, w) if among is None else F.array_contains(among, w) & has_bounded(folded_text, w)
    return F.filter(F.array(*[F.when(has(w), w) for w in words]), lambda x: x.isNotNull())


def ambiguous_expressions(docs: DataFrame, cap: int = AMBIGUOUS_CAP) -> DataFrame:
    """P10. docs: review_id, doc_ord, name, text. Of each document and expression the first chapter that lacks evidence (W13), numbered."""
    rows = extract_chapters(docs.select("review_id", "doc_ord", "name", "text"), whole=True).withColumn("_x", folded(F.col("body")))
    body = F.col("body")
    found = []
    for i, (expression, needed) in enumerate(AMBIGUOUS.items()):
        found.append(F.when(F.contains(body, F.lit(expression)), F.struct(F.lit(i).alias("rule_ord"), F.lit(expression).alias("expression"), missing_labels(F.col("_x"), needed).alias("missing_elements"), context(body, F.lit(expression), 58, "...").alias("context"))))
    rows = rows.select("review_id", "doc_ord", "name", "chapter_ord", "chapter_label", F.explode_outer(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).filter(F.size("r.missing_elements") > 0)
    first = F.row_number().over(Window.partitionBy("review_id", "doc_ord", "r.rule_ord").orderBy("chapter_ord"))
    rows = rows.withColumn("k", first).filter("k = 1").select("review_id", "doc_ord", "name", F.col("chapter_label").alias("section"), "r.*")
    n = F.row_number().over(Window.partitionBy("review_id").orderBy("doc_ord", "rule_ord"))
    rows = rows.withColumn("n", n).filter(F.col("n") <= cap)
    return rows.select("review_id", F.format_string("AF-%03d", "n").alias("finding_id"), "expression", F.col("name").alias("source_document"), "section", "context", "missing_elements", F.when(F.size("missing_elements") >= 2, "medium").otherwise("low").alias("severity"))


def _tests() -> dict[str, Sequence[str]]:
    """What sets are asked for: labels of personas and scenarios, triggers of scenarios, and operations; with their words."""
    tests: dict[str, Sequence[str]] = {f"p|{p}|{label}": words for p, needed in PERSONAS.items() for label, words in needed.items()}
    tests |= _scenario_tests()
    return tests | {"operations": OPERATIONS}


def _scenario_tests() -> dict[str, Sequence[str]]:
    tests: dict[str, Sequence[str]] = {f"s|{s}|{label}": words for s, (_, _, needed, _) in SCENARIOS.items() for label, words in needed.items()}
    return tests | {f"t|{s}": words for s, (_, words, _, _) in SCENARIOS.items()}


def _gathered(rows: DataFrame) -> DataFrame:
    """One row per set of rows per document: source, and the names of the tests that its documents pass."""
    return rows.groupBy("review_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("name")).otherwise(WHOLE_SET).alias("source"), F.array_distinct(F.flatten(F.collect_list("have"))).alias("have"))


def _set_flags(docs: DataFrame) -> DataFrame:
    """One row per set: source, all labels and words that its documents have, and its abbreviations."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = _tests()
    plain, edged = _by_script(w for words in tests.values() for w in words)
    rows = docs.select("review_id", "name", folded(text).alias("_x"), cjk_runs(text).alias("_j"), abbreviations(text).alias("abbr"))
    rows = rows.select("review_id", "name", "abbr", F.concat(_plain(F.col("_j"), F.array(*map(F.lit, plain))), _edged(F.col("_x"), edged)).alias("_w")).select("review_id", "name", _having(F.col("_w"), tests).alias("have"), "abbr")
    rows = materialised(rows)
    short = rows.select("review_id", F.explode("abbr").alias("a")).distinct().groupBy("review_id").agg(F.array_sort(F.collect_list("a")).alias("abbr"))
    return _gathered(rows).join(short.hint("merge"), "review_id", "left").withColumn("abbr", F.coalesce("abbr", F.array().cast("array<string>")))


def _missing(prefix: str, labels: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.when(~F.array_contains("have", f"{prefix}|{label}"), label) for label in labels]), lambda x: x.isNotNull())


def reader_risks(docs: DataFrame) -> DataFrame:
    """Four personas per set, with level and signals. A14: abbreviations count once per set."""
    sets = _set_flags(docs)
    n = F.size("abbr")
    out = [F.struct(F.lit(0).alias("persona_ord"), F.lit("初任SE").alias("persona"), F.when(n >= MANY_ABBREVIATIONS, "high").when(n >= SOME_ABBREVIATIONS, "medium").otherwise("low").alias("risk_level"), F.slice("abbr", 1, 8).alias("signals"), n.alias("n_signals"))]
    for i, (persona, needed) in enumerate(PERSONAS.items()):
        gone = _missing(f"p|{persona}", list(needed))
        if persona == "二次運用者":
            active = F.array_contains("have", "operations")
            level = F.when(active & (F.size(gone) >= 2), "high").when(active & (F.size(gone) > 0), "medium").otherwise("low")
        else:
            level = F.when(F.size(gone) >= 3, "high").when(F.size(gone) > 0, "medium").otherwise("low")
        out.append(F.struct(F.lit(i + 1).alias("persona_ord"), F.lit(persona).alias("persona"), level.alias("risk_level"), gone.alias("signals"), F.size(gone).alias("n_signals")))
    return sets.select("review_id", "source", F.explode(F.array(*out)).alias("r")).select("review_id", F.col("source").alias("source_document"), "r.*")


def issue_text(issues: DataFrame) -> Column:
    columns = [c for c in ("title", "details", "current_state", "issue", "impact", "recommendation") if c in issues.columns]
    return F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in columns])


def premortem(docs: DataFrame, issues: DataFrame, cap: int = SCENARIO_CAP) -> DataFrame:
    """P12. issues: review_id, issue_ord, severity, title, details, ... (may be empty). Scenarios that texts or issues trigger and whose evidence is incomplete.

    One pass over the documents: a text is searched once, and its chapters only for the words that it has.
    """
    tests = _scenario_tests()
    plain, edged = _by_script(w for words in tests.values() for w in words)
    per_doc = docs.select("review_id", "doc_ord", "name", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"_x": folded(F.col("text")), "_j": cjk_runs(F.col("text"))})
    per_doc = per_doc.select("review_id", "doc_ord", "name", "text", _plain(F.col("_j"), F.array(*map(F.lit, plain))).alias("_p"), _edged(F.col("_x"), edged).alias("_e"))
    found = extract_chapters(per_doc, whole=True).withColumn("_x", F.when(F.size("_e") > 0, folded(F.col("body"))))
    found = found.select("review_id", "doc_ord", "name", "chapter_ord", "chapter_label", F.concat("_p", "_e").alias("_w"), F.concat(_plain(F.col("body"), F.col("_p")), _edged(F.col("_x"), edged, F.col("_e"))).alias("_c"))
    score = lambda listed: F.size(F.filter(F.array(*map(F.lit, listed)), lambda w: F.array_contains("_c", w)))  # noqa: E731  a word that is listed twice counts twice
    scores = F.array(*[F.struct(F.lit(s).alias("scenario_id"), score([*words, *(x for group in needed.values() for x in group)]).alias("score")) for s, (_, words, needed, _) in SCENARIOS.items()])
    # what a document has is told beside its first chapter
    found = materialised(found.select("review_id", "doc_ord", "name", "chapter_ord", "chapter_label", F.when(F.col("chapter_ord") == 0, _having(F.col("_w"), tests)).alias("have"), scores.alias("scores")))
    sets = _gathered(found.filter("chapter_ord = 0"))
    told = issues.select("review_id", "issue_ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_document", F.lit("")).alias("source_document"), F.coalesce("section", F.lit("")).alias("section"), issue_text(issues).alias("_t")).withColumn("_x", folded(F.col("_t")))
    hits = told.select("review_id", "issue_ord", "title", "source_document", "section", F.filter(F.array(*[F.when(contains_any_bounded(F.col("_x"), words), s) for s, (_, words, _, _) in SCENARIOS.items()]), lambda x: x.isNotNull()).alias("s"))
    # an outer explode: for an inner one Spark filters by the words before, and makes the text for each of them
    by_scenario = hits.select("review_id", "issue_ord", "title", "source_document", "section", F.explode_outer("s").alias("scenario_id")).filter(F.col("scenario_id").isNotNull())
    ranked = by_scenario.withColumn("k", F.row_number().over(Window.partitionBy("review_id", "scenario_id").orderBy("issue_ord"))).filter(F.col("k") <= HINTS)
    hints = ranked.groupBy("review_id", "scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]).alias("review_hint"), F.min_by("source_document", "k").alias("hint_document"), F.min_by("section", "k").alias("hint_section"))
    # The chapter with most words of a scenario, the first one in a tie
    scored = found.select("review_id", "doc_ord", "chapter_ord", "name", "chapter_label", F.explode("scores").alias("r")).filter("r.score > 0")
    best = scored.groupBy("review_id", F.col("r.scenario_id").alias("scenario_id")).agg(F.max_by(F.struct("name", "chapter_label"), F.struct(F.col("r.score"), -F.col("doc_ord"), -F.col("chapter_ord"))).alias("best"))
    rows = []
    for i, (s, (title, _, needed, high)) in enumerate(SCENARIOS.items()):
        gone = _missing(f"s|{s}", list(needed))
        level = F.when((F.size(F.array_intersect(gone, F.array(*map(F.lit, high)))) > 0) if high else F.lit(False), "high").when(F.size(gone) >= 2, "high").otherwise("medium")
        rows.append(F.struct(F.lit(i).alias("o"), F.lit(s).alias("scenario_id"), F.lit(title).alias("title"), F.array_contains("have", f"t|{s}").alias("by_document"), gone.alias("missing_elements"), F.array_except(F.array(*map(F.lit, needed)), gone).alias("confirmed_elements"), level.alias("risk_level")))
    out = sets.select("review_id", F.explode(F.array(*rows)).alias("r")).select("review_id", "r.*").filter(F.size("missing_elements") > 0)
    out = out.join(hints.hint("merge"), ["review_id", "scenario_id"], "left").join(best.hint("merge"), ["review_id", "scenario_id"], "left")
    by_issue = F.col("review_hint").isNotNull()
    out = out.filter(F.col("by_document") | by_issue)
    source = F.when(F.col("by_document") & F.col("best").isNotNull(), F.col("best.name")).otherwise(F.coalesce(F.nullif("hint_document", F.lit("")), F.lit(WHOLE_SET)))
    section = F.when(F.col("by_document") & F.col("best").isNotNull(), F.col("best.chapter_label")).otherwise(F.coalesce(F.nullif("hint_section", F.lit("")), F.when(by_issue, RELATED), F.lit(WHOLE_DOC)))
    trigger = F.when(F.col("by_document") & by_issue, "both").when(F.col("by_document"), "document").otherwise("issue")
    k = F.row_number().over(Window.partitionBy("review_id").orderBy("o"))
    return out.withColumn("k", k).filter(F.col("k") <= cap).select("review_id", "scenario_id", "title", "risk_level", source.alias("source_document"), section.alias("section"), trigger.alias("trigger_source"), "confirmed_elements", "missing_elements", F.coalesce("review_hint", F.array().cast("array<string>")).alias("review_hint"))
