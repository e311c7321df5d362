"""The release gate: per document safe, mask_and_continue or block; per set a status, warnings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detectors import IDENTIFYING
from inkveil.functions.text import folded, has_any
from inkveil.operators.masking import RISKS, mask_documents

DOC_TOKENS, SET_TOKENS, JUDGED_CHARS = 3000, 8000, 8000
# Cues and wording of the gate.
MARKER = r"(?iu)(社外秘|部外秘|機密|極秘|取扱注意|社内限定|関係者限り|confidential|strictly confidential|internal use only|proprietary)"
CUSTOMER = r"(?iu)(顧客名|お客様名|会社名|企業名|案件名|プロジェクト名|システム名|担当者|連絡先|契約番号|回線番号|変更番号|ticket|incident)"
TOPOLOGY = r"(?iu)(拠点名|データセンタ|dc|network diagram|topology|構成図|接続図|system architecture|site name|rack|core sw|firewall cluster)"
REASONS = {
    "marker": ("ローカル原文中に明示的な機密性マーカー (社外秘・confidential 等) が検出されました。", "外部送信前に、機密性ラベルが付与された箇所を削除または一般化してください。"),
    "identifier": ("顧客・案件・チケット・担当者の識別子がローカルで検出されました。", "顧客名・案件名等の識別子周辺の文脈が、マスク処理で完全に除去されているか確認してください。"),
    "label": ("業務識別子または所有者ラベル (顧客名・案件名・担当者など) がローカル原文中に検出されました。", "組織や案件を特定し得るラベルおよびその周辺文脈をマスク処理してください。"),
    "topology": ("匿名化後もトポロジ・環境固有の文脈が残存している可能性があります。", "拠点名・トポロジ詳細・環境固有の表現を一般化してください。"),
    "credential": ("認証情報を示唆する語 (password, token, secret 等) がローカル原文中に検出されました。", "認証情報や秘密情報がすべてマスクされているか確認してください。"),
    "risk": ("匿名化処理が、本文書を高い外部送信リスクと判定しています。", "外部送信前に、より厳密に匿名化したコピーを準備してください。"),
    "safe": ("ローカル機密度判定で、強い機密性ブロッカーは検出されませんでした。", "匿名化済みテキストのみで処理を続行してください。"),
}
LABELS = {"safe": "送信可", "mask_and_continue": "要確認", "block": "送信禁止"}
# End of the fixed values.


def _words(pattern: str) -> list[str]:
    """The words of a pattern that is a list of them; (?iu) finds them where ``folded`` texts have them."""
    return pattern.removeprefix("(?iu)(").removesuffix(")").split("|")


def assess_sensitivity(documents: DataFrame) -> DataFrame:
    """P2. documents: as mask_documents makes them. Adds decision, reasons and actions.

    Identifiers count in all replacements, not in the first hundred.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.col("_low")
    identifiers = F.exists("replacements", lambda r: r["category"].isin(*IDENTIFYING))
    high = F.col("outbound_risk") == "high"
    # each runs once whatever asks for it
    plain = F.col("_plain")
    words = F.contains(plain, F.lit("password")) | F.contains(plain, F.lit("token")) | F.contains(plain, F.lit("secret"))
    flags = {"_marker": has_any(low, _words(MARKER)), "_label": has_any(low, _words(CUSTOMER)) & ~identifiers, "_topology": (F.col("outbound_risk") != "low") & has_any(low, _words(TOPOLOGY)), "_credential": words}
    documents, kept, marker = documents.withColumns({"_low": folded(text), "_plain": F.lower(text)}).withColumns(flags), documents.columns, F.col("_marker")
    tests = {
        "identifier": identifiers,
        "label": F.col("_label"),
        "topology": F.col("_topology"),
        "credential": F.col("_credential"),
        "risk": high,
    }

    def told(which: int) -> Column:
        found = F.filter(F.array(*[F.when(test, REASONS[k][which]) for k, test in tests.items()]), lambda x: x.isNotNull())
        return F.when(marker, F.array(F.lit(REASONS["marker"][which]))).when(F.size(found) > 0, found).otherwise(F.array(F.lit(REASONS["safe"][which])))

    any_reason = F.lit(False)
    for test in tests.values():
        any_reason = any_reason | test
    decision = F.when(marker | high, "block").when(any_reason, "mask_and_continue").otherwise("safe")
    told_by = {"decision": decision, "reasons": told(0), "actions": told(1)}
    return documents.select(*[c for c in kept if c not in told_by], *[v.alias(k) for k, v in told_by.items()])


def truncation_downgrade(documents: DataFrame, limit: int = JUDGED_CHARS) -> DataFrame:
    """safe becomes mask_and_continue if only a head of the text was judged."""
    return documents.withColumn("decision", F.when((F.length("text") > limit) & (F.col("decision") == "safe"), "mask_and_continue").otherwise(F.col("decision")))


def blocked(documents: DataFrame) -> DataFrame:
    """F4."""
    return documents.filter((F.col("decision") == "block") | (F.col("outbound_risk") == "high"))


def confirmation(decision: Column, uncertain: Column | None = None) -> Column:
    """neither safe nor block, an unknown decision included; with uncertain candidates always."""
    known = F.coalesce(decision, F.lit("unknown"))
    asked = ~known.isin("safe", "block")
    return asked if uncertain is None else asked | (F.coalesce(uncertain, F.lit(0)) > 0)


def volume_warnings(documents: DataFrame, per_doc: int = DOC_TOKENS, per_set: int = SET_TOKENS) -> DataFrame:
    """review_id, name (null for the set) and tokens where a budget is passed."""
    sets = documents.groupBy("review_id").agg(F.sum("estimated_input_tokens").alias("tokens")).filter(F.col("tokens") > per_set)
    docs = documents.filter(F.col("estimated_input_tokens") > per_doc).select("review_id", "name", F.col("estimated_input_tokens").cast("long").alias("tokens"))
    return sets.select("review_id", F.lit(None).cast("string").alias("name"), "tokens").unionByName(docs)


def risk_rank(level: Column, unknown: int = 1) -> Column:
    """The place of a level in low, medium, high; unknown ones are medium."""
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2).otherwise(unknown)


def max_risk(*levels: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), F.greatest(*[risk_rank(x) for x in levels], F.lit(0)) + 1)


def set_status(documents: DataFrame) -> DataFrame:
    """Blocked, confirmation_required or safe."""
    return documents.groupBy("review_id").agg(_status().alias("status"))


def _status() -> Column:
    block, ask = F.bool_or((F.col("decision") == "block") | (F.col("outbound_risk") == "high")), F.bool_or(confirmation(F.col("decision")))
    return F.when(block, "blocked").when(ask, "confirmation_required").otherwise("safe")


def security_summary(documents: DataFrame) -> DataFrame:
    """Totals of a set, counts of decisions and its highest risk."""
    return documents.groupBy("review_id").agg(*_totals())


def _totals() -> list[Column]:
    worst = F.element_at(F.array(*map(F.lit, RISKS)), F.max(risk_rank(F.col("outbound_risk"), 0)) + 1)
    return [
        F.sum(F.size("replacements")).alias("replacements"), worst.alias("max_outbound_risk"), F.sum("estimated_input_tokens").alias("estimated_input_tokens"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("safe", "mask_and_continue", "block")], F.count_if(F.col("decision").isNull()).alias("n_unknown"),
    ]


def unique_findings(*lists: Column) -> Column:
    """Trimmed, without empty ones, each once, the first place counts."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: x != ""))


def unconfirmed(documents: DataFrame, confirmations: DataFrame) -> DataFrame:
    """J18. confirmations: review_id, name; a null name confirms the whole set."""
    whole = confirmations.filter("name is null").select("review_id").distinct()
    asked = documents.filter(confirmation(F.col("decision"))).join(whole.hint("merge"), "review_id", "left_anti")
    return asked.join(confirmations.select("review_id", "name").hint("merge"), ["review_id", "name"], "left_anti")


def attention_reasons(documents: DataFrame) -> Column:
    """F13. documents with decision, n_uncertain and replacements."""
    n = F.size("replacements")
    tests = [
        F.when(F.col("decision") == "block", "送信禁止"), F.when(F.col("decision").isNull() | (F.col("decision") == ""), "未判定"), F.when(F.col("decision") == "mask_and_continue", "要確認"),
        F.when(F.col("n_uncertain") > 0, F.concat(F.lit("uncertain "), F.col("n_uncertain").cast("string"))), F.when(n > 0, F.concat(F.lit("置換 "), n.cast("string"), F.lit(" 件"))),
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def by_attention(documents: DataFrame) -> DataFrame:
    """Blocked first, then unknown, to confirm, uncertain, replaced, the rest; larger ones first."""
    rank = F.when(F.col("decision") == "block", 0).when(F.col("decision").isNull() | (F.col("decision") == ""), 1).when(F.col("decision") == "mask_and_continue", 2).when(F.col("n_uncertain") > 0, 3).when(F.col("n_replacements") > 0, 4).otherwise(5)
    return documents.withColumn("priority", rank).orderBy("priority", F.desc("n_replacements"), F.desc("estimated_input_tokens"), "name")


def release_gate(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P20. docs: review_id, doc_ord, name, text. (documents, ledger, one row per set)."""
    documents, ledger, _ = mask_documents(docs)
    judged = assess_sensitivity(documents)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("decision")), F.col("decision"))
    judged = judged.withColumn("findings", unique_findings(F.col("findings"), F.transform("reasons", lambda r: F.concat(F.lit("ローカル機密度ゲート: "), label, F.lit(". "), r))))
    # totals and status in one aggregate: the texts are judged once
    return judged, ledger, judged.groupBy("review_id").agg(*_totals(), _status().alias("status"))
