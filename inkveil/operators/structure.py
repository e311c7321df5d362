"""Chapters of documents, and checks of their structure against the standard chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions.text import cjk_only, contains_any_squeezed, count_of, is_cjk, squeeze_word, squeezed
from inkveil.sources.scratch import materialised

# The standard chapters (id, name, purpose) and their items (chapter, id, name, necessity, expected content).
CHAPTERS = (
    ("ch1", "はじめに", "目的・スコープ・関係者の明示"),
    ("ch2", "システム要件", "機能要件・非機能要件の整理"),
    ("ch3", "システム全体構成", "物理・論理の構成、データフロー"),
    ("ch4", "ネットワーク設計", "接続性・帯域・冗長性"),
    ("ch5", "アカウント・認可設計", "認証・認可・権限分離"),
    ("ch6", "データ設計", "データモデル・ストレージ・保護"),
    ("ch7", "アプリケーション・サービス設計", "アプリ構成・連携・メッセージング"),
    ("ch8", "可用性設計", "SLI/SLO/SLA, DR/BCP"),
    ("ch9", "性能設計", "性能目標・スケーラビリティ"),
    ("ch10", "セキュリティ設計", "脅威モデル・暗号化・監査"),
    ("ch11", "運用設計", "監視・アラート・デプロイ・バックアップ"),
    ("ch12", "コスト設計", "コスト見積・最適化"),
    ("ch13", "拡張性・保守性設計", "機能追加・ベンダロックイン回避"),
    ("ch14", "移行設計", "移行方針・手順・ロールバック"),
    ("ch15", "補足", "リスク・前提・改訂履歴・参照文書"),
)
ITEMS = (
    ("ch1", "1.1", "本書の目的", "must", "構築目的、対象システム、想定読者、期待される成果"),
    ("ch1", "1.2", "スコープ", "must", "対象範囲・対象外範囲・関連システムとの境界"),
    ("ch1", "1.3", "関係者・体制", "must", "体制図、責任範囲、エスカレーションパス、ベンダー"),
    ("ch1", "1.4", "用語定義", "recommended", "略語・固有用語・本書独自用語の定義"),
    ("ch1", "1.5", "参照文書", "recommended", "関連設計書・規格・既存運用文書の一覧"),
    ("ch1", "1.6", "改訂履歴", "must", "版番号、改訂日、改訂内容、承認者"),
    ("ch2", "2.1", "業務要件", "must", "業務目的、現状業務、改善目標"),
    ("ch2", "2.2", "機能要件", "must", "ユースケース、機能一覧、優先度、入出力"),
    ("ch2", "2.3", "非機能要件 (NFR)", "must", "WAF 5 柱 (OE/SEC/REL/PERF/COST) について各々定量目標"),
    ("ch2", "2.4", "制約条件", "recommended", "法令・社内ポリシー・ベンダ依存・予算・スケジュール"),
    ("ch2", "2.5", "前提条件", "recommended", "業務前提、技術前提、環境前提"),
    ("ch3", "3.1", "全体構成図", "must", "物理構成 + 論理構成 (両方)、凡例"),
    ("ch3", "3.2", "構成要素一覧", "must", "各コンポーネント、役割、提供元、版数"),
    ("ch3", "3.3", "データフロー", "recommended", "システム間/コンポーネント間のデータの流れ"),
    ("ch3", "3.4", "ステークホルダ視点", "recommended", "利用者/運用者/監査の各視点での見え方"),
    ("ch3", "3.5", "環境構成", "must", "本番/検証/開発環境の構成と差異"),
    ("ch4", "4.1", "ネットワーク構成", "must", "VPC/サブネット/AZ 構成、IP アドレス体系"),
    ("ch4", "4.2", "接続要件", "must", "利用プロトコル、ポート、暗号化要件"),
    ("ch4", "4.3", "経路設計", "must", "ルーティング、Direct Connect/VPN、NAT/PAT"),
    ("ch4", "4.4", "帯域・遅延設計", "recommended", "想定帯域、SLA、レイテンシ目標"),
    ("ch4", "4.5", "冗長化", "must", "SPOF 排除、フェイルオーバ、BGP/HA"),
    ("ch4", "4.6", "DNS 設計", "must", "名前解決方針、DNS サーバ、ゾーン設計"),
    ("ch5", "5.1", "アカウント方針", "must", "人/サービスの分類、命名規則、ライフサイクル"),
    ("ch5", "5.2", "認証方式", "must", "パスワードポリシー、MFA、SSO、フェデレーション"),
    ("ch5", "5.3", "認可・権限分離", "must", "最小権限原則、ロール設計、ABAC/RBAC"),
    ("ch5", "5.4", "職務分掌 (SoD)", "recommended", "開発/運用/監査の権限分離"),
    ("ch5", "5.5", "アカウント棚卸", "recommended", "定期見直しサイクル、退職者処理"),
    ("ch6", "6.1", "データモデル", "recommended", "エンティティ、関連、属性 (アプリ依存)"),
    ("ch6", "6.2", "ストレージ設計", "must", "種別 (DB/オブジェクト/ブロック)、容量、IOPS"),
    ("ch6", "6.3", "データ保護", "must", "暗号化 (in-transit, at-rest)、鍵管理"),
    ("ch6", "6.4", "バックアップ・リカバリ", "must", "RPO/RTO、頻度、保管期間、リストア手順"),
    ("ch6", "6.5", "データライフサイクル", "recommended", "保存期間、廃棄ポリシー、アーカイブ"),
    ("ch6", "6.6", "ログ保管", "must", "監査ログ・アプリログの保管期間と取扱"),
    ("ch7", "7.1", "アプリ構成", "must", "コンポーネント構成、デプロイ方式"),
    ("ch7", "7.2", "外部 IF", "must", "API、メッセージング、ファイル連携"),
    ("ch7", "7.3", "内部連携", "recommended", "サービス間通信、認証伝播"),
    ("ch7", "7.4", "エラーハンドリング", "recommended", "異常系設計、リトライ、サーキットブレーカー"),
    ("ch8", "8.1", "SLI/SLO/SLA", "must", "サービス指標、目標、契約レベル"),
    ("ch8", "8.2", "単一障害点", "must", "SPOF の特定と対策"),
    ("ch8", "8.3", "DR (災害対策)", "must", "DR 方針、リージョン構成、RPO/RTO"),
    ("ch8", "8.4", "BCP (事業継続)", "recommended", "業務継続計画、復旧手順"),
    ("ch8", "8.5", "訓練・演習", "recommended", "切替訓練、リハーサル計画"),
    ("ch9", "9.1", "性能目標", "must", "スループット、レスポンスタイム、同時接続数"),
    ("ch9", "9.2", "容量見積", "must", "データ容量、ピーク負荷、伸び率"),
    ("ch9", "9.3", "スケーラビリティ", "must", "スケールアウト/アップ方針、自動化"),
    ("ch9", "9.4", "ボトルネック分析", "recommended", "想定ボトルネック、対策"),
    ("ch9", "9.5", "性能試験計画", "recommended", "負荷試験のシナリオ、ツール、合格基準"),
    ("ch10", "10.1", "脅威モデル", "must", "STRIDE 等での脅威分析"),
    ("ch10", "10.2", "ネットワーク境界防御", "must", "FW、WAF、IDS/IPS"),
    ("ch10", "10.3", "エンドポイント防御", "recommended", "アンチウィルス、EDR"),
    ("ch10", "10.4", "データ暗号化", "must", "in-transit, at-rest、鍵管理 (KMS)"),
    ("ch10", "10.5", "監査ログ", "must", "取得対象、改ざん防止、保管"),
    ("ch10", "10.6", "インシデント対応", "must", "検知/通報/復旧プロセス"),
    ("ch10", "10.7", "脆弱性管理", "recommended", "スキャン、パッチ管理"),
    ("ch10", "10.8", "法令・規制対応", "recommended", "個人情報保護法、業界規制"),
    ("ch11", "11.1", "監視設計", "must", "メトリクス、ログ、トレース、ダッシュボード"),
    ("ch11", "11.2", "アラート", "must", "閾値、通知先、エスカレーション"),
    ("ch11", "11.3", "オンコール体制", "recommended", "当番制、シフト、エスカレーションパス"),
    ("ch11", "11.4", "デプロイ・リリース", "must", "デプロイ方式、ロールバック手順"),
    ("ch11", "11.5", "構成管理", "recommended", "IaC、変更履歴、承認プロセス"),
    ("ch11", "11.6", "バックアップ運用", "must", "取得頻度、検証、保管"),
    ("ch11", "11.7", "定期作業", "recommended", "パッチ、ローテーション、棚卸"),
    ("ch12", "12.1", "コスト見積", "must", "月額/年額、内訳 (リソース別)"),
    ("ch12", "12.2", "コスト最適化", "recommended", "リザーブドインスタンス、Spot、Auto Scaling"),
    ("ch12", "12.3", "予算管理", "recommended", "予算アラート、承認フロー"),
    ("ch12", "12.4", "コスト削減シナリオ", "optional", "スケールダウン手順、廃止計画"),
    ("ch13", "13.1", "機能拡張への対応", "recommended", "機能追加時のインパクト、拡張ポイント"),
    ("ch13", "13.2", "ベンダロックイン回避", "recommended", "標準準拠、移行可能性"),
    ("ch13", "13.3", "技術的負債管理", "optional", "既知の負債、解消計画"),
    ("ch13", "13.4", "ドキュメント保守", "must", "改訂サイクル、責任者"),
    ("ch14", "14.1", "移行方針", "must", "一括/段階、並行稼働の有無"),
    ("ch14", "14.2", "移行手順", "must", "切替手順、検証手順"),
    ("ch14", "14.3", "ロールバック計画", "must", "失敗時の戻し方、判定基準"),
    ("ch14", "14.4", "データ移行", "must", "データ変換、検証、整合性確認"),
    ("ch14", "14.5", "利用者影響", "recommended", "サービス停止時間、利用者通知"),
    ("ch15", "15.1", "リスクと前提", "must", "リスク一覧、対応方針、未決事項"),
    ("ch15", "15.2", "課題管理", "recommended", "未決事項一覧、責任者、期限"),
    ("ch15", "15.3", "別紙・付録", "optional", "詳細データ、参考情報"),
)
WEIGHTS = {"must": 3, "recommended": 2, "optional": 1}
CRITICAL_CHAPTERS = ("ch1", "ch2", "ch3", "ch8", "ch10", "ch11", "ch15")
SET_WIDE_ITEMS = ("1.3", "1.6")
ITEM_WORDS = {
    "1.1": ("目的", "背景", "ねらい", "対象システム", "想定読者", "成果"),
    "1.2": ("スコープ", "対象範囲", "対象外", "範囲", "境界"),
    "1.3": ("関係者", "体制", "責任", "責任分界", "エスカレーション", "ベンダ"),
    "1.6": ("改訂履歴", "変更履歴", "版番号", "改訂日", "承認者"),
    "2.1": ("業務要件", "業務目的", "現状業務", "改善目標"),
    "2.2": ("機能要件", "機能一覧", "ユースケース", "入出力"),
    "2.3": ("非機能", "NFR", "可用性", "性能", "セキュリティ", "コスト"),
    "3.1": ("全体構成", "構成図", "論理構成", "物理構成"),
    "3.2": ("構成要素", "コンポーネント", "役割", "版数"),
    "3.5": ("本番", "検証", "開発", "環境構成", "環境差異"),
    "8.1": ("SLI", "SLO", "SLA", "サービスレベル", "稼働率"),
    "8.3": ("DR", "災害", "RPO", "RTO", "リージョン"),
    "10.1": ("脅威", "STRIDE", "リスク分析", "脅威モデル"),
    "10.4": ("暗号", "KMS", "鍵管理", "at-rest", "in-transit"),
    "10.5": ("監査ログ", "証跡", "改ざん", "ログ保管"),
    "10.6": ("インシデント", "検知", "通報", "復旧"),
    "11.1": ("監視", "メトリクス", "ログ", "ダッシュボード"),
    "11.2": ("アラート", "閾値", "通知", "エスカレーション"),
    "11.4": ("デプロイ", "リリース", "ロールバック"),
    "11.6": ("バックアップ", "保管", "リストア", "復元"),
    "14.3": ("ロールバック", "切戻し", "戻し方", "判定基準"),
    "15.1": ("リスク", "前提", "未決", "課題", "対応方針"),
}
CHAPTER_WORDS = {
    "ch1": ("目的", "背景", "スコープ", "対象範囲", "対象外", "関係者", "責任分担"),
    "ch2": ("業務要件", "機能要件", "非機能要件", "NFR", "制約条件", "前提条件"),
    "ch3": ("全体構成", "構成図", "構成要素", "コンポーネント", "環境構成"),
    "ch4": ("ネットワーク", "VPC", "サブネット", "IP", "ルーティング", "VPN", "DNS"),
    "ch5": ("認証", "認可", "アカウント", "権限", "MFA", "SSO"),
    "ch8": ("可用性", "冗長", "稼働率", "SLO", "SLA", "DR", "RPO", "RTO"),
    "ch10": ("セキュリティ", "脅威", "脆弱性", "暗号", "KMS", "監査ログ", "インシデント"),
    "ch11": ("運用", "監視", "アラート", "バックアップ", "デプロイ", "リリース", "ロールバック"),
    "ch14": ("移行", "切戻し", "ロールバック", "移行手順", "判定基準"),
    "ch15": ("リスク", "前提", "未決", "課題", "参照文書", "改訂履歴"),
}
FULL_HEADING = r"(?mdU)^[\s　]*第\s*(\d{1,2})\s*章[\s　]+([^\n]+)$"
SHORT_HEADING = r"(?mdU)^[\s　]*(\d{1,2})\.\s*([^\n]+)$"
# All characters that (?U)\s takes.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# End of the fixed values.
GENERIC_HEAD, LAST_CHAPTER, LEAST_CHAPTERS = 2000, 15, 3


def standard_chapters() -> list[tuple[int, str, str, str]]:
    """(place, chapter_id, name, purpose)."""
    return [(i, *row) for i, row in enumerate(CHAPTERS, 1)]


def standard_items() -> list[tuple[str, str, str, str, int, str]]:
    """(chapter_id, item_id, name, necessity, weight, expected content)."""
    return [(chapter, item, name, necessity, WEIGHTS[necessity], expected) for chapter, item, name, necessity, expected in ITEMS]


def dim_chapter(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(standard_chapters(), "chapter_ord int, chapter_id string, chapter_name string, purpose string")


def dim_item(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(standard_items(), "chapter_id string, item_id string, item_name string, necessity string, weight int, expected_content string")


def sequential(numbers: Column) -> Column:
    """Begins with 1, ends by 15, steps of 1 or 2, at least four in five of them 1."""
    steps = F.zip_with(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: b - a)
    ones = F.size(F.filter(steps, lambda d: d == 1))
    good = (F.element_at(numbers, 1) == 1) & (F.element_at(numbers, -1) <= LAST_CHAPTER) & F.forall(steps, lambda d: d.between(1, 2)) & (ones >= F.lit(0.8) * F.size(steps))
    return F.when(F.size(numbers) > 0, good).otherwise(F.lit(False))


def _headed(text: Column, pattern: str) -> Column:
    """(number, title, body) of each heading; a body reaches to the next one, its own line included."""
    lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))  # named once, as Spark finds them again for each use; what the groups hold is read from each line
    rest = F.slice(F.split(text, pattern, -1), 2, 1_000_000)
    title = lambda a: F.btrim(F.regexp_replace(F.regexp_extract(a, pattern, 2), r"(?U)^\s+|\s+$", ""))
    body = lambda a, b: F.btrim(F.concat(a, F.coalesce(b, F.lit(""))), F.lit(WHITE_SPACE))
    return F.zip_with(lines, rest, lambda a, b: F.struct(F.regexp_extract(a, pattern, 1).cast("int").alias("number"), title(a).alias("title"), body(a, b).alias("body")))


def extract_chapters(docs: DataFrame, least: int = LEAST_CHAPTERS, whole: bool = False, text: str = "text") -> DataFrame:
    """P3. One row per chapter: the columns of docs without the text, chapter_ord, chapter_id, chapter_label, number, body.

    Full headings come first, then numbered ones if their numbers run on. With ``whole``, a document without
    chapters is one row, chapter_id "whole". The id follows from the number alone.
    """
    kept = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*kept, body.alias("_t"))
    rows = rows.withColumn("_f", F.when(F.contains("_t", F.lit("章")), _headed(F.col("_t"), FULL_HEADING)))
    rows = rows.withColumn("_full", F.coalesce(F.size("_f"), F.lit(0)) >= least)
    rows = rows.withColumn("_s", F.when(~F.col("_full") & F.col("_t").rlike(SHORT_HEADING), _headed(F.col("_t"), SHORT_HEADING)))
    numbers = F.transform("_s", lambda x: x["number"])
    found = F.when(F.col("_full"), F.col("_f")).when((F.coalesce(F.size("_s"), F.lit(0)) >= least) & sequential(numbers), F.col("_s"))
    rows = rows.withColumn("_c", found)
    label = F.when(F.col("_full"), F.concat(F.lit("第 "), F.col("c.number").cast("string"), F.lit(" 章 "), F.col("c.title"))).otherwise(F.concat(F.col("c.number").cast("string"), F.lit(". "), F.col("c.title")))
    known = F.col("c.number").between(1, LAST_CHAPTER)
    # an outer explode: for an inner one Spark filters by the chapters before, and finds them several times for that
    out = rows.select(*kept, "_t", "_full", F.posexplode_outer("_c").alias("chapter_ord", "c"))
    none = F.col("c").isNull()
    if not whole:
        out = out.filter(~none)
    return out.select(
        *kept, F.coalesce("chapter_ord", F.lit(0)).alias("chapter_ord"), F.when(none, "whole").when(known, F.concat(F.lit("ch"), F.col("c.number").cast("string"))).otherwise("ch_unknown").alias("chapter_id"),
        F.when(none, "文書全体").otherwise(label).alias("chapter_label"), F.when(none, 0).otherwise(F.col("c.number")).alias("number"), F.when(none, F.col("_t")).otherwise(F.col("c.body")).alias("body"),
    )


def _words_by_script(words) -> tuple[Column, Column]:
    """Squeezed words to look for in a text's ideographs and kana alone, and those for all of it."""
    own = [squeeze_word(w) for w in words]
    listed = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    return listed([w for w in own if is_cjk(w)]), listed([w for w in own if not is_cjk(w)])


def _flags(squeezed_text: Column, cjk: Column, rules: dict[str, tuple[str, ...]], least: int) -> Column:
    """Names of the rules of which at least ``least`` words are in the text; the text as ``squeezed`` and as ``cjk_only`` make it."""
    rows = [(name, *_words_by_script(words)) for name, words in rules.items()]
    table = F.array(*[F.struct(F.lit(name).alias("name"), short.alias("cjk"), rest.alias("rest")) for name, short, rest in rows])
    found = F.filter(table, lambda r: F.size(F.filter(r["cjk"], lambda w: F.contains(cjk, w))) + F.size(F.filter(r["rest"], lambda w: F.contains(squeezed_text, w))) >= least)
    return F.transform(found, lambda r: r["name"])


def keyword_hits(squeezed_text: Column, chapter_id: str) -> Column:
    """How many of a chapter's words the text has."""
    return count_of([F.contains(squeezed_text, F.lit(squeeze_word(w))) for w in CHAPTER_WORDS.get(chapter_id, ())])


def check_structure(docs: DataFrame) -> DataFrame:
    """P4 for designs. docs: review_id, doc_ord, name, text. Findings: review_id, kind, severity, chapter_id, chapter_name, item_id, item_name, source_document, expected_content.

    Text is looked at once per document or chapter, inside a task; sets only gather names of rules. A word that would
    reach from one document into the next doesn't count.
    """
    spark = docs.sparkSession
    chapter, item = F.broadcast(dim_chapter(spark)), F.broadcast(dim_item(spark))  # 15 and 78 rows
    short, rest = _words_by_script(w for words in CHAPTER_WORDS.values() for w in words)
    found_words = F.concat(F.filter(short, lambda w: F.contains(F.col("_j"), w)), F.filter(rest, lambda w: F.contains(F.col("_s"), w)))
    # one pass: what a document has is told beside each of its chapters, and read from the first one's row
    per_doc = docs.select("review_id", "doc_ord", "name", "text", squeezed(F.col("text")).alias("_s"), cjk_only(F.col("text")).alias("_j"))
    per_doc = per_doc.select("review_id", "doc_ord", "name", "text", _flags(F.col("_s"), F.col("_j"), ITEM_WORDS, 1).alias("doc_items"), found_words.alias("doc_words"))
    found = extract_chapters(per_doc, whole=True).withColumns({"_s": squeezed(F.col("body")), "_j": cjk_only(F.col("body"))})
    found = found.select("review_id", "doc_ord", "name", "chapter_ord", "chapter_id", "doc_items", "doc_words", *[_flags(F.col("_s"), F.col("_j"), rules, least).alias(c) for c, rules, least in (("topics", CHAPTER_WORDS, 2), ("items", ITEM_WORDS, 1))])
    found = materialised(found)
    per_set = found.filter("chapter_ord = 0").groupBy("review_id").agg(*[F.array_distinct(F.flatten(F.collect_list(f"doc_{c}"))).alias(c) for c in ("items", "words")])
    per_set = materialised(per_set)
    found = found.filter("chapter_id != 'whole'").drop("doc_items", "doc_words")
    detected = found.select("review_id", "chapter_id").distinct()
    with_any = detected.select("review_id").distinct()
    standard = F.broadcast(dim_chapter(spark).select(F.col("chapter_id").alias("source_id"), F.col("chapter_name").alias("source_chapter")))
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, kind: str, severity: Column, **values: Column) -> DataFrame:
        columns = {c: values.get(c, none) for c in ("chapter_id", "chapter_name", "item_id", "item_name", "source_document", "expected_content")}
        return rows.select("review_id", F.lit(kind).alias("kind"), severity.alias("severity"), *[v.cast("string").alias(c) for c, v in columns.items()])

    # Content of a chapter that is nowhere, within another one; the first place counts
    stray = found.join(standard.hint("merge"), F.col("chapter_id") == F.col("source_id")).select("review_id", "doc_ord", "name", "chapter_ord", F.explode("topics").alias("topic"))
    stray = stray.join(detected.select("review_id", F.col("chapter_id").alias("topic")).hint("merge"), ["review_id", "topic"], "left_anti")
    stray = stray.groupBy("review_id", "topic").agg(F.min_by("name", F.struct("doc_ord", "chapter_ord")).alias("name"))
    # Missing chapters; those whose words the set has elsewhere are suggestions
    missing = with_any.join(chapter).join(detected.hint("merge"), ["review_id", "chapter_id"], "left_anti")
    missing = missing.join(stray.withColumnRenamed("topic", "chapter_id").hint("merge"), ["review_id", "chapter_id"], "left").join(per_set.select("review_id", "words").hint("merge"), "review_id")
    words = F.create_map(*[x for k, v in CHAPTER_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(squeeze_word(w)) for w in v]))])
    elsewhere = F.coalesce(F.size(F.array_intersect("words", F.element_at(words, F.col("chapter_id")))) >= 2, F.lit(False))
    suggested = missing.filter(F.col("name").isNotNull() | elsewhere)
    gone = missing.filter(F.col("name").isNull() & ~elsewhere)
    of_chapter = {"chapter_id": F.col("chapter_id"), "chapter_name": F.col("chapter_name"), "expected_content": F.col("purpose")}
    critical = F.when(F.col("chapter_id").isin(*CRITICAL_CHAPTERS), "high").otherwise("medium")
    # Required items of a chapter, and of the set
    required = dim_item(spark).filter(F.col("necessity") == "must").filter(F.col("item_id").isin(*ITEM_WORDS)).join(dim_chapter(spark).select("chapter_id", "chapter_name"), "chapter_id")
    own = found.join(F.broadcast(required.filter(~F.col("item_id").isin(*SET_WIDE_ITEMS))), "chapter_id").filter(~F.array_contains("items", F.col("item_id")))
    wide = with_any.join(per_set.select("review_id", "items"), "review_id").crossJoin(F.broadcast(required.filter(F.col("item_id").isin(*SET_WIDE_ITEMS)))).filter(~F.array_contains("items", F.col("item_id")))
    weight = F.when(F.col("weight") >= 3, "high").otherwise("medium")
    of_item = {"item_id": F.col("item_id"), "item_name": F.col("item_name"), "expected_content": F.col("expected_content")}
    # sets without any heading
    plain = per_set.join(with_any.hint("merge"), "review_id", "left_anti")
    unsaid = plain.filter(~F.array_contains("items", "1.1")).crossJoin(F.broadcast(dim_item(spark).filter("item_id = '1.1'").join(dim_chapter(spark).select("chapter_id", "chapter_name"), "chapter_id")))
    return (
        shaped(suggested, "structure_organization_suggestion", F.lit("medium"), source_document=F.coalesce("name", F.lit("")), **of_chapter)
        .unionByName(shaped(gone, "missing_chapter", critical, **of_chapter))
        .unionByName(shaped(own, "required_item_gap", weight, chapter_id=F.col("chapter_id"), chapter_name=F.col("chapter_name"), source_document=F.col("name"), **of_item))
        .unionByName(shaped(wide, "required_item_gap", weight, chapter_id=F.lit(""), chapter_name=F.lit("文書全体"), **of_item))
        .unionByName(shaped(plain, "chapter_structure_missing", F.lit("high")))
        .unionByName(shaped(plain, "structure_template_suggestion", F.lit("info")))
        .unionByName(shaped(unsaid, "required_item_gap", F.lit("high"), chapter_id=F.col("chapter_id"), chapter_name=F.col("chapter_name"), **of_item))
    )


def check_purpose(docs: DataFrame, head: int = GENERIC_HEAD) -> DataFrame:
    """P4 for other profiles: sets whose first ``head`` characters tell no purpose. Documents count in order, as one text."""
    longer = F.coalesce(F.length("text"), F.lit(0)) + 1
    before = F.sum(longer).over(Window.partitionBy("review_id").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, 0)) - longer
    rows = docs.select("review_id", "doc_ord", "text", before.alias("before")).filter(F.col("before") < head)
    told = rows.select("review_id", contains_any_squeezed(squeezed(F.expr(f"substring(text, 1, cast({head} - before as int))")), ITEM_WORDS["1.1"]).alias("told"))
    return told.groupBy("review_id").agg(F.bool_or("told").alias("told")).filter("not told").select("review_id", F.lit("required_item_gap").alias("kind"), F.lit("medium").alias("severity"), F.lit("冒頭の目的記載").alias("item_name"))


def structure_overview(findings: DataFrame) -> DataFrame:
    """Counts by severity and kind, and a tone."""
    counts = findings.groupBy("review_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low", "info")], F.count_if(F.col("kind") == "missing_chapter").alias("n_missing"), F.count_if(F.col("kind") == "required_item_gap").alias("n_gaps"))
    return counts.withColumn("tone", F.when(F.col("n_high") > 0, "block").when(F.col("n_medium") > 0, "warn").otherwise("safe"))


def select_checks(checks: DataFrame, profile: str) -> DataFrame:
    """checks without a profile list, or with this one in it."""
    return checks.filter((F.coalesce(F.size("applies_to"), F.lit(0)) <= 0) | F.array_contains("applies_to", profile))


def in_chapter_order(rows: DataFrame, column: str = "item_id") -> DataFrame:
    """1.10 after 1.9."""
    parts = F.transform(F.split(column, "[.]"), lambda x: x.try_cast("int"))
    return rows.orderBy(parts, column)
