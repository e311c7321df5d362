"""One evaluator for rule tables, and the rule scans built on it: device configurations, scripts, documents, diagrams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.detectors import network_identifiers
from inkveil.functions.text import any_of, count_of, has_any
from inkveil.sources.scratch import materialised


@dataclass(frozen=True)
class Rule:
    """Fires where a pattern or word of ``some`` is found (or there are none) and none of ``none``. Words are parts of the lower-cased text, patterns Java expressions on the text."""

    severity: str
    title: str
    some: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    some_words: tuple[str, ...] = ()
    none_words: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    head: int = 0  # only so many characters for the words

    def fires(self, text: Column, lowered: Column) -> Column:
        words = lambda found: has_any(lowered, found)
        there = any_of([text.rlike(p) for p in self.some]) | words(self.some_words) if self.some or self.some_words else F.lit(True)
        return there & ~any_of([text.rlike(p) for p in self.none]) & ~words(self.none_words)


def _with_lower(docs: DataFrame, rules: Sequence[Rule] = (), text: str = "text") -> DataFrame:
    """docs with _t, the text or an empty one, _l, the same in lower case, and _l with a number for so many first characters of it.
    They are columns: within a list of words they would be made again for each word."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_l", F.lower("_t"))
    return rows.withColumns({f"_l{r.head}": F.substring("_l", 1, r.head) for r in rules if r.head})


def _row(order: int, rule: Rule, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(order).alias("rule_ord"), F.lit(rule.severity).alias("severity"), F.lit(rule.title).alias("title")))


def _fired(rules: Sequence[Rule], profile: Column | None = None, where: Column | None = None) -> list[Column]:
    """For each rule a row, or null, of a text with what ``_with_lower`` adds."""
    found = []
    for i, r in enumerate(rules):
        when = r.fires(F.col("_t"), F.col(f"_l{r.head or ''}"))
        if r.profiles and profile is not None:
            when = profile.isin(*r.profiles) & when
        found.append(_row(i, r, when if where is None else where & when))
    return found


def _listed(rows: DataFrame, kept: Sequence[str], found: Sequence[Column]) -> DataFrame:
    """The rows that fired, and one with nulls for a text without any. An outer explode: for an inner one Spark filters by the rows before, and finds them twice for that."""
    return rows.select(*kept, F.explode_outer(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select(*kept, "r.*")


def evaluate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", profile: Column | None = None) -> DataFrame:
    """One row per rule that fires: the columns of docs but the text, rule_ord, severity, title. One pass over each text."""
    kept = [c for c in docs.columns if c != text]
    return _listed(_with_lower(docs, rules, text), kept, _fired(rules, profile)).filter("rule_ord is not null")


# Signals, patterns, severities and titles.
IOS_SIGNALS = (r"(?m)^interface\s+\S+", r"(?m)^line\s+vty\s+\d+", r"(?m)^router\s+(ospf|bgp|eigrp|rip)\b", r"(?m)^ip\s+access-list\b", r"(?m)^access-list\s+\d+\s+", r"(?m)^aaa\s+new-model\b", r"(?m)^snmp-server\s+community\b")
#: What each of these signals begins with.
IOS_BEGINNING = r"(?m)^(?:interface|line|router|ip|access-list|aaa|snmp-server)\s"
FORTIOS_SIGNALS = ("config system interface", "config firewall policy", "config firewall address", "config router static", "config router bgp", "config vpn ipsec phase1-interface", "set srcintf", "set dstintf", "set srcaddr", "set dstaddr")
IOS_RULES = (
    Rule("high", "Telnetによる管理アクセスの可能性", (r"(?im)^\s*transport\s+input\s+.*\btelnet\b", r"(?im)^\s*transport\s+input\s+all\b")),
    Rule("high", "enable password の利用", (r"(?im)^enable\s+password\s+",), (r"(?im)^enable\s+secret\s+",)),
    Rule("high", "SNMP community string の利用", (r"(?im)^snmp-server\s+community\s+",)),
    Rule("medium", "広すぎるACL許可の可能性", (r"(?im)^\s*(access-list\s+\d+\s+permit|permit)\s+ip\s+any\s+any\b",)),
    Rule("medium", "HTTP管理機能の有効化", (r"(?im)^ip\s+http\s+server\b",), (r"(?im)^no\s+ip\s+http\s+server\b",)),
    Rule("medium", "AAA設定が明示されていない可能性", none_words=("aaa new-model",)),
    Rule("low", "外部ログ転送設定が見当たらない可能性", none_words=("logging host",)),
    Rule("low", "NTP設定が見当たらない可能性", none_words=("ntp server",)),
)
NO_DESCRIPTION = Rule("low", "interface description 不足の可能性")
FORTIOS_RULES = (
    Rule("high", "管理アクセスでHTTP/Telnet許可の可能性", (r"(?im)^\s*set\s+allowaccess\s+.*\b(telnet|http)\b",)),
    Rule("medium", "SNMP設定の確認が必要", some_words=("config system snmp",)),
    Rule("low", "NTP設定が見当たらない可能性", none_words=("config system ntp", "set ntpsync")),
    Rule("info", "HA構成の記述が見当たらない可能性", none_words=("config system ha",)),
)
WIDE_POLICY = Rule("high", "広すぎるFirewall Policyの可能性")
UNLOGGED_POLICY = Rule("medium", "Firewall Policyのログ設定が不明")
IOS_ROUTING = {"static route": r"(?im)^ip\s+route\s+", "OSPF": r"(?im)^router\s+ospf\b", "BGP": r"(?im)^router\s+bgp\b", "EIGRP": r"(?im)^router\s+eigrp\b", "RIP": r"(?im)^router\s+rip\b", "prefix-list": r"(?im)^ip\s+prefix-list\s+", "route-map": r"(?im)^route-map\s+"}
FORTIOS_ROUTING = {"static route": "config router static", "BGP": "config router bgp", "OSPF": "config router ospf", "route-map": "config router route-map"}
INTERFACE = r"(?im)^interface\s+(.+?)\s*$"
POLICY_BODY = r"(?ims)config\s+firewall\s+policy(.*?)^\s*end\s*$"
INTERFACE_BODY = r"(?ims)config\s+system\s+interface(.*?)^\s*end\s*$"
SECRET_ASSIGNED = r"(?im)(password|passwd|token|secret|apikey|api_key)\s*[:=]\s*['\"][^'\"]+['\"]"
COMMANDS = r"(?i)\bos\.system\s*\(|\bsubprocess\.(?:run|popen)\s*\(|\binvoke-expression\b|\biex\b|\beval\s*\("
SQL_WORDS = ("create procedure", "create proc", "alter procedure", "alter proc", "declare @", "begin tran", "commit tran", "select ", "from ", "where ", "exec dbo.", "execute dbo.")
PYTHON_WORDS = ("import ", "def ", "lambda ", "os.", "subprocess.", "sys.")
TLS_OFF = ("ssl-verify=ignore", "ssl_verify=false", "verify=false", "verify = false", "rejectunauthorized: false", "check_hostname = false", "cert_reqs=none", "trust_all_cert")
NETWORK_CALLS = ("urlopen(", "requests.get(", "requests.post(", "invoke-restmethod", "invoke-webrequest", "curl ", "wget ", "mailx ", "send-mailmessage")
DESTRUCTIVE = ("systemctl restart", "restart-service", "event.acknowledge", "delete from", "drop table", "truncate table", "rm -rf", "remove-item", "housekeeper_execute")
GUARDS = ("dryrun", "dry-run", "whatif", "-whatif", "confirm", "-confirm", "maxbatch", "batchsize", "approval", "承認", "事前確認")
EVENT_LOGGED = r"(?i)json\.dumps\s*\(\s*event\s*\)|logger\.(?:info|debug|warning|error)\s*\([^)]*\bevent\b|print\s*\([^)]*\bevent\b"
BROAD_EXCEPT = r"(?im)^\s*except\s*(?::|exception\b)"
CODE_RULES = (
    (Rule("high", "ハードコードされた認証情報の疑い", (SECRET_ASSIGNED,)), SECRET_ASSIGNED),
    (Rule("high", "危険なコマンド実行の可能性"), COMMANDS + r"|\bexec\s*\("),
    (Rule("high", "TLS/証明書検証を無効化している可能性", some_words=TLS_OFF), r"(?i)verify\s*=\s*false|ssl_verify\s*=\s*false|rejectunauthorized\s*:\s*false|check_hostname\s*=\s*false|cert_reqs\s*=\s*none|trust_all_cert"),
    (Rule("medium", "外部通信のタイムアウトが不明確", some_words=NETWORK_CALLS, none_words=("timeout",)), r"(?i)\burlopen\s*\(|\brequests\.(?:get|post)\s*\(|\binvoke-restmethod\b|\binvoke-webrequest\b|\bcurl\b|\bwget\b|\bmailx\b|\bsend-mailmessage\b"),
    (Rule("high", "破壊的または運用影響の大きい処理に安全ガードが不足", some_words=DESTRUCTIVE, none_words=GUARDS), r"(?i)systemctl\s+restart|restart-service|event\.acknowledge|delete\s+from|drop\s+table|truncate\s+table|rm\s+-rf|remove-item|housekeeper_execute"),
    (Rule("medium", "入力イベントを丸ごとログ出力している", (EVENT_LOGGED,)), EVENT_LOGGED),
    (Rule("medium", "例外処理が広すぎる可能性", (BROAD_EXCEPT,)), BROAD_EXCEPT),
)
DEFINED = r"^\s*(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
#: Language, what is looked at, and what it must hold; in this order.
LANGUAGES = (
    ("shell", "name", r"\.(sh|bash|bsh|ksh|zsh|sh\.txt|bash\.txt)$"),
    ("powershell", "name", r"\.(ps1|psm1|psd1|ps1\.txt)$"),
    ("sql", "name", r"\.(sql|psql|sql\.txt)$"),
    ("python", "name", r"\.(py|py\.txt)$"),
    ("shell", "first", r"^#!.*(sh|bash|ksh|zsh)"),
    ("python", "first", r"^#!.*python"),
    ("powershell", "begin", "param("),
    ("powershell", "words", ("$erroractionpreference", "invoke-")),
    ("python", "line", "(?m)" + DEFINED),
    ("sql", "lower", r"(?m)^\s*(?:select|insert|update|delete|create|alter)\b"),
    ("shell", "words", ("set -e", "set -u", "pipefail", "awk ", "sed ", "grep ")),
)
RUNBOOKS = ("change_runbook", "operations_runbook")
ROLLBACK = ("切戻し", "切り戻し", "rollback", "roll back", "backout", "補償処置", "リカバリ", "fallback", "代替手段")
IRREVERSIBLE = ("drop table", "truncate", "rm -rf", "delete from", "format ", "破棄", "削除", "データ削除", "物理削除", "上書き", "overwrite")
RISK_LEVELS, APPROVALS = ("リスクレベル", "risk level", "リスク分類", "リスク区分"), ("承認", "approval", "approved by", "オーソライズ", "サインオフ", "sign-off", "決裁")
REVIEW_RULES = (
    Rule("high", "Telnet usage detected", some_words=("telnet",)),
    Rule("high", "SNMP community string usage", some_words=("snmp-server community",)),
    Rule("medium", "AAA configuration not explicit", none_words=("aaa new-model", "aaa authentication"), profiles=("design",)),
    Rule("low", "Interface descriptions may be missing", (r"(?im)^interface\s",), none_words=("description",)),
    Rule("medium", "冒頭の目的記載が不明確", none_words=("目的", "本資料は", "本書は", "本手順書は", "対象", "purpose", "objective"), head=800),
    Rule("high", "構成情報の存在が確認できない", none_words=("構成図", "接続図", "ネットワーク構成", "システム構成", "機器一覧", "network diagram", "topology", "概要図", "全体概要", "体制図")),
    Rule("high", "タイムチャートの記載または別紙参照が不足", none_words=("タイムチャート", "time chart", "timeline", "別紙", "スケジュール"), profiles=RUNBOOKS),
    Rule("medium", "運用ハンドオーバー要素の記載が不足", none_words=("slo", "sla", "service level", "サービス目標", "稼働率目標", "オーナー", "owner", "raci", "責任分担", "エスカレーション", "escalation", "ランブック", "runbook", "on-call", "オンコール", "アラート", "alert"), profiles=("operations_runbook",)),
    Rule("high", "不可逆な作業が含まれる可能性があり、補償処置が不明", some_words=IRREVERSIBLE, none_words=ROLLBACK, profiles=("change_runbook",)),
    Rule("medium", "作業対象環境の区別が不明確", none_words=("本番", "検証", "ステージング", "staging", "production", "prod", "preprod", "開発環境", "qa環境", "評価環境"), profiles=("change_runbook",)),
    Rule("low", "作業後に修正対象となるドキュメントの事前一覧が無い", none_words=("変更対象ドキュメント", "修正対象ドキュメント", "更新対象ドキュメント", "改訂対象", "documents to update", "documents affected", "ドキュメント更新計画", "ドキュメント修正計画"), profiles=("change_runbook",)),
)
NO_APPROVAL = Rule("medium", "リスクレベルと承認プロセスの記載が不足")
NOTHING = Rule("info", "No major issue found in mock review")
ID_PREFIX = {"design": "D", "proposal": "P", "change_runbook": "CR", "operations_runbook": "OR", "network_config": "NC", "source_code": "SC"}
DIAGRAM_WORDS = {
    "external": ("internet", "インターネット", "wan", "isp", "aws", "azure", "gcp", "direct connect", "expressroute", "vpn", "mpls", "閉域", "専用線"),
    "zone": ("dmz", "internal", "inside", "outside", "untrust", "trust", "mgmt", "management", "public", "private", "管理", "社内", "外部", "本番", "検証"),
    "device": ("fortigate", "fortinet", "firewall", "fw", "router", "rtr", "cisco", "switch", "sw", "l2sw", "l3sw", "core", "access", "waf", "proxy", "lb", "alb", "nlb", "server", "db", "ap", "web"),
    "redundancy": ("ha", "冗長", "二重化", "active/standby", "active-standby", "active active", "active/active", "standby", "cluster", "vrrp", "hsrp", "glbp", "lag", "lacp", "port-channel", "port channel", "mlag", "stack"),
}
PAIRED = r"(?i)\b[A-Za-z][A-Za-z0-9_-]{2,}[-_](?:0?1|0?2|a|b)\b"
DIAGRAM_CAPS = {"device": 12, "identifier": 12}
# End of the fixed values.
LINE_ENDS = r"\r\n|\r|\n"


def looks_like_ios(lowered: Column) -> Column:
    return count_of([lowered.rlike(p) for p in IOS_SIGNALS]) >= 2


def looks_like_fortios(lowered: Column) -> Column:
    return count_of([F.contains(lowered, F.lit(s)) for s in FORTIOS_SIGNALS]) >= 2


def looks_like_config(lowered: Column) -> Column:
    return looks_like_ios(lowered) | looks_like_fortios(lowered)


def interface_blocks(text: Column) -> Column:
    """Array of (name, block), a block from its heading to the next one."""
    names = F.transform(F.regexp_extract_all(text, F.lit(INTERFACE), F.lit(1)), lambda x: F.trim(x))
    return F.zip_with(names, F.slice(F.split(text, INTERFACE, -1), 2, 1_000_000), lambda n, b: F.struct(n.alias("name"), F.coalesce(b, F.lit("")).alias("block")))


def policy_blocks(text: Column) -> Column:
    """The blocks of the firewall policies, split at ``edit``."""
    body = F.regexp_extract(text, POLICY_BODY, 1)
    return F.slice(F.split(body, r"(?im)^\s*edit\s+\S+.*$", -1), 2, 1_000_000)


def config_profile(docs: DataFrame) -> DataFrame:
    """Vendor, interface_names, routing_signals and policy_count of each text."""
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_t")).withColumn("_l", F.lower("_t"))
    rows = rows.withColumn("_i", looks_like_ios(F.col("_l"))).withColumn("_f", looks_like_fortios(F.col("_l")))
    none = F.array().cast("array<string>")
    ios_names = F.when(F.col("_i"), F.transform(interface_blocks(F.col("_t")), lambda b: b["name"])).otherwise(none)
    forti_names = F.when(F.col("_f"), F.transform(F.regexp_extract_all(F.regexp_extract("_t", INTERFACE_BODY, 1), F.lit(r'(?im)^\s*edit\s+"?([^"\n]+)"?'), F.lit(1)), lambda x: F.trim(x))).otherwise(none)
    ios_routing = F.when(F.col("_i"), F.filter(F.array(*[F.when(F.col("_t").rlike(p), k) for k, p in IOS_ROUTING.items()]), lambda x: x.isNotNull())).otherwise(none)
    forti_routing = F.when(F.col("_f"), F.filter(F.array(*[F.when(F.contains("_l", F.lit(w)), k) for k, w in FORTIOS_ROUTING.items()]), lambda x: x.isNotNull())).otherwise(none)
    vendor = F.when(F.col("_i") & F.col("_f"), "mixed_or_unknown").when(F.col("_f"), "fortinet_fortios").when(F.col("_i"), "cisco_ios").otherwise("unknown")
    return rows.select(*kept, vendor.alias("vendor"), F.array_distinct(F.concat(ios_names, forti_names)).alias("interface_names"), F.array_distinct(F.concat(ios_routing, forti_routing)).alias("routing_signals"), F.when(F.col("_f"), F.size(policy_blocks(F.col("_t")))).otherwise(0).alias("policy_count"))


def _ios(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """rows with columns of their own, and what P5 finds in them."""
    rows = rows.withColumn("_i", looks_like_ios(F.col("_l")))
    rows = rows.withColumn("_b", F.when(F.col("_i"), interface_blocks(F.col("_t"))))
    rows = rows.withColumn("_bare", F.size(F.filter("_b", lambda b: ~b["block"].rlike(r"(?im)^\s*description\s+\S+") & ~F.lower(b["name"]).rlike("^(loopback|null)"))))
    few = (F.size("_b") > 0) & (F.col("_bare") >= F.greatest(F.lit(2), F.floor(F.size("_b") / 2).cast("int")))
    return rows, [*_fired(IOS_RULES, where=F.col("_i")), _row(99, NO_DESCRIPTION, F.col("_i") & few)]


def _fortios(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    rows = rows.withColumn("_f", looks_like_fortios(F.col("_l")))
    rows = rows.withColumn("_p", F.when(F.col("_f"), policy_blocks(F.col("_t"))))
    all_of = lambda name: rf'(?im)^\s*set\s+{name}\s+"?all"?\s*$'
    wide = F.exists("_p", lambda b: F.contains(F.lower(b), F.lit("set action accept")) & b.rlike(all_of("srcaddr")) & b.rlike(all_of("dstaddr")) & b.rlike(all_of("service")))
    unlogged = (F.size("_p") > 0) & ~F.contains("_l", F.lit("set logtraffic"))
    return rows, [*_fired(FORTIOS_RULES, where=F.col("_f")), _row(99, WIDE_POLICY, F.col("_f") & wide), _row(99, UNLOGGED_POLICY, F.col("_f") & unlogged)]


def audit_ios(docs: DataFrame) -> DataFrame:
    """P5: findings on texts that look like IOS configurations."""
    rows, found = _ios(_with_lower(docs))
    return _listed(rows, [c for c in docs.columns if c != "text"], found).filter("rule_ord is not null")


def audit_fortios(docs: DataFrame) -> DataFrame:
    """P6."""
    rows, found = _fortios(_with_lower(docs))
    return _listed(rows, [c for c in docs.columns if c != "text"], found).filter("rule_ord is not null")


def defined_functions(text: Column) -> Column:
    """N10."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?m)" + DEFINED), F.lit(1)))


def code_language(name: Column, text: Column) -> Column:
    """The language of the first row of LANGUAGES that fits: by the name, the first line, the beginning, a line, or words."""
    n, t = F.lower(F.coalesce(name, F.lit(""))), F.ltrim(F.coalesce(text, F.lit("")))
    low, first = F.lower(t), F.lower(F.regexp_extract(t, r"^([^\r\n]*)", 1))
    tests = {
        "name": n.rlike, "first": first.rlike, "begin": low.startswith, "line": t.rlike, "lower": low.rlike,
        "words": lambda words: has_any(low, words),
    }
    out = None
    for language, kind, what in LANGUAGES:
        out = F.when(tests[kind](what), language) if out is None else out.when(tests[kind](what), language)
    return out.otherwise("generic")


def evidence(text: Column, pattern: str, hide: bool) -> Column:
    """J20 and W9 within a row: the first line with the pattern, its number and the last function defined at or before it."""
    return _evidence(F.split(text, LINE_ENDS, -1), pattern, hide)


def _evidence(lines: Column, pattern: str, hide: bool) -> Column:
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)).cast("int")
    before = F.filter(F.transform(F.slice(lines, 1, at), lambda x: F.regexp_extract(x, DEFINED, 1)), lambda x: x != "")
    where = F.concat(F.when(F.size(before) > 0, F.concat(F.element_at(before, -1), F.lit(" 内 / "))).otherwise(F.lit("")), at.cast("string"), F.lit("行目付近"))
    line = F.trim(F.regexp_replace(F.element_at(lines, at), r"\s+", " "))
    shown = F.lit("認証情報らしき代入を検出（値は表示しません）") if hide else F.when(F.length(line) > 160, F.concat(F.substring(line, 1, 157), F.lit("..."))).otherwise(line)
    return F.when(at > 0, F.concat(where, F.lit(": "), shown)).otherwise(F.lit("静的検出で該当パターンを確認しました。"))


def scan_code_risks(docs: DataFrame) -> DataFrame:
    """Severity, title, evidence and section of each risk in a script."""
    kept = [c for c in docs.columns if c != "text"]
    return _code(docs, kept).filter("rule_ord is not null").withColumn("section", F.trim(F.split("evidence", ":").getItem(0))).withColumn("re_review_required", F.col("severity") == "high").withColumn("origin", F.lit("static_code_analysis"))


def _code(docs: DataFrame, kept: Sequence[str]) -> DataFrame:
    rows = _with_lower(docs).withColumn("_lines", F.split("_t", LINE_ENDS, -1))
    sql = has_any(F.col("_l"), SQL_WORDS) & ~has_any(F.col("_l"), PYTHON_WORDS)
    found = []
    for i, (r, pattern) in enumerate(CODE_RULES):
        fires = F.col("_t").rlike(COMMANDS) | (F.col("_t").rlike(r"\bexec\s*\(") & ~sql) if i == 1 else r.fires(F.col("_t"), F.col("_l"))
        found.append(F.when(fires, F.struct(F.lit(i).alias("rule_ord"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), _evidence(F.col("_lines"), pattern, i == 0).alias("evidence"))))
    return _listed(rows, kept, found)


def rule_review(docs: DataFrame) -> DataFrame:
    """P8. docs: review_id, doc_ord, name, text, document_profile. Issues with ids (W3); one info row for sets without any."""
    kept = ["review_id", "doc_ord", "name", "document_profile"]
    rows, profile = docs.select(*kept, "text"), F.col("document_profile")
    columns = [*kept, "rule_ord", "severity", "title"]
    # each text is read in one pass, by the rules of its kind; one without findings is a row with nulls
    prose = _with_lower(rows.filter(~profile.isin("network_config", "source_code")), REVIEW_RULES)
    unapproved = (profile == "change_runbook") & ~(has_any(F.col("_l"), RISK_LEVELS) & has_any(F.col("_l"), APPROVALS))
    found = _listed(prose, kept, [*_fired(REVIEW_RULES, profile), _row(99, NO_APPROVAL, unapproved)])
    configs, ios = _ios(_with_lower(rows.filter(profile == "network_config")))
    configs, fortios = _fortios(configs)
    found = found.unionByName(_listed(configs, kept, [*ios, *fortios])).unionByName(_code(rows.filter(profile == "source_code"), kept).select(*columns))
    found = materialised(found.unionByName(rows.filter(profile.isNull()).select(*kept), allowMissingColumns=True))
    issues = found.filter("rule_ord is not null")
    quiet = found.groupBy("review_id").agg(F.count("rule_ord").alias("n"), F.collect_set(F.struct("document_profile")).alias("of")).filter("n = 0").select("review_id", F.inline("of"))
    issues = issues.unionByName(quiet.select("review_id", F.lit(0).alias("doc_ord"), F.lit("-").alias("name"), "document_profile", F.lit(0).alias("rule_ord"), F.lit(NOTHING.severity).alias("severity"), F.lit(NOTHING.title).alias("title")))
    return assign_issue_ids(issues)


def assign_issue_ids(issues: DataFrame, order: Sequence[str] = ("doc_ord", "rule_ord", "title")) -> DataFrame:
    """The profile's prefix and a number of three digits, by place in the set; ids that are given stay but count."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ID_PREFIX.items() for x in kv]), F.col("document_profile")), F.lit("I"))
    n = F.row_number().over(Window.partitionBy("review_id").orderBy(*order))
    new = F.format_string("%s-%03d", prefix, n)
    given = F.when(F.trim("issue_id") != "", F.col("issue_id")) if "issue_id" in issues.columns else F.lit(None).cast("string")
    return issues.withColumn("issue_id", F.coalesce(given, new))


def clean_lines(text: Column) -> Column:
    """Lines of 2 to 120 characters with a letter or digit in them, squeezed, each once."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" \t|")))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x).between(2, 120) & x.rlike("[A-Za-z0-9一-龯ぁ-んァ-ヶ]")))


def _once_lower(values: Column, k: int) -> Column:
    """Keeps the first of values that are equal but for case; at most k."""
    start = F.struct(F.array().cast("array<string>").alias("low"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(values, start, lambda s, x: F.when(F.array_contains(s["low"], F.lower(x)) | (F.trim(x) == ""), s).otherwise(F.struct(F.concat(s["low"], F.array(F.lower(x))).alias("low"), F.concat(s["out"], F.array(F.trim(x))).alias("out"))), lambda s: s["out"])
    return F.slice(kept, 1, k)


def diagram_signals(docs: DataFrame) -> DataFrame:
    """Docs with text of recognised lines: external, zone, device, redundancy, identifier (arrays) and inferences."""
    kept = [c for c in docs.columns if c != "text"]
    # a line beside its lower case, as each word of a list would make it again
    both = F.transform(clean_lines(F.coalesce("text", F.lit(""))), lambda x: F.struct(x.alias("t"), F.lower(x).alias("l")))
    rows = docs.select(*kept, both.alias("_lines"))

    def having(kind: str) -> Column:
        paired = (lambda x: (F.contains(x, F.lit("-")) | F.contains(x, F.lit("_"))) & x.rlike(PAIRED)) if kind == "device" else (lambda x: F.lit(False))
        found = F.filter("_lines", lambda x: has_any(x["l"], DIAGRAM_WORDS[kind]) | paired(x["t"]))
        return _once_lower(F.transform(found, lambda x: x["t"]), DIAGRAM_CAPS.get(kind, 8))

    rows = rows.withColumns({k: having(k) for k in DIAGRAM_WORDS}).withColumn("identifier", _once_lower(F.flatten(F.transform("_lines", lambda x: network_identifiers(x["t"]))), DIAGRAM_CAPS["identifier"]))
    stems = F.filter(F.transform("device", lambda x: F.lower(F.regexp_replace(F.regexp_extract(x, r"(?i)(.+?)[-_]?(?:0?1|0?2|a|b)\b", 1), "[^A-Za-z0-9一-龯ぁ-んァ-ヶ]+", ""))), lambda x: x != "")
    rows = rows.withColumns({"_blob": F.lower(F.array_join(F.concat("external", "zone", "device", "redundancy", "identifier"), "\n")), "_stems": stems})
    says = lambda *words: any_of([F.contains("_blob", F.lit(w)) for w in words])
    pairs = F.size(F.array_distinct("_stems")) < F.size("_stems")
    tests = {
        "boundary": (F.size("external") > 0) & says("fw", "firewall", "fortigate", "waf"),
        "dmz": F.exists("zone", lambda x: F.contains(F.lower(x), F.lit("dmz"))),
        "redundant": (F.size("redundancy") > 0) | pairs,
        "layered": says("core", "l3sw", "access"),
        "cloud_or_wan": says("aws", "azure", "gcp", "direct connect", "vpn", "閉域", "専用線"),
        "identifiers": F.size("identifier") > 0,
    }
    return rows.withColumn("inferences", F.filter(F.array(*[F.when(t, k) for k, t in tests.items()]), lambda x: x.isNotNull())).drop("_lines", "_blob", "_stems")
