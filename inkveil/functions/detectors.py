"""Detectors for sensitive values: one ordered table, in which every rule is data.

Patterns are Java regular expressions. ``U`` makes classes and boundaries Unicode-aware, ``d`` leaves only
line feeds as line ends. Rules of one list run in order on text that earlier rules already masked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories, patterns, words and the placeholder format are what the results are defined by.
PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*_\d+\]"
APPROVED = ("SECRET", "IPV4", "IPV6", "EMAIL", "MAC", "HOSTNAME", "COMPANY", "PROJECT", "TICKET", "PERSON", "URL", "SITE", "DEVICE", "GENERIC_IDENTIFIER")
DEVICE_WORDS = ("rtr", "fw", "sw", "lb", "nlb", "alb", "gw", "vpn", "ips", "ids", "wlc", "ap", "srv", "vm", "host", "node", "app", "web", "api", "bat", "db", "nas", "san", "bk", "dr")
COMPANY_EN = "customer(?:-name)?|client|company(?:-name)?|organization|vendor"
COMPANY_JA = "顧客名|お客様名|会社名|企業名|ベンダ(?:名)?|委託先"
PROJECT_EN = "project(?:-name)?|system(?:-name)?|service(?:-name)?"
PROJECT_JA = "案件名|プロジェクト名|システム名|サービス名"
TICKET_EN = r"change-id|change\s*no|ticket|incident|request-id"
TICKET_JA = "変更番号|申請番号|案件番号|回線番号|契約番号"
PERSON_EN = "owner|contact|manager"
PERSON_JA = "担当者|連絡先|申請者|責任者"
SECRET = r"(?imdU)\b(password|secret|community|token|apikey|api_key|key)\b\s*[:= ]+\s*([^\s,;]+)"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = (
    r"(?U)(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,2}|(?:[0-9A-Fa-f]{1,4}:){1,4}(?::[0-9A-Fa-f]{1,4}){1,3}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,3}(?::[0-9A-Fa-f]{1,4}){1,4}|(?:[0-9A-Fa-f]{1,4}:){1,2}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?:(?::[0-9A-Fa-f]{1,4}){1,7}|:))(?![\w:])"
)
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MAC = r"(?U)\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"
HOSTNAME_LABEL = r"(?imdU)\b(hostname|device-name|system-name)\b\s*[:= \t]+\s*([A-Za-z0-9_.-]+)"
HOSTNAME_BARE = rf"(?iU)\b(?:[A-Za-z][A-Za-z0-9]*[-_.])?(?:{'|'.join(DEVICE_WORDS)})[-_.]\d{{1,5}}\b"
URL = r"(?U)\bhttps?://[^\s)]+"
MARKERS = (
    r"(?imdU)\b(confidential|strictly confidential|internal use only|proprietary)\b",
    "社外秘|部外秘|機密|極秘|取扱注意|社内限定|関係者限り",
)
LEGAL_ENTITY = r"(?U)株式会社[^\s、,.;:]{1,40}|[^\s、,.;:]{1,40}(?:株式会社|有限会社)|\b[A-Z][A-Za-z0-9&.,' -]{1,40}\s(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Co\.?)\b"
NETWORK_ID = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b|(?i)\bVLAN\s*[-:]?\s*\d{1,4}\b|(?i)\bVRF\s*[-:]?\s*[A-Za-z0-9_-]+"
PUBLIC_TERMS = (
    r"(?:Amazon|AWS)\s+[A-Za-z0-9][A-Za-z0-9 ./\-]{0,40}(?:\s+(?:[A-Za-z]{2,}|メール|エンドポイント|レコード|サービス|フロー(?:ログ)?|バケット|ゲートウェイ|プロトコル))?",
    r"(?:SES|S3|EC2|VPC|VIF|VPN|SNS|SQS|IAM|RDS|EBS|ELB|ALB|NLB|KMS|ACM|WAF|CloudWatch|CloudFront|CloudTrail|CloudShell|Route\s*53|Lambda|EventBridge|GuardDuty|Config|Athena|Firehose|Backlog|AMS|Direct\s*Connect(?:\s+Gateway)?|(?:Private|Public)\s+VIF)(?:\s+(?:メール|エンドポイント|レコード|サービス|SMTP(?:\s+VPC\s+エンドポイント)?|VPC(?:\s+エンドポイント)?|フロー(?:ログ)?|バケット|ゲートウェイ))?",
    r"(?:SMTP(?:S)?|IMAP|POP3|HTTP|HTTPS|TLS|SSL|SSH|FTP|SFTP|NTP|DNS|DKIM|DMARC|SPF|MX|AUTH|BGP|OSPF|VRRP|HSRP|VLAN|NAT|ACL|CIDR|IPv4|IPv6|TCP|UDP|ICMP|IPSec|IPSEC|RADIUS|LDAP|OAuth2?|SAML|JWT|JSON|XML|YAML)(?:\s+(?:AUTH|レコード|エンドポイント|プロトコル|サービス))?",
    r"(?:VPC|DNS|DC|AZ|MFA|RBAC|ABAC|SLA|SLO|SLI|SOC|RPO|RTO|API|CLI|GUI|SDK|UI|UX|CSV|TSV|TIFF|JPEG|PNG|GIF|PDF|AWS|GCP|OCI|Azure|Amazon)",
    r"[a-z]{1,3}=[A-Za-z][A-Za-z0-9_\-]*",
    r"(?:パブリッククラウド(?:サービス)?|フルマネージドサービス|オンプレミス(?:環境)?|プライベートサブネット|パブリックサブネット|VPC\s*フローログ|フロー(?:ログ|ログ用バケット)?|デフォルト|フェーズ|用途|方法|フローログ用バケット標準\s*VPC\s*フローログ?)",
    r"\d+(?:\.\d+){0,3}\s+[぀-ヿ一-鿿]{1,8}",
    r"[\|　\s'`\"]+[A-Za-z0-9 ]{0,4}",
)
PUBLIC_TERM = rf"(?iU)^\s*(?:{'|'.join(f'(?:{p})' for p in PUBLIC_TERMS)})\s*$"
UNAPPROVED = (r"<[A-Z][A-Z0-9_]{2,}>", r"\*{3,}", r"(?i)\[REDACTED[^\]]*\]", r"(?i)\[MASKED[^\]]*\]", r"\{\{[^}]+\}\}")
# End of the fixed values.

IDENTIFYING = ("company", "project", "ticket", "person")


def label_pattern(english: str, japanese: str) -> str:
    """Keyword (English ones at a line's start only), an explicit separator, and a value that stops at punctuation."""
    return rf"(?imdU)(^[ \t]*(?:{english})|(?:^|\b)(?:{japanese}))\b\s*[:=：]+\s*([^\r\n,;、；。]{{2,80}})"


@dataclass(frozen=True)
class Detector:
    """value: the group that is the value (0: the whole match). guarded: public terms are left alone.

    marks and shape are what every match has: one of these strings, and what this cheaper pattern finds. Texts without them are not searched.
    """

    rule: str
    category: str
    pattern: str
    value: int = 0
    guarded: bool = False
    marks: tuple[str, ...] = ()
    shape: str = ""

    def found_in(self, text: Column) -> Column:
        there = text.rlike(self.pattern)
        if self.shape:
            there = text.rlike(self.shape) & there
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in self.marks]) & there if self.marks else there


LABEL_MARKS = (":", "=", "：")
DETECTORS = (
    Detector("D1", "secret", SECRET, 2),
    Detector("D2", "ipv4", IPV4, marks=(".",)),
    Detector("D3", "ipv6", IPV6, marks=(":",), shape=r"::|:[0-9A-Fa-f]{1,4}:"),
    Detector("D4", "email", EMAIL, marks=("@",)),
    Detector("D5", "mac", MAC, marks=(":", "-"), shape=r"(?:[0-9A-Fa-f]{2}[:-]){5}"),
    Detector("D6", "hostname", HOSTNAME_LABEL, 2),
    Detector("D7", "hostname", HOSTNAME_BARE, marks=("-", "_", "."), shape=r"(?U)[A-Za-zİıſK][-_.]\d"),
    Detector("D8", "company", label_pattern(COMPANY_EN, COMPANY_JA), 2, True, LABEL_MARKS),
    Detector("D9", "project", label_pattern(PROJECT_EN, PROJECT_JA), 2, True, LABEL_MARKS),
    Detector("D10", "ticket", label_pattern(TICKET_EN, TICKET_JA), 2, True, LABEL_MARKS),
    Detector("D11", "person", label_pattern(PERSON_EN, PERSON_JA), 2, True, LABEL_MARKS),
    Detector("D12", "url", URL, marks=("://",)),
)


def with_patterns(extra: list[tuple[str, str]], detectors: tuple[Detector, ...] = DETECTORS) -> tuple[Detector, ...]:
    """Adds caller-supplied (category, pattern) rows behind the others."""
    return (*detectors, *(Detector(f"X{i + 1}", c, p) for i, (c, p) in enumerate(extra)))


def detector_table(spark: SparkSession, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    return spark.createDataFrame([(i, d.rule, d.category, d.pattern, d.value, d.guarded) for i, d in enumerate(detectors)], "rule_ord int, rule string, category string, pattern string, value_group int, guarded boolean")


def found_values(text: Column, detector: Detector) -> Column:
    """All values of one detector in a text, as they stand."""
    return F.when(detector.found_in(text), F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(detector.value))).otherwise(F.array().cast("array<string>"))


def mentions(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, text: str = "text") -> DataFrame:
    """One row per value found in the raw text: all columns but the text, rule, category, pos, value."""
    kept = [c for c in docs.columns if c != text]

    def rows(d: Detector) -> Column:
        return F.transform(found_values(F.col(text), d), lambda v, i: F.struct(F.lit(d.rule).alias("rule"), F.lit(d.category).alias("category"), i.alias("pos"), v.alias("value")))

    found = [rows(d) for d in detectors]
    return docs.select(*kept, F.explode(F.concat(*found)).alias("m")).select(*kept, "m.*")


def mention_counts(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, text: str = "text") -> DataFrame:
    """One row per text and category found in it: all columns but the text, category, n. They are counted beside the text, so nothing is shuffled."""
    kept = [c for c in docs.columns if c != text]
    sizes: dict[str, list[Column]] = {}
    for d in detectors:
        sizes.setdefault(d.category, []).append(F.coalesce(F.size(found_values(F.col(text), d)), F.lit(0)))
    listed = F.array(*[F.struct(F.lit(c).alias("category"), reduce(lambda a, b: a + b, n).cast("long").alias("n")) for c, n in sizes.items()])
    # an outer explode: for an inner one Spark filters by the counts before, and finds them twice for that
    return docs.select(*kept, F.explode_outer(F.filter(listed, lambda x: x["n"] > 0)).alias("m")).select(*kept, "m.*").filter("n is not null")


def has_marker(text: Column, low: Column | None = None) -> Column:
    """A confidentiality marker in the text. low: a column with the text as ``folded`` makes it; with it, the pattern is only for texts that have its words."""
    from inkveil.functions.text import has_any  # it reads this module

    english = text.rlike(MARKERS[0])
    if low is not None:
        english = has_any(low, ("confidential", "internal use only", "proprietary")) & english
    return english | has_any(text, MARKERS[1].split("|"))


def has_legal_entity(text: Column) -> Column:
    """D14. The pattern looks forty characters ahead everywhere; it is for texts that have one of its names."""
    named = F.contains(text, F.lit("株式会社")) | F.contains(text, F.lit("有限会社")) | text.rlike(r"(?U)\s(?:Inc|Corp|LLC|Ltd|Co)\b")
    return named & text.rlike(LEGAL_ENTITY)


def network_identifiers(text: Column) -> Column:
    """Addresses, VLANs and VRFs, each once, in order."""
    none = ~(F.contains(text, F.lit(".")) | text.rlike("(?i)v(?:lan|rf)"))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(NETWORK_ID), F.lit(0))))


def public_term(value: Column) -> Column:
    """the whole value is a widely public term."""
    return value.rlike(PUBLIC_TERM)
