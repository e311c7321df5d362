"""Profiles of review sets, from file names first, then from strong signals in the texts; modes of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import count_of, has_any
from inkveil.operators.rules import FORTIOS_SIGNALS, IOS_BEGINNING, IOS_SIGNALS
from inkveil.sources.scratch import materialised

# Names, words and extensions; order is priority.
NAME_WORDS = {
    "design": ("設計書", "設計仕様書", "設計仕様", "基本設計", "詳細設計", "仕様書", "design document", "design spec", "specification", "architecture"),
    "proposal": ("企画書", "提案書", "構想書", "概要書", "企画案", "提案資料", "proposal", "business plan", "project charter", "business case"),
    "network_config": (),
    "change_runbook": ("手順書", "作業手順書", "作業計画書", "変更計画書", "切替計画書", "切替手順書", "移行計画書", "移行手順書", "切戻し手順書", "リリース計画書", "runbook", "procedure", "work plan", "change plan", "cutover plan", "migration plan", "release plan"),
    "operations_runbook": ("運用手順", "運用設計", "保守手順", "監視手順", "障害対応手順", "運用要領", "日次運用", "インシデント対応", "operations runbook", "ops runbook", "maintenance procedure", "monitoring runbook", "incident response"),
}
PROFILES = (*NAME_WORDS, "source_code")
BODY_WORDS = {
    "change_runbook": ("タイムチャート", "タイムテーブル", "time chart", "schedule chart", "切戻し", "切り戻し", "ロールバック", "rollback", "backout", "fallback procedure", "go/no-go", "go no go", "gonogo", "進行可否判定", "続行判断"),
    "operations_runbook": ("エスカレーション", "on-call", "oncall"),
}
CONFIG_NAMES = ("running-config", "startup-config", "show running", "show_run", "show-run", "コンフィグ", "機器config", "機器設定")
PLATFORMS = ("cisco", "ios", "ios-xe", "iosxe", "fortigate", "fortinet", "fortios", "router", "switch", "firewall", "fw")
CONFIG_WORDS, CONFIG_SUFFIXES = ("config", "cfg", "conf", "設定"), (".cfg", ".conf", ".config")
CODE_SUFFIXES = (".py", ".ps1", ".psm1", ".psd1", ".sh", ".bash", ".bsh", ".ksh", ".zsh", ".vbs", ".vba", ".bas", ".cls", ".frm", ".sql", ".psql")
DESIGN_SUFFIXES = (".docx", ".xlsx", ".pptx", ".pdf", ".md", ".txt", ".csv", ".yaml", ".yml", ".json")
CODE_WORDS = ("def ", "class ", "import ", "from ", "try:", "except", "function ", "param(", "set -e", "#!/bin/", "#!/usr/bin/env", "invoke-", "write-output", "sub ", "end sub")
CODE_SIGNALS = ("def ", "class ", "import ", "from ", "try:", "except", "finally:", "function ", "param(", "#!/bin/", "#!/usr/bin/env", "set -e", "write-host", "write-output", "invoke-", "sub ", "end sub", "select case", "public function", "private sub", "createobject(", "os.system(", "subprocess.")
CODE_MARKS = ("{", "}", ";", "=>")
RISK_TERMS = ("systemctl restart", "reboot", "shutdown", "delete", "drop ", "truncate ", "rm -rf", "event.acknowledge", "housekeeper_execute", "mysql ", "update ", "障害イベント", "切り替え", "切替", "再起動", "削除")
STEP = r"(?mU)^\s*(?:\d+[.．、]|[①②③④⑤⑥⑦⑧⑨⑩]|・)\s*"
LIGHT_CHARS, FORMAL_CHARS = 9000, 14000
# End of the fixed values.
HEAD = 1500


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"(\.[^.]*)$", 1)


def name_profile(name: Column) -> Column:
    """The first profile whose words a file name has; a change runbook's words come before operations'."""
    return _name_profile(F.lower(F.coalesce(name, F.lit(""))))


def _name_profile(n: Column) -> Column:
    has = lambda words: has_any(n, words)
    config = has(CONFIG_NAMES) | (has(PLATFORMS) & has(CONFIG_WORDS)) | (suffix_of(n).isin(*CONFIG_SUFFIXES) & has(PLATFORMS))
    out = None
    for profile, words in NAME_WORDS.items():
        test = config if profile == "network_config" else has(words)
        out = F.when(test, profile) if out is None else out.when(test, profile)
    return out


def _number_of(low: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def looks_like_code(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    words, marks = (_number_of(low, found) for found in (CODE_SIGNALS, CODE_MARKS))
    return (words >= 2) | ((words >= 1) & (marks >= 2))


def _with_head(docs: DataFrame) -> DataFrame:
    """docs with _h, the name and the first characters in lower case, and _b, whether IOS signals may be in it: columns, as a list of words would make them again for each word."""
    head = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, HEAD)))
    return docs.withColumn("_h", head).withColumn("_b", F.col("_h").rlike(IOS_BEGINNING))


def _signals() -> dict[str, Column]:
    """Tests on what ``_with_head`` adds."""
    flags = {f"i{k}": F.col("_b") & F.col("_h").rlike(p) for k, p in enumerate(IOS_SIGNALS)} | {f"f{k}": F.contains("_h", F.lit(s)) for k, s in enumerate(FORTIOS_SIGNALS)}
    flags |= {p: has_any(F.col("_h"), words) for p, words in BODY_WORDS.items()}
    return flags | {"code": has_any(F.col("_h"), CODE_WORDS)}


def body_signals(docs: DataFrame) -> DataFrame:
    """A13 per document: flags of single signals in the first 1500 characters and the name; sets gather them with or."""
    rows = _with_head(docs.select("review_id", "name", "text"))
    return rows.select("review_id", "name", "text", *[v.alias(k) for k, v in _signals().items()])


def _gathered(docs: DataFrame) -> DataFrame:
    """What profiles and modes need of each set. Each text is made and lowered once; a set's tests are bits of one number, so that a document is one short row in the shuffle."""
    rows = docs.select("review_id", "name", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("name", F.lit("")).alias("_f"))
    rows = _with_head(rows).withColumns({"_n": F.lower("_f"), "_l": F.lower("text")}).withColumns({"_w": _number_of(F.col("_l"), CODE_SIGNALS), "_e": suffix_of(F.col("_n"))})
    named = F.col("_f") != ""
    tests = _signals() | {"has_name": named, "no_code_file": named & ~F.col("_e").isin(*CODE_SUFFIXES), "no_design_file": named & ~F.col("_e").isin(*DESIGN_SUFFIXES), "risky": has_any(F.col("_l"), RISK_TERMS)}
    bits = {name: F.lit(1 << k).cast("long") for k, name in enumerate(tests)}
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, bits[name]).otherwise(F.lit(0).cast("long")) for name, test in tests.items()])
    like_code = (F.col("_w") >= 2) | ((F.col("_w") >= 1) & (_number_of(F.col("_l"), CODE_MARKS) >= 2))
    rows = rows.select("review_id", mask.alias("mask"), like_code.alias("like_code"), _name_profile(F.col("_n")).alias("named"), F.length("text").alias("chars"), F.regexp_count("text", F.lit(STEP)).alias("steps"))
    sets = rows.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("like_code").alias("n_code"), F.bit_or("mask").alias("mask"), F.sum("chars").alias("chars"), F.sum("steps").alias("steps"),
        *[F.count_if(F.col("named") == p).alias(f"n_{p}") for p in NAME_WORDS],
    )
    sets = sets.select("*", *[(F.col("mask").bitwiseAND(bit) != 0).alias(name) for name, bit in bits.items()])
    return sets.withColumns({"code_files": ~F.col("no_code_file"), "design_files": ~F.col("no_design_file")}).drop("mask", "no_code_file", "no_design_file")


def classify_review_set(docs: DataFrame, forced: str | None = None, strict_code: bool = False) -> DataFrame:
    """P1. docs: review_id, name, text. review_id, document_profile, confidence, reason.

    Code words are looked for as they stand (any prose with "from " is code); ``strict_code`` asks for two signals in a document instead.
    """
    if forced and forced.strip().lower() in PROFILES:
        return docs.select("review_id").distinct().select("review_id", F.lit(forced.strip().lower()).alias("document_profile"), F.lit("forced").alias("confidence"), F.lit("forced").alias("reason"))
    return _profiles(materialised(_gathered(docs)), strict_code).select("review_id", "document_profile", "confidence", "reason")


def _profiles(sets: DataFrame, strict_code: bool = False) -> DataFrame:
    """sets, as ``_gathered`` makes them, with document_profile, confidence and reason."""
    config = (count_of([F.col(f"i{k}") for k in range(len(IOS_SIGNALS))]) >= 2) | (count_of([F.col(f"f{k}") for k in range(len(FORTIOS_SIGNALS))]) >= 2)
    by_name = F.filter(F.array(*[F.when(F.col(f"n_{p}") > 0, p) for p in NAME_WORDS]), lambda x: x.isNotNull())
    by_body = F.filter(F.array(F.when(config, "network_config"), *[F.when(F.col(p), p) for p in BODY_WORDS]), lambda x: x.isNotNull())
    # most files first, then priority
    most = F.array_max(F.array(*[F.struct(F.col(f"n_{p}").alias("n"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(NAME_WORDS)]))["p"]
    sets = sets.withColumn("names", by_name).withColumn("bodies", by_body).withColumn("most", most)
    code = (F.col("n_code") > 0) if strict_code else F.col("code")
    first_name, first_body = F.get("names", F.lit(0)), F.get("bodies", F.lit(0))
    cases = [
        (F.col("has_name") & F.col("code_files"), F.lit("source_code"), F.lit("high"), "code_files"),
        (code, F.lit("source_code"), F.when(F.col("n_code") == F.col("n"), "high").otherwise("medium"), "code_words"),
        (F.size("names") >= 2, F.col("most"), F.lit("conflict"), "several_names"),
        ((F.size("names") > 0) & (F.size("bodies") > 0) & (first_name != first_body), first_name, F.lit("conflict"), "name_against_body"),
        (F.size("names") > 0, first_name, F.lit("high"), "name"),
        (F.size("bodies") > 0, first_body, F.lit("medium"), "body"),
        (F.col("has_name") & F.col("design_files") & (F.col("n_code") == 0), F.lit("design"), F.lit("medium"), "extension"),
    ]

    def told(which: int, otherwise: str) -> Column:
        out = None
        for case in cases:
            value = F.lit(case[which]) if which == 3 else case[which]
            out = F.when(case[0], value) if out is None else out.when(case[0], value)
        return out.otherwise(otherwise)

    return sets.withColumns({"document_profile": told(1, "design"), "confidence": told(2, "low"), "reason": told(3, "default")})


def _moded(sets: DataFrame) -> DataFrame:
    profile = F.col("document_profile")
    mode = F.when(profile == "source_code", "code").when(profile == "network_config", "config").when(profile.isin("change_runbook", "operations_runbook"), "runbook").otherwise("document")
    depth = F.when((F.col("chars") <= LIGHT_CHARS) & (F.col("steps") >= 2), F.when(F.col("risky"), "light_high_risk").otherwise("light")).when(F.col("risky") & (F.col("chars") <= FORMAL_CHARS), "light_high_risk").otherwise("formal")
    return sets.withColumn("mode", mode).withColumn("depth", F.when(F.col("mode") == "runbook", depth))


def artifact_mode(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """review_id, mode (code, config, runbook or document) and, for runbooks, depth."""
    rows = docs.select("review_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_l", F.lower("text"))
    sizes = rows.groupBy("review_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(STEP))).alias("steps"), F.bool_or(has_any(F.col("_l"), RISK_TERMS)).alias("risky"))
    return _moded(profiles.join(sizes.hint("merge"), "review_id")).select("review_id", "document_profile", "mode", "depth")


def classified_modes(docs: DataFrame, strict_code: bool = False) -> DataFrame:
    """P1 and P16 in one pass over the texts, without a join: review_id, document_profile, mode, depth, confidence, reason. Rows without a review_id belong to no set."""
    sets = _gathered(docs.filter(F.col("review_id").isNotNull()))
    return _moded(_profiles(sets, strict_code)).select("review_id", "document_profile", "mode", "depth", "confidence", "reason")
