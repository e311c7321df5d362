"""Queries in which every branch of an operator acts: what a document is given hangs on its id, and the SQL says what must come of it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import detectors
from inkveil.operators import dictionary, remediation, replies, rules
from inkveil.plans import tables as T
from inkveil.plans.kinds import _CONFIGS
from inkveil.plans.oracles import _text
from inkveil.plans.queries import query
from inkveil.sources import files
from inkveil.sources.scratch import scratch_dir


def _pick(values: Sequence[str | None], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _picked(values: Sequence[str | None], by: str) -> str:
    """The same in SQL."""
    return "CASE " + by + f" % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else _text(v).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}" for k, v in enumerate(values)) + " END"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/part-{uuid.uuid4().hex}"


# name, text, language
_LANGUAGES = (
    ("a.sh", "x", "shell"), ("a.bash.txt", "x", "shell"), ("b.PS1", "x", "powershell"), ("c.sql", "x", "sql"), ("d.py", "select 1", "python"), ("e.py.txt", "x", "python"), ("f", "#!/bin/bash\nx", "shell"), ("g", "  #!/usr/bin/env python3\nx", "python"),
    ("h.txt", "Param(\n$x)", "powershell"), ("i.txt", "$ErrorActionPreference = 1", "powershell"), ("j.txt", "x\nasync def run(a):", "python"), ("k.txt", "x\n  UPDATE t set a = 1", "sql"), ("l.txt", "x\nset -u", "shell"), ("m.txt", "x | awk 1", "shell"), ("n.txt", "plain", "generic"), (None, None, "generic"),
)


@query(f"SELECT doc_id, {_picked([x[2] for x in _LANGUAGES], 'doc_id')} AS language FROM documents")
def n9_code_languages(spark, sf_dir):
    """Languages by suffix, first line and content, the first rule that fits."""
    k = F.col("doc_id")
    text = F.concat(_pick([x[1] for x in _LANGUAGES], k), F.lit("\n"), F.col("n_chars").cast("string"))
    return T.table(spark, sf_dir, "documents").select("doc_id", rules.code_language(_pick([x[0] for x in _LANGUAGES], k), text).alias("language"))


# details, what they say of the present state
_STATES = (
    ("【現状】 no  plan\n【影響】 late", "no plan"), ("x\n【現状】a\nb\n【推奨対応】 c", "a b"), ("現状: only prose\nnext", "only prose"), ("x\n 現状の記載：none yet", "none yet"), ("nothing of it", None), ("【現状】 alone", "alone"),
)


@query(f"SELECT doc_id, {_picked([x[1] for x in _STATES], 'doc_id')} AS state FROM documents")
def n6_current_states(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", remediation.current_state(_pick([x[0] for x in _STATES], F.col("doc_id"))).alias("state"))


# origin of the issue, evidence; line, basis, confidence
_EVIDENCE = (
    ("static_code_analysis", "run 内 / 4行目付近: x", "4", "static", "high"), ("initial", "12 行目付近", "12", "line", "medium"), ("initial", "somewhere", "", "model", "low"), ("initial", None, "", "model", "low"), ("static_code_analysis", "", "", "static", "high"),
)


@query(f"SELECT doc_id, {_picked([x[2] for x in _EVIDENCE], 'doc_id')} AS line, {_picked([x[3] for x in _EVIDENCE], 'doc_id')} AS basis, {_picked([x[4] for x in _EVIDENCE], 'doc_id')} AS confidence FROM documents")
def n11_evidence(spark, sf_dir):
    """The line that an evidence tells, how a finding is known, and how sure it is."""
    k = F.col("doc_id")
    said = _pick([x[1] for x in _EVIDENCE], k)
    basis = remediation.evidence_basis(_pick([x[0] for x in _EVIDENCE], k), said)
    return T.table(spark, sf_dir, "documents").select("doc_id", remediation.evidence_line(said).alias("line"), basis.alias("basis"), remediation.confidence(basis).alias("confidence"))


# text, purpose
_PURPOSES = (
    ("1. 目的：守ること\nx", "守ること"), ("# 本書の目的\n一\n二\n三\n四", "一 二 三"), ("x\n本資料は設計を述べる。次", "本資料は設計を述べる。"), ("only  words", "only words"), ("\n目的\n\n  先 の行\n", "先 の行"),
)


@query(f"SELECT doc_id AS review_id, {_picked([x[1] for x in _PURPOSES], 'doc_id')} AS purpose FROM documents")
def n7_purposes(spark, sf_dir):
    """Purposes on a heading's line, under a heading, in a sentence about the document, or its beginning."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.lit(0).alias("doc_ord"), F.lit("d").alias("name"), _pick([x[0] for x in _PURPOSES], F.col("doc_id")).alias("text"))
    none = T.issues(spark, sf_dir).filter("false")
    return replies.local_summary(docs, none).select("review_id", "purpose")


# lines of a diagram, whether two of its devices are a pair
_DEVICES = (
    ("core-sw-01\ncore-sw-02", True), ("edge-fw-a\nedge-fw-b", True), ("core-sw-01\nedge-fw-02", False), ("router rt01", False), ("web_01 web\nWEB_02 web", True), ("冗長化\nrouter", True), ("nothing", False),
)


@query("SELECT doc_id, " + " OR ".join(f"doc_id % {len(_DEVICES)} = {k}" for k, x in enumerate(_DEVICES) if x[1]) + " AS redundant FROM documents")
def w14_device_pairs(spark, sf_dir):
    """Devices that differ by 01 and 02 or a and b alone are a pair, which tells of redundancy."""
    lines = T.table(spark, sf_dir, "documents").select("doc_id", _pick([x[0] for x in _DEVICES], F.col("doc_id")).alias("text"))
    return rules.diagram_signals(lines).select("doc_id", F.array_contains("inferences", "redundant").alias("redundant"))


# title of a claim, whether the document (which defines run) refutes it
_CLAIMS = (
    ("Syntax Error in line 3", True), ("構文エラー", True), ("No source code given", True), ("プレースホルダのまま", True), ("[SECRET_001] is odd", True), ("run is not defined", True), ("other is undefined", False), ("no timeout", False),
)


@query("SELECT doc_id AS review_id, " + _picked([x[0] for x in _CLAIMS], "doc_id") + " AS title FROM documents WHERE NOT (" + " OR ".join(f"doc_id % {len(_CLAIMS)} = {k}" for k, x in enumerate(_CLAIMS) if x[1]) + ")")
def j17_refuted_claims(spark, sf_dir):
    """Claims that a document refutes go: of syntax, of missing source, of marks of masking, of functions undefined that it defines."""
    d = T.table(spark, sf_dir, "documents")
    issues = d.select(F.col("doc_id").alias("review_id"), F.lit("job.py").alias("source_document"), _pick([x[0] for x in _CLAIMS], F.col("doc_id")).alias("title"), F.lit("").alias("details"), F.lit("").alias("recommendation"))
    docs = d.select(F.col("doc_id").alias("review_id"), F.lit("job.py").alias("name"), F.concat(F.lit("def run(a):\n    return "), F.col("n_chars").cast("string")).alias("text"))
    return replies.against_facts(issues, docs).select("review_id", "title")


@query("""SELECT doc_id AS review_id, 'first' AS origin, quality AS mark, NULL::VARCHAR AS section FROM documents JOIN labels USING (doc_id) UNION ALL
SELECT doc_id, 'document', toxic, NULL FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id, 'chapter', quality, 'ch' || (doc_id % 5) FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def u3_issues_of_three_passes(spark, sf_dir):
    """Issues of a first pass, of a second one on documents and of a third one on chapters, told apart."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id").join(T.table(spark, sf_dir, "labels").hint("merge"), "doc_id").withColumnRenamed("doc_id", "review_id")
    document = rows.filter("toxic = 1").select("review_id", F.col("toxic").alias("mark"))
    chapter = rows.filter("quality = 0").select("review_id", F.col("quality").alias("mark"), F.concat(F.lit("ch"), (F.col("review_id") % 5).cast("string")).alias("section"))
    first = rows.select("review_id", F.col("quality").alias("mark"), F.lit(None).cast("string").alias("section"))
    return replies.with_origins(first=first, document=document, chapter=chapter).select("review_id", "origin", "mark", "section")


@query("""SELECT c_custkey AS review_id, CASE WHEN c_custkey % 3 = 1 THEN '  ' ELSE 'NATION_' || c_nationkey END AS text, c_custkey % 3 < 2 AS sure FROM customer""")
def u5_promoted_candidates(spark, sf_dir):
    """Confirmed candidates, and those whose lookup failed (empty names here), if so wanted; others stay uncertain."""
    k = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select(k.alias("review_id"), F.when(k % 3 == 1, "  ").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("text"), (k % 3 == 0).alias("confirmed"))
    lookups = dictionary.registry_lookup(rows, T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    sure, rest = dictionary.split_candidates(rows, lookups, promote_errors=True)
    return sure.select("review_id", "text", F.lit(True).alias("sure")).unionAll(rest.select("review_id", "text", F.lit(False)))


@query(f"""WITH c AS ({_CONFIGS}) SELECT name, 'cisco_ios' AS vendor, list_transform(regexp_extract_all(text, '(?m)^interface (.+)$', 1), lambda x: trim(x)).list_distinct().list_sort() AS interface_names, ['OSPF'] AS routing_signals, 0 AS policy_count FROM c""")
def a15_all_of_a_configuration(spark, sf_dir):
    """Vendor, interfaces, routing and policies of each configuration."""
    found = rules.config_profile(T.configs(spark, sf_dir).select("name", "text"))
    return found.select("name", "vendor", F.array_sort("interface_names").alias("interface_names"), "routing_signals", "policy_count")


@query("""WITH p AS (SELECT l_orderkey AS k, list_sort(list_distinct(list('port' || l_linenumber))) AS ports, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT k, CASE WHEN k % 3 = 0 THEN 'mixed_or_unknown' ELSE 'fortinet_fortios' END AS vendor, CASE WHEN k % 3 = 0 THEN list_append(ports, 'vlan 10') ELSE ports END AS interface_names,
CASE WHEN k % 3 = 0 THEN ['BGP', 'OSPF', 'static route'] ELSE ['BGP', 'static route'] END AS routing_signals, CAST(n AS INTEGER) AS policy_count FROM p""")
def a15_firewalls(spark, sf_dir):
    """A15 on firewalls with interfaces, routing and policies, a third of them with router lines too."""
    n = F.col("l_linenumber").cast("string")
    body = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('    edit "port'), n, F.lit('"\n    next')))), "\n").alias("ports"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    edit "), n, F.lit("\n        set srcintf a\n    next")))), "\n").alias("policies"),
    )
    router = F.when(F.col("k") % 3 == 0, F.lit("interface vlan 10\nrouter ospf 1\nline vty 0 4"))
    text = F.concat_ws("\n", F.lit("config system interface"), "ports", F.lit("end\nconfig firewall policy"), "policies", F.lit("end\nconfig router static\nend\nconfig router bgp\nend"), router)
    found = rules.config_profile(body.select("k", text.alias("text")))
    return found.select("k", "vendor", F.array_sort("interface_names").alias("interface_names"), F.array_sort("routing_signals").alias("routing_signals"), "policy_count")


@query("""WITH k AS (SELECT event_id AS k, floor(event_id / 20)::BIGINT AS s FROM events),
f AS (SELECT s, k, 0 AS r, 'ハードコードされた認証情報の疑い' AS title, 'high' AS severity FROM k WHERE k % 3 = 0 UNION ALL SELECT s, k, 1, '危険なコマンド実行の可能性', 'high' FROM k WHERE k % 7 = 0)
SELECT 'SC-' || lpad((row_number() OVER (PARTITION BY s ORDER BY k, r))::VARCHAR, 3, '0') AS issue_id, s AS review_id, k % 20 AS doc_ord, severity, title FROM f
UNION ALL SELECT 'SC-001', s, 0, 'info', 'No major issue found in mock review' FROM k GROUP BY s HAVING s NOT IN (SELECT s FROM f)""")
def p8_scripts(spark, sf_dir):
    """Scripts through the rule review; numbers by place in the set, and one row for a set without issues."""
    k = F.col("event_id")
    text = F.concat_ws("\n", F.lit("def run():"), F.when(k % 3 == 0, '    password = "abc123"'), F.when(k % 7 == 0, "    os.system(cmd)"), F.lit("    return 1"))
    docs = T.table(spark, sf_dir, "events").select(F.floor(k / 20).alias("review_id"), (k % 20).cast("int").alias("doc_ord"), F.lit("job.py").alias("name"), text.alias("text"), F.lit("source_code").alias("document_profile"))
    return rules.rule_review(docs).select("issue_id", "review_id", F.col("doc_ord").cast("long").alias("doc_ord"), "severity", "title")


@query(f"""WITH c AS ({_CONFIGS}), k AS (SELECT CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS k FROM c)
SELECT title, severity, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN k % 5 = 0 THEN {{'title': 'Telnetによる管理アクセスの可能性', 'severity': 'high'}} END, CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN {{'title': 'enable password の利用', 'severity': 'high'}} END,
  CASE WHEN k % 7 = 0 THEN {{'title': 'SNMP community string の利用', 'severity': 'high'}} END], lambda x: x IS NOT NULL), recursive := true) FROM k) GROUP BY ALL""")
def p8_configurations(spark, sf_dir):
    """Configurations through the rule review: the findings of three of its rules."""
    docs = T.configs(spark, sf_dir).withColumn("document_profile", F.lit("network_config"))
    found = rules.rule_review(docs).filter("issue_id like 'NC-%'")
    return found.filter(F.col("title").isin("Telnetによる管理アクセスの可能性", "enable password の利用", "SNMP community string の利用")).groupBy("title", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS review_id, doc_id % 19 = 0 AS failed FROM documents JOIN labels USING (doc_id)),
i AS (SELECT review_id, doc_id, unnest([1, 2]) AS item FROM r WHERE NOT failed)
SELECT review_id, 'doc' || doc_id AS doc, 'I-' || lpad((row_number() OVER (PARTITION BY review_id ORDER BY doc_id, item))::VARCHAR, 3, '0') AS issue_id, 'issue ' || item AS title FROM i""")
def p21_merged_issues(spark, sf_dir):
    """Issues of all replies of a set, numbered after they are merged; failed replies give none."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id").join(T.table(spark, sf_dir, "labels").select("doc_id").hint("merge"), "doc_id")
    told = rows.select(F.floor(F.col("doc_id") / 20).alias("review_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc"), F.col("doc_id").cast("int").alias("doc_ord"), (F.col("doc_id") % 19 == 0).alias("failed"))
    reply = F.lit('{"issues": [{"severity": "high", "title": "issue 1", "issue": "a"}, {"severity": "low", "title": "issue 2", "issue": "b"}]}')
    parsed = replies.parse_issues(told.select("review_id", "doc", reply.alias("reply")))
    return replies.combine_reviews(parsed, told)[0].select("review_id", "doc", "issue_id", "title")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '%%' || coalesce(text, '') ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 3 = 2 THEN 'base64 could not be decoded' END AS warning FROM documents""")
def s2_uploads(spark, sf_dir):
    """Uploads as text and as base64; what is no base64 is taken as it is, with a warning."""
    k, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    content = F.when(k % 3 == 0, text).when(k % 3 == 1, F.base64(F.encode(text, "UTF-8"))).otherwise(F.concat(F.lit("%%"), text))
    data, warning = files.upload_content(content, F.when(k % 3 == 0, "text").otherwise("base64"))
    return T.table(spark, sf_dir, "documents").select("doc_id", files.decoded(data).alias("text"), warning.alias("warning"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') WHEN doc_id % 4 = 1 THEN '設計書 ' || doc_id ELSE '設計 ' || coalesce(text, '') END AS text FROM documents""")
def s1_encodings(spark, sf_dir):
    """Bytes of UTF-8, cp932 and UTF-16, and of UTF-8 behind a mark, are all read as they were written."""
    k, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    marked = F.concat(F.lit("﻿設計 "), text)
    # 設計書 in cp932
    japanese = F.concat(F.unhex(F.lit("90DD8C768F91")), F.encode(F.concat(F.lit(" "), k.cast("string")), "US-ASCII"))
    data = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, japanese).when(k % 4 == 2, F.encode(marked, "UTF-8")).otherwise(F.encode(F.concat(F.lit("設計 "), text), "UTF-16"))
    return T.table(spark, sf_dir, "documents").select("doc_id", files.decoded(data).alias("text"))


@query("""WITH d AS (SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS review_id, text FROM documents)
SELECT 'sanitized_text' AS part, review_id, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS size FROM d GROUP BY ALL UNION ALL SELECT 'mask_candidates', review_id, count(*), CAST(sum(length('name ' || doc_id)) AS BIGINT) FROM d GROUP BY ALL
UNION ALL SELECT 'send_log', review_id, count(*), CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM d GROUP BY ALL UNION ALL SELECT 'review_result', review_id, count(*), CAST(sum(length('issue ' || doc_id)) AS BIGINT) FROM d GROUP BY ALL""")
def s14_all_four_tables(spark, sf_dir):
    """The four tables of a review, written and read back."""
    root, k = _folder(spark), F.col("doc_id")
    docs = T.table(spark, sf_dir, "documents").select(F.floor(k / 20).alias("review_id"), k.cast("int").alias("doc_ord"), F.concat(F.lit("doc"), k.cast("string")).alias("name"), F.col("text").alias("outbound_text"), F.lit("safe").alias("decision"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("reasons"), F.lit("low").alias("outbound_risk"), F.lit(1).alias("estimated_input_tokens"))
    said = lambda word: docs.select("review_id", "doc_ord", F.concat(F.lit(f"{word} "), F.col("doc_ord").cast("string")).alias("text"))
    files.export_bundle(docs, said("name"), said("issue"), root)

    def part(name: str, schema: str, size: Column) -> DataFrame:
        return spark.read.schema(f"review_id long, {schema}").json(f"{root}/{name}").groupBy(F.lit(name).alias("part"), "review_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))

    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = part("sanitized_text", "outbound_text string", F.coalesce(F.length("outbound_text"), F.lit(0)).cast("long"))
    return out.unionAll(part("mask_candidates", "text string", chars)).unionAll(part("send_log", "reasons array<string>", F.size("reasons").cast("long"))).unionAll(part("review_result", "text string", chars))


# text, confidentiality marker, legal entity, identifiers of networks
_MARKS = (
    ("Strictly Confidential memo", True, False, []), ("この資料は社外秘です", True, False, []), ("confidentiality of all", False, False, []), ("株式会社テスト の件", False, True, []), ("テスト有限会社", False, True, []), ("Acme Foo Inc. and more", False, True, []),
    ("acme inc", False, False, []), ("at 10.0.0.0/24 on VLAN 12, vrf blue; VLAN 12", False, False, ["10.0.0.0/24", "VLAN 12", "vrf blue"]), ("plain", False, False, []),
)


@query("SELECT doc_id, " + ", ".join(f"coalesce({' OR '.join(f'doc_id % {len(_MARKS)} = {k}' for k, x in enumerate(_MARKS) if x[i])}, false) AS {name}" for i, name in ((1, "marker"), (2, "legal_entity"))) + f", CASE WHEN doc_id % {len(_MARKS)} = 7 THEN ['10.0.0.0/24', 'VLAN 12', 'vrf blue'] ELSE []::VARCHAR[] END AS identifiers FROM documents")
def d13_d15_marks(spark, sf_dir):
    """Markers of confidentiality, legal entities, and identifiers of networks, each once."""
    text = _pick([x[0] for x in _MARKS], F.col("doc_id"))
    return T.table(spark, sf_dir, "documents").select("doc_id", detectors.has_marker(text).alias("marker"), detectors.has_legal_entity(text).alias("legal_entity"), detectors.network_identifiers(text).alias("identifiers"))
