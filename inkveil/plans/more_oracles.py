"""DuckDB SQL for routed pages, other replies, joins of issues and signals in lines of configurations."""

from __future__ import annotations

from inkveil.functions import detectors as D
from inkveil.operators import replies, rules, structure
from inkveil.plans.oracles import _DESIGNS, _list, _text
from inkveil.plans.queries import ORACLES
from inkveil.sources import files

ORACLES["s2_s6_routed_pages"] = rf"""WITH t AS ({ORACLES["s5_strip_markup"]}),
p AS (SELECT page_id, 'p' || page_id || ['.html', '.txt', '.dat'][page_id % 3 + 1] AS name, page_id % 3 AS k, coalesce(nullif(trim(text, ' '), ''), {_text(files.EMPTY_BODY)}) AS body, regexp_extract(url, '//([^/]+)', 1) AS doc FROM pages JOIN t USING (page_id)),
h AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_id) AS INTEGER) AS n,
  concat_ws(chr(10), 'File: ' || name, 'Format: ' || CASE WHEN k = 0 THEN 'markup' ELSE 'text' END, CASE WHEN k = 2 THEN 'Notes: unsupported extension: .dat' END, '', body) AS text FROM p)
SELECT doc, string_agg('# Page ' || n || chr(10) || text, chr(10) || chr(10) ORDER BY n) FILTER (n <= {files.PAGE_CAP}) AS text, max(n) AS pages,
CASE WHEN max(n) > {files.PAGE_CAP} THEN 'only {files.PAGE_CAP} of ' || max(n) || ' pages' END AS warning FROM h GROUP BY doc"""

_FIRST_ITEM = next(name for _, item_id, name, *_ in structure.standard_items() if item_id == "1.1")
ORACLES["s18_s21_other_replies"] = f"""WITH c AS (SELECT conv_id AS review_id, CAST(turn AS INTEGER) AS doc_ord, turn, turn % 5 = 4 AS plain, text, {_list(replies.STATUSES)}[turn % 7 + 1] AS status FROM conversations)
SELECT review_id, doc_ord, CASE WHEN plain THEN trim(text, ' ') ELSE text END AS sanitized_text, CASE WHEN plain THEN ['Local model reply was not JSON.'] ELSE [] END AS findings, CASE WHEN plain THEN 'medium' ELSE 'high' END AS outbound_risk,
CASE WHEN plain THEN 'mask_and_continue' ELSE 'block' END AS decision, CASE WHEN plain THEN [] ELSE ['one reason'] END AS reasons, [] AS actions, CASE WHEN NOT plain THEN status END AS status,
CASE WHEN NOT plain AND status IS NOT NULL THEN {_text(_FIRST_ITEM)} END AS standard, CASE WHEN NOT plain THEN 'missing' END AS verdict, CASE WHEN NOT plain THEN turn % 2 = 0 END AS needs_deep_dive FROM c"""


def _once(values: str, cap: int) -> str:
    return f"list_filter({values}, lambda x, k: list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = k)[1:{cap}]"


def _having(kind: str) -> str:
    paired = f" OR regexp_matches(x, {_text(rules.PAIRED)})" if kind == "device" else ""
    words = _list(w.lower() for w in rules.DIAGRAM_WORDS[kind])
    return f"list_filter(said, lambda x: len(list_filter({words}, lambda w: contains(lower(x), w))) > 0{paired}) AS {kind}_"


def _says(*words: str) -> str:
    return "(" + " OR ".join(f"contains(blob, {_text(w)})" for w in words) + ")"


_KINDS = tuple(rules.DIAGRAM_WORDS)
_INFERRED = {
    "boundary": f"len(external) > 0 AND {_says('fw', 'firewall', 'fortigate', 'waf')}",
    "dmz": "len(list_filter(zone, lambda x: contains(lower(x), 'dmz'))) > 0",
    "redundant": "len(redundancy) > 0 OR len(list_distinct(stems)) < len(stems)",
    "layered": _says("core", "l3sw", "access"),
    "cloud_or_wan": _says("aws", "azure", "gcp", "direct connect", "vpn", "閉域", "専用線"),
    "identifiers": "len(identifier) > 0",
}
_NETWORK_ID = _text(D.NETWORK_ID.removeprefix("(?U)"))
ORACLES["p9_diagram_signals"] = rf"""WITH l AS (SELECT l_orderkey AS k, list('interface Gi0/' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '|description to ' || l_returnflag ELSE '' END ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey AS k, list_concat(['hostname core-sw-' || o_orderkey], flatten(list_transform(lines, lambda x: string_split(x, '|'))), ['line vty 0 4', CASE WHEN o_orderkey % 5 = 0 THEN 'transport input telnet ssh' ELSE 'transport input ssh' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'snmp-server community public RO' END, CASE WHEN o_orderkey % 3 = 0 THEN 'enable password x1' END, CASE WHEN o_orderkey % 9 = 0 THEN 'enable secret y2' END, CASE WHEN o_orderkey % 4 = 0 THEN 'ip http server' END,
  CASE WHEN o_orderkey % 6 = 0 THEN 'access-list 101 permit ip any any' END, CASE WHEN o_orderkey % 2 = 0 THEN 'aaa new-model' END, CASE WHEN o_orderkey % 8 = 0 THEN 'logging host 10.0.0.9' END, CASE WHEN o_orderkey % 10 = 0 THEN 'ntp server 10.0.0.8' END,
  'router ospf 1']) AS every FROM orders JOIN l ON k = o_orderkey),
s AS (SELECT k, list_filter(every, lambda x, n: x IS NOT NULL AND list_position(every, x) = n) AS said FROM t),
f AS (SELECT k, {", ".join(map(_having, _KINDS))}, flatten(list_transform(said, lambda x: regexp_extract_all(x, {_NETWORK_ID}))) AS identifier_ FROM s),
g AS (SELECT k, {", ".join(f"{_once(f'{kind}_', rules.DIAGRAM_CAPS.get(kind, 8))} AS {kind}" for kind in (*_KINDS, "identifier"))} FROM f),
b AS (SELECT *, lower(array_to_string(list_concat({", ".join((*_KINDS, "identifier"))}), chr(10))) AS blob, list_filter(list_transform(device, lambda x: lower(regexp_replace(regexp_extract(x, '(?i)(.+?)[-_]?(?:0?1|0?2|a|b)\b', 1), '[^A-Za-z0-9一-龯ぁ-んァ-ヶ]+', '', 'g'))), lambda x: x <> '') AS stems FROM g)
SELECT CAST(floor(k / 20) AS BIGINT) AS review_id, CAST(k % 20 AS INTEGER) AS doc_ord, 'cisco-' || k || '-config.cfg' AS name, {", ".join((*_KINDS, "identifier"))},
list_filter([{", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in _INFERRED.items())}], lambda x: x IS NOT NULL) AS inferences FROM b"""


def _claims(words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(claim, w))) > 0"


def _words(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '[a-z0-9_-]{{2,}}|[一-龥ァ-ヶー]{{2,}}'))"


ORACLES["j12_j15_j17_issue_joins"] = rf"""WITH {_DESIGNS},
x AS (SELECT *, CAST(ceil(length(text) / 3) AS BIGINT) AS third FROM documents JOIN labels USING (doc_id)),
q AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, '基本設計' || doc_id || '.docx' AS name, 'I' || doc_id AS issue_id, doc_id % 15 + 1 AS named, '第 ' || (doc_id % 15 + 1) || ' 章' AS section, lang || ' ' || source AS title,
  substring(text, 1, third) AS issue, substring(text, third + 1, third) AS details, substring(text, 2 * third + 1, third) AS recommendation FROM x),
s AS (SELECT *, concat_ws(chr(10), section, title, details) AS said, lower(concat_ws(chr(10), title, details, recommendation)) AS claim FROM q),
pairs AS (SELECT s.*, c.chapter_ord, c.chapter_id, c.label, c.chapter_ord + 1 AS number, c.body FROM s JOIN c USING (review_id, name)),
own AS (SELECT DISTINCT review_id, issue_id FROM pairs WHERE contains(said, label) OR contains(said, '第 ' || number || ' 章') OR contains(said, '第' || number || '章')),
told AS (SELECT review_id, issue_id, claim, regexp_extract_all(d.text, {_text("(?m)" + rules.DEFINED)}, 1) AS defined, length(trim(d.text, ' ')) > 0 AS filled FROM s JOIN d USING (review_id, name)),
good AS (SELECT review_id, issue_id FROM told WHERE NOT ({_claims(replies.SYNTAX_CLAIMS)} OR ({_claims(replies.MISSING_SOURCE_CLAIMS)} AND filled) OR {_claims(replies.ARTEFACT_CLAIMS)}
  OR ({_claims(replies.UNDEFINED_CLAIMS)} AND len(list_filter(defined, lambda f: contains(claim, lower(f)))) > 0))),
scored AS (SELECT p.review_id, p.issue_id, chapter_id, label, chapter_ord, CASE WHEN section = label THEN 1000 WHEN named = number THEN 900
  ELSE len(list_intersect({_words("concat_ws(chr(10), title, details, issue)")}, {_words("body")})) END AS score FROM pairs p JOIN own USING (review_id, issue_id) JOIN good USING (review_id, issue_id))
SELECT review_id, issue_id, arg_max(chapter_id, score * 100 - chapter_ord) AS chapter_id, arg_max(label, score * 100 - chapter_ord) AS chapter_label FROM scored WHERE score >= 2 GROUP BY ALL"""


def _has(text: str, words) -> str:
    return f"len(list_filter({_list(w.lower() for w in words)}, lambda w: contains({text}, w))) > 0"


def _fires(r: rules.Rule) -> str:
    low = f"substring(low, 1, {r.head})" if r.head else "low"
    some = [f"regexp_matches(text, {_text(p)})" for p in r.some] + ([_has(low, r.some_words)] if r.some_words else [])
    none = [f"NOT regexp_matches(text, {_text(p)})" for p in r.none] + ([f"NOT ({_has(low, r.none_words)})"] if r.none_words else [])
    tests = [f"({' OR '.join(some)})" if some else "true", *none, *([f"profile IN ({', '.join(map(_text, r.profiles))})"] if r.profiles else [])]
    return " AND ".join(tests)


def _row(ord_: int, r: rules.Rule) -> str:
    return f"{{'rule_ord': {ord_}, 'severity': {_text(r.severity)}, 'title': {_text(r.title)}}}"


_FIRED = ", ".join(f"CASE WHEN {_fires(r)} THEN {_row(k, r)} END" for k, r in enumerate(rules.REVIEW_RULES))
_UNAPPROVED = f"CASE WHEN profile = 'change_runbook' AND NOT ({_has('low', rules.RISK_LEVELS)} AND {_has('low', rules.APPROVALS)}) THEN {_row(99, rules.NO_APPROVAL)} END"
ORACLES["p8_rule_review"] = f"""WITH {_DESIGNS},
r AS (SELECT review_id, doc_ord, name, text, lower(text) AS low, ['design', 'change_runbook', 'operations_runbook'][review_id % 3 + 1] AS profile FROM d),
f AS (SELECT review_id, doc_ord, name, profile, unnest([{_FIRED}, {_UNAPPROVED}]) AS x FROM r),
i AS (SELECT review_id, doc_ord, name, profile, x.rule_ord AS rule_ord, x.severity AS severity, x.title AS title FROM f WHERE x IS NOT NULL),
e AS (SELECT * FROM i UNION ALL SELECT DISTINCT review_id, 0, '-', profile, 0, {_text(rules.NOTHING.severity)}, {_text(rules.NOTHING.title)} FROM r WHERE NOT EXISTS (FROM i WHERE i.review_id = r.review_id))
SELECT review_id, doc_ord, name, profile AS document_profile, rule_ord, severity, title, CASE profile {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ID_PREFIX.items())} END || '-'
|| CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS issue_id FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY doc_ord, rule_ord, title) AS n FROM e)"""
