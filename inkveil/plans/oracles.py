"""DuckDB SQL for queries on designs, configurations and dictionary names; words and rules come from the operators' fixed values."""

from __future__ import annotations

import re

from inkveil.functions.text import squeeze_word
from inkveil.operators import remediation, risk, structure
from inkveil.plans.queries import _ISSUE_SQL, ORACLES
from inkveil.plans.tables import DESIGN_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in row) + ")" for row in rows)


def _squeezed(column: str) -> str:
    return rf"regexp_replace(translate(lower({column}), '０１２３４５６７８９', '0123456789'), '[\s\x0B\x{{85}}\p{{Z}}]+', '', 'g')"


def _bounded(column: str, words) -> str:
    """F9 without looking around: the neighbours are matched instead."""
    edge = lambda c: c.isascii() and c.isalnum()
    one = lambda w: ("(?:^|[^A-Za-z0-9])" if edge(w[0]) else "") + re.escape(w) + ("(?:$|[^A-Za-z0-9])" if edge(w[-1]) else "")
    return f"regexp_matches({column}, {_text('(?i)' + '|'.join(one(w) for w in words))})"


def _missing(column: str, needed) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN NOT {_bounded(column, words)} THEN {_text(label)} END" for label, words in needed.items()) + "], lambda x: x IS NOT NULL)"


# c: the chapters of the derived designs; d: the designs
_DESIGNS = f"""k AS (SELECT doc_id, text, doc_id % 12 + 3 AS n, CAST(ceil(length(text) / (doc_id % 12 + 3)) AS BIGINT) AS size, {_list(DESIGN_WORDS)} AS words FROM documents),
c AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, CAST(doc_id % 20 AS INTEGER) AS doc_ord, '基本設計' || doc_id || '.docx' AS name, CAST(i AS INTEGER) AS chapter_ord, 'ch' || (i + 1) AS chapter_id, '第 ' || (i + 1) || ' 章 ' || words[i + 1] AS label,
  '第 ' || (i + 1) || ' 章 ' || words[i + 1] || chr(10) || substring(text, i * size + 1, size) || chr(10) || words[(doc_id + i) % 15 + 1] AS body FROM (SELECT *, unnest(range(0, n)) AS i FROM k)),
d AS (SELECT review_id, doc_ord, name, string_agg(body, chr(10) ORDER BY chapter_ord) AS text FROM c GROUP BY ALL)"""

_REQUIRED = [
    (i, item_id, name, weight, content)
    for i, item_id, name, necessity, weight, content in structure.standard_items()
    if necessity == "must" and item_id in structure.ITEM_WORDS
]
_FINDINGS = f"""{_DESIGNS},
iw(item_id, word) AS ({_values((k, squeeze_word(w)) for k, words in structure.ITEM_WORDS.items() for w in words)}),
cw(topic, word) AS ({_values((k, squeeze_word(w)) for k, words in structure.CHAPTER_WORDS.items() for w in words)}),
standard(chapter_id, chapter_name, purpose) AS ({_values(row[1:] for row in structure.standard_chapters())}),
required(chapter_id, item_id, item_name, weight, content) AS ({_values(_REQUIRED)}),
wide(item_id) AS ({_values((x,) for x in structure.SET_WIDE_ITEMS)}),
ds AS (SELECT review_id, {_squeezed("text")} AS s FROM d),
cs AS (SELECT review_id, doc_ord, name, chapter_ord, chapter_id, {_squeezed("body")} AS s FROM c),
set_items AS (SELECT DISTINCT review_id, item_id FROM ds JOIN iw ON contains(s, word)),
elsewhere AS (SELECT review_id, topic FROM ds JOIN cw ON contains(s, word) GROUP BY ALL HAVING count(DISTINCT word) >= 2),
detected AS (SELECT DISTINCT review_id, chapter_id FROM c),
sets AS (SELECT DISTINCT review_id FROM c),
topics AS (SELECT review_id, doc_ord, name, chapter_ord, topic FROM cs JOIN cw ON contains(s, word) GROUP BY ALL HAVING count(*) >= 2),
stray AS (SELECT review_id, topic, arg_min(name, doc_ord * 100 + chapter_ord) AS name FROM topics t
  WHERE NOT EXISTS (FROM detected x WHERE x.review_id = t.review_id AND x.chapter_id = t.topic) GROUP BY ALL),
missing AS (SELECT s.review_id, t.*, stray.name, stray.name IS NOT NULL OR e.topic IS NOT NULL AS suggested FROM sets s CROSS JOIN standard t
  LEFT JOIN stray ON stray.review_id = s.review_id AND stray.topic = t.chapter_id LEFT JOIN elsewhere e ON e.review_id = s.review_id AND e.topic = t.chapter_id
  WHERE NOT EXISTS (FROM detected x WHERE x.review_id = s.review_id AND x.chapter_id = t.chapter_id)),
f AS (
  SELECT review_id, CASE WHEN suggested THEN 'structure_organization_suggestion' ELSE 'missing_chapter' END AS kind,
    CASE WHEN NOT suggested AND chapter_id IN ({", ".join(map(_text, structure.CRITICAL_CHAPTERS))}) THEN 'high' ELSE 'medium' END AS severity,
    chapter_id, chapter_name, NULL AS item_id, NULL AS item_name, CASE WHEN suggested THEN coalesce(name, '') END AS source_document, purpose AS expected_content FROM missing
  UNION ALL SELECT review_id, 'required_item_gap', CASE WHEN weight >= 3 THEN 'high' ELSE 'medium' END, chapter_id, chapter_name, item_id, item_name, name, content
    FROM cs JOIN required r USING (chapter_id) JOIN standard USING (chapter_id)
    WHERE item_id NOT IN (FROM wide) AND NOT EXISTS (FROM iw WHERE iw.item_id = r.item_id AND contains(cs.s, iw.word))
  UNION ALL SELECT review_id, 'required_item_gap', CASE WHEN weight >= 3 THEN 'high' ELSE 'medium' END, '', '文書全体', item_id, item_name, NULL, content
    FROM sets CROSS JOIN required r WHERE item_id IN (FROM wide) AND NOT EXISTS (FROM set_items x WHERE x.review_id = sets.review_id AND x.item_id = r.item_id)
)"""
ORACLES["p4_structure"] = f"WITH {_FINDINGS} SELECT * FROM f"
ORACLES["a22_structure_overview"] = f"""WITH {_FINDINGS}
SELECT review_id, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, count(*) FILTER (severity = 'info') AS n_info,
count(*) FILTER (kind = 'missing_chapter') AS n_missing, count(*) FILTER (kind = 'required_item_gap') AS n_gaps, CASE WHEN n_high > 0 THEN 'block' WHEN n_medium > 0 THEN 'warn' ELSE 'safe' END AS tone FROM f GROUP BY review_id"""

ORACLES["p4_purpose"] = f"""WITH t AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, text, coalesce(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY floor(doc_id / 20) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents),
h AS (SELECT review_id, {_squeezed(f"coalesce(substring(text, 1, {structure.GENERIC_HEAD} - before), '')")} AS s FROM t WHERE before < {structure.GENERIC_HEAD}),
w(word) AS ({_values((squeeze_word(w),) for w in structure.ITEM_WORDS["1.1"])})
SELECT review_id, 'required_item_gap' AS kind, 'medium' AS severity, '冒頭の目的記載' AS item_name FROM h GROUP BY review_id HAVING NOT bool_or(EXISTS (FROM w WHERE contains(s, word)))"""

_VAGUE = " UNION ALL ".join(
    f"SELECT review_id, doc_ord, name, label, chapter_ord, {i} AS rule_ord, {_text(word)} AS expression, {_missing('body', needed)} AS missing_elements, body FROM c WHERE contains(body, {_text(word)})"
    for i, (word, needed) in enumerate(risk.AMBIGUOUS.items())
)
ORACLES["p10_ambiguous_expressions"] = rf"""WITH {_DESIGNS}, v AS ({_VAGUE}),
w AS (SELECT *, strpos(body, expression) AS place FROM v WHERE len(missing_elements) > 0 QUALIFY row_number() OVER (PARTITION BY review_id, doc_ord, rule_ord ORDER BY chapter_ord) = 1),
x AS (SELECT *, greatest(1, place - 58) AS a, least(length(body) + 1, place + length(expression) + 58) AS b, row_number() OVER (PARTITION BY review_id ORDER BY doc_ord, rule_ord) AS n FROM w QUALIFY n <= {risk.AMBIGUOUS_CAP})
SELECT review_id, 'AF-' || lpad(n::VARCHAR, 3, '0') AS finding_id, expression, name AS source_document, label AS section,
CASE WHEN a > 1 THEN '...' ELSE '' END || trim(regexp_replace(substring(body, a, b - a), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')) || CASE WHEN b <= length(body) THEN '...' ELSE '' END AS context,
missing_elements, CASE WHEN len(missing_elements) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM x"""

_PERSONA_FLAGS = ", ".join(
    [f"bool_or({_bounded('text', words)}) AS p{i}_{j}" for i, needed in enumerate(risk.PERSONAS.values()) for j, words in enumerate(needed.values())]
    + [f"bool_or({_bounded('text', risk.OPERATIONS)}) AS operations"]
)
_PERSONA_ROWS = " UNION ALL ".join(
    f"SELECT review_id, source_document, {i + 1} AS persona_ord, {_text(p)} AS persona, list_filter(["
    + ", ".join(f"CASE WHEN NOT p{i}_{j} THEN {_text(label)} END" for j, label in enumerate(needed))
    + f"], lambda x: x IS NOT NULL) AS signals, {'operations' if p == '二次運用者' else 'true'} AS active, {2 if p == '二次運用者' else 3} AS many FROM s"
    for i, (p, needed) in enumerate(risk.PERSONAS.items())
)
def _scenario_rows() -> str:
    """Of each set and scenario: whether its documents name it, its labels without and with evidence, and its level."""
    rows = []
    for s, (title, words, needed, high) in risk.SCENARIOS.items():
        flags = ", ".join(f"bool_or({_bounded('text', group)}) AS f{j}" for j, group in enumerate(needed.values()))
        gone = ", ".join(f"CASE WHEN NOT f{j} THEN {_text(label)} END" for j, label in enumerate(needed))
        have = ", ".join(f"CASE WHEN f{j} THEN {_text(label)} END" for j, label in enumerate(needed))
        rows.append(
            f"SELECT review_id, '{s}' AS scenario_id, {_text(title)} AS title, named, list_filter([{gone}], lambda x: x IS NOT NULL) AS missing, list_filter([{have}], lambda x: x IS NOT NULL) AS confirmed, "
            f"CASE WHEN list_has_any(missing, {_list(high)}::VARCHAR[]) OR len(missing) >= 2 THEN 'high' ELSE 'medium' END AS risk_level "
            f"FROM (SELECT review_id, bool_or({_bounded('text', words)}) AS named, {flags} FROM d GROUP BY review_id)"
        )
    return " UNION ALL ".join(rows)


_HITS = " UNION ALL ".join(f"SELECT *, '{s}' AS scenario_id FROM i WHERE {_bounded('said', words)}" for s, (_, words, _, _) in risk.SCENARIOS.items())
_SCORES = " UNION ALL ".join(
    f"SELECT review_id, '{s}' AS scenario_id, name, label, doc_ord, chapter_ord, " + " + ".join(f"{_bounded('body', [w])}::INTEGER" for w in (*words, *(x for group in needed.values() for x in group))) + " AS score FROM c"
    for s, (_, words, needed, _) in risk.SCENARIOS.items()
)
ORACLES["p12_premortem"] = f"""WITH {_DESIGNS},
j AS (SELECT doc_id, text, CAST(ceil(length(text) / 3) AS BIGINT) AS n, lang || ' ' || source AS title FROM documents JOIN labels USING (doc_id)),
i AS (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, doc_id, title, concat_ws(chr(10), nullif(title, ''), nullif(substring(text, n + 1, n), ''), nullif(substring(text, 1, n), ''), nullif(substring(text, 2 * n + 1, n), '')) AS said FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY review_id, scenario_id ORDER BY doc_id) AS place FROM ({_HITS}) QUALIFY place <= {risk.HINTS}),
hints AS (SELECT review_id, scenario_id, list(title ORDER BY place) AS review_hint, min(doc_id) AS doc_id FROM r GROUP BY ALL),
best AS (SELECT review_id, scenario_id, arg_max({{'name': name, 'label': label}}, score * 1000000 - doc_ord * 1000 - chapter_ord) AS best FROM ({_SCORES}) WHERE score > 0 GROUP BY ALL),
s AS ({_scenario_rows()})
SELECT review_id, scenario_id, s.title, risk_level,
CASE WHEN named AND best IS NOT NULL THEN best.name WHEN review_hint IS NOT NULL THEN 'doc' || doc_id ELSE '{risk.WHOLE_SET}' END AS source_document,
CASE WHEN named AND best IS NOT NULL THEN best.label WHEN review_hint IS NOT NULL THEN '第 ' || (doc_id % 15 + 1) || ' 章' ELSE '{risk.WHOLE_DOC}' END AS section,
CASE WHEN named AND review_hint IS NOT NULL THEN 'both' WHEN named THEN 'document' ELSE 'issue' END AS trigger_source,
confirmed AS confirmed_elements, missing AS missing_elements, coalesce(review_hint, []) AS review_hint
FROM s LEFT JOIN hints USING (review_id, scenario_id) LEFT JOIN best USING (review_id, scenario_id) WHERE len(missing) > 0 AND (named OR review_hint IS NOT NULL)"""

# letters beyond ASCII become _ and other such signs blanks, so that a boundary of ASCII words is one of all words
ORACLES["p11_reader_risks"] = rf"""WITH {_DESIGNS},
s AS (SELECT review_id, CASE WHEN count(*) = 1 THEN min(name) ELSE '{risk.WHOLE_SET}' END AS source_document, {_PERSONA_FLAGS} FROM d GROUP BY review_id),
a AS (SELECT review_id, list_sort(list_distinct(flatten(list(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][A-Z0-9]{{1,}}(?:/[A-Z0-9]{{2,}})?\b'))))) AS abbr FROM d GROUP BY review_id),
r AS ({_PERSONA_ROWS})
SELECT review_id, source_document, 0 AS persona_ord, '初任SE' AS persona, CASE WHEN len(abbr) >= {risk.MANY_ABBREVIATIONS} THEN 'high' WHEN len(abbr) >= {risk.SOME_ABBREVIATIONS} THEN 'medium' ELSE 'low' END AS risk_level, abbr[1:8] AS signals, CAST(len(abbr) AS INTEGER) AS n_signals FROM s JOIN a USING (review_id)
UNION ALL SELECT review_id, source_document, persona_ord, persona, CASE WHEN active AND len(signals) >= many THEN 'high' WHEN active AND len(signals) > 0 THEN 'medium' ELSE 'low' END, signals, CAST(len(signals) AS INTEGER) FROM r"""

ORACLES["d_all_detectors"] = """WITH o AS (SELECT o_orderkey AS k, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
m AS (SELECT k, unnest([{'category': 'secret', 'n': (k % 7 = 0)::BIGINT + (k % 3 = 0)::BIGINT + (k % 9 = 0)::BIGINT}, {'category': 'ipv4', 'n': (k % 8 = 0)::BIGINT + (k % 10 = 0)::BIGINT},
  {'category': 'hostname', 'n': 1 + (k < 100000)::BIGINT}, {'category': 'interface', 'n': lines}]) AS x FROM o)
SELECT 'cisco-' || k || '-config.cfg' AS name, x.category AS category, x.n AS n, false AS marker, false AS legal, CAST((k % 8 = 0)::INTEGER + (k % 10 = 0)::INTEGER AS INTEGER) AS n_identifiers FROM m WHERE x.n > 0"""

ORACLES["p13_dictionary_mask"] = """WITH n AS (SELECT n_nationkey, upper(n_name) AS canonical, upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation),
d AS (SELECT CAST(c_custkey AS BIGINT) AS review_id, c_name || ' of ' || name AS said FROM customer JOIN n ON c_nationkey = n_nationkey),
t AS (SELECT review_id, name, row_number() OVER (PARTITION BY review_id ORDER BY strpos(said, name), canonical) AS k FROM (FROM d JOIN n ON contains(said, name) QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY length(name) DESC) = 1) WHERE n_nationkey % 2 = 0 OR review_id % 2 = 1),
b AS (SELECT review_id, arg_max(name, length(name)) AS name, arg_max(k, length(name)) AS k FROM t GROUP BY review_id)
SELECT review_id, 0 AS doc_ord, CASE WHEN b.name IS NULL THEN said ELSE replace(said, b.name, '[SITE_' || lpad(b.k::VARCHAR, 3, '0') || ']') END AS outbound_text FROM d LEFT JOIN b USING (review_id)"""

# summaries of the reviewer for the first chapter of every third document; all else are excerpts
ORACLES["p18_chapter_overviews"] = rf"""WITH {_FINDINGS},
own AS (SELECT review_id, chapter_id, source_document, count(*) AS n FROM f WHERE coalesce(source_document, '') <> '' GROUP BY ALL),
any_doc AS (SELECT review_id, chapter_id, count(*) AS n FROM f WHERE coalesce(source_document, '') = '' GROUP BY ALL),
o AS (SELECT c.review_id, doc_ord, name AS source_document, chapter_ord, c.chapter_id, label AS chapter_label,
  CASE WHEN doc_ord % 3 = 0 AND c.chapter_id = 'ch1' THEN 'summary' ELSE substring(trim(regexp_replace(body, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')), 1, 220) END AS summary, '' AS review,
  coalesce(own.n, 0) + coalesce(any_doc.n, 0) AS n_findings FROM c
  LEFT JOIN own ON own.review_id = c.review_id AND own.chapter_id = c.chapter_id AND own.source_document = c.name LEFT JOIN any_doc ON any_doc.review_id = c.review_id AND any_doc.chapter_id = c.chapter_id)
SELECT *, true AS needs_deep_dive, n_findings || ' findings' AS reason FROM o WHERE n_findings > 0"""

ORACLES["s22_review_payload"] = f"""WITH {_FINDINGS},
l AS (SELECT review_id, doc_ord, string_agg(label, chr(10) ORDER BY chapter_ord) AS labels FROM c GROUP BY ALL),
p AS (SELECT review_id, row_number() OVER s AS k, '文書 ' || row_number() OVER s || '/' || count(*) OVER (PARTITION BY review_id) || ': ' || name || chr(10) || text || chr(10) || labels AS part
  FROM d JOIN l USING (review_id, doc_ord) WINDOW s AS (PARTITION BY review_id ORDER BY doc_ord)),
b AS (SELECT review_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS body FROM p GROUP BY review_id),
r AS (SELECT review_id, concat_ws(' ', severity, kind, chapter_name, item_name) AS line, row_number() OVER (PARTITION BY review_id ORDER BY list_position(['high', 'medium', 'low', 'info'], severity), kind, chapter_id NULLS FIRST, item_id NULLS FIRST) AS k FROM f),
g AS (SELECT review_id, string_agg(line, chr(10) ORDER BY k) FILTER (k <= 20) AS findings, count(*) - 20 AS more FROM r GROUP BY review_id)
SELECT review_id, concat_ws(chr(10) || chr(10), body, findings, CASE WHEN more > 0 THEN 'n more: ' || more END) AS payload FROM b LEFT JOIN g USING (review_id)"""

# (when the derived script has the line, title, the line)
_LINES = [
    ("k % 3 = 0", "ハードコードされた認証情報の疑い", None),
    ("k % 7 = 0", "危険なコマンド実行の可能性", "os.system(cmd)"),
    ("k % 4 = 0", "TLS/証明書検証を無効化している可能性", "requests.post(url, timeout=3, verify=False)"),
    ("k % 5 = 0 AND k % 4 <> 0", "外部通信のタイムアウトが不明確", "requests.get(url)"),
    ("k % 13 = 0", "破壊的または運用影響の大きい処理に安全ガードが不足", 'run("rm -rf /tmp/x")'),
    ("k % 2 = 0", "入力イベントを丸ごとログ出力している", "print(event)"),
    ("k % 11 = 0", "例外処理が広すぎる可能性", "except Exception:"),
]
_EVIDENCE = " UNION ALL ".join(
    f"SELECT k, {_text(title)} AS title, list_position(lines, {_text(line or 'password = ' + chr(34) + 'abc123' + chr(34))}) AS line, {_text(line or '認証情報らしき代入を検出（値は表示しません）')} AS shown FROM e WHERE {when}"
    for when, title, line in _LINES
)
ORACLES["p7_code_evidence"] = f"""WITH e AS (SELECT event_id AS k, list_filter(['def run_' || event_id, CASE WHEN event_id % 2 = 0 THEN 'print(event)' END, CASE WHEN event_id % 3 = 0 THEN 'password = "abc123"' END, CASE WHEN event_id % 5 = 0 THEN 'requests.get(url)' END,
  CASE WHEN event_id % 7 = 0 THEN 'os.system(cmd)' END, CASE WHEN event_id % 11 = 0 THEN 'try:' END, CASE WHEN event_id % 11 = 0 THEN 'pass' END, CASE WHEN event_id % 11 = 0 THEN 'except Exception:' END, CASE WHEN event_id % 11 = 0 THEN 'pass ' END,
  CASE WHEN event_id % 4 = 0 THEN 'requests.post(url, timeout=3, verify=False)' END, CASE WHEN event_id % 13 = 0 THEN 'run("rm -rf /tmp/x")' END], lambda x: x IS NOT NULL) AS lines FROM events),
v AS ({_EVIDENCE})
SELECT CAST(floor(k / 20) AS BIGINT) AS review_id, 'job' || k || '.py' AS name, title, 'run_' || k || ' 内 / ' || line || '行目付近: ' || shown AS evidence, 'run_' || k || ' 内 / ' || line || '行目付近' AS section, line::VARCHAR AS line, 'python' AS language, 1 AS functions FROM v"""


def _or(value: str, default: str) -> str:
    return f"coalesce(nullif(trim({value}, ' '), ''), {default})"


_CONDITION = "CASE severity WHEN 'high' THEN '「' || target_section || '」の修正後に必ず再レビュー' WHEN 'medium' THEN '「' || target_section || '」の差分を再レビュー' ELSE '「' || target_section || '」を次回レビュー時に確認' END"
_ITEMS = f"""{_FINDINGS}, {_ISSUE_SQL},
t AS (SELECT i.*, substring(text, n + 1, n) AS details, substring(text, 1, n) AS issue, substring(text, 2 * n + 1, n) AS recommendation, 'doc' || doc_id AS doc, '第 ' || (doc_id % 15 + 1) || ' 章' AS section, review_id % 4 = 0 AS code
  FROM i JOIN (SELECT doc_id, text, CAST(ceil(length(text) / 3) AS BIGINT) AS n FROM documents) USING (doc_id)),
u AS (
  SELECT review_id, 'ISSUE-' || upper(sha256(doc || '|' || section || '|' || title)[1:8]) AS item_id, 'review_issue' AS source_type, severity, {_or("title", "'レビュー指摘'")} AS title, doc AS target_document, section AS target_section,
    {_or("issue", _or("details", "title"))} AS problem, {_or("recommendation", "'指摘箇所に、判断根拠・設計方針・完了条件を追記してください。'")} AS fix_policy, {_or("recommendation", "''")} AS said,
    '未対応時の影響を記載してください。' AS impact, '読み手が設計判断、根拠、運用時の判断基準を追えること。' AS completion_condition,
    CASE WHEN code THEN 'code_analysis' ELSE '' END AS review_mode, CASE WHEN code THEN 'model' ELSE '' END AS basis, CASE WHEN code THEN 'low' ELSE '' END AS confidence FROM t WHERE severity <> 'info'
  UNION ALL SELECT review_id, {_or("item_id", _or("chapter_id", "kind"))}, 'structure_check', severity, heading, {_or("source_document", "'文書全体'")}, {_or("chapter_name", _or("item_name", "'文書全体'"))}, heading, expected_content, expected_content,
    '章立てや必須要素が不足すると、読み手が設計判断・責任範囲・運用条件を追いにくくなります。', '不足観点が独立した見出しまたは明確な本文として確認できること。', '', '', ''
  FROM (SELECT *, CASE kind WHEN 'missing_chapter' THEN '不足観点: ' || chapter_name WHEN 'required_item_gap' THEN '必須要素不足: ' || item_name ELSE '構成整理: ' || chapter_name END AS heading FROM f)
  WHERE severity IN ('high', 'medium') AND NOT (review_id % 4 = 0 AND review_id IN (SELECT review_id FROM i))
),
ranked AS (SELECT *, list_position(['high', 'medium', 'low'], severity) AS s, source_type <> 'structure_check' AS second FROM u),
once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY review_id, source_type, target_document, target_section, title ORDER BY s, item_id) = 1),
items AS (SELECT review_id, item_id, source_type, severity, title, target_document, target_section, problem, fix_policy, '【' || target_section || '】' || chr(10) || said AS template, target_document || ' / ' || target_section AS re_review_scope,
  {_CONDITION} AS re_review_condition, CASE severity WHEN 'high' THEN '大' WHEN 'medium' THEN '中' ELSE '小' END AS effort, 'initial' AS origin, '' AS current_state, impact, completion_condition, review_mode, '' AS evidence_line, basis, confidence,
  CAST(row_number() OVER (PARTITION BY review_id ORDER BY s, second, target_document, target_section, item_id, title) AS INTEGER) AS work_ord FROM once QUALIFY work_ord <= {remediation.MAX_ITEMS})"""
ORACLES["p14_remediation_items"] = f"WITH {_ITEMS} SELECT * FROM items"


def _said(texts) -> str:
    return f"{_list(texts)}[code + 1]"


ORACLES["p14_steps"] = f"""WITH {_ITEMS},
n AS (SELECT review_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM items GROUP BY review_id),
p AS (SELECT DISTINCT review_id, (review_id % 4 = 0)::INTEGER AS code FROM i),
s AS (SELECT review_id, code, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM p LEFT JOIN n USING (review_id)),
h AS (SELECT *, CASE WHEN high > 0 THEN {_said(remediation.HEADLINES["high"])} WHEN medium > 0 THEN {_said(remediation.HEADLINES["medium"])} WHEN low > 0 THEN {_said(remediation.HEADLINES["low"])} ELSE {_said(remediation.HEADLINES[""])} END AS headline FROM s),
steps AS (SELECT review_id, 1 AS step_ord, {_said(remediation.STEPS["high"])} AS step, high AS n_items FROM h WHERE high > 0 UNION ALL SELECT review_id, 2, {_said(remediation.STEPS["medium"])}, medium FROM h WHERE medium > 0
  UNION ALL SELECT review_id, 3, {_said(remediation.STEPS[""])}, high + medium + low FROM h)
SELECT review_id, step_ord, step, n_items, high, medium, low, headline FROM steps JOIN h USING (review_id)"""

_SQUEEZED_TEXT = r"trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))"
ORACLES["p19_local_summary"] = rf"""WITH {_DESIGNS}, {_ISSUE_SQL},
l AS (SELECT review_id, doc_ord, string_agg(label, ' / ' ORDER BY chapter_ord) AS labels FROM c WHERE chapter_ord < 5 GROUP BY ALL),
r AS (SELECT review_id, doc_ord, name || ': ' || labels AS line, coalesce(nullif(regexp_extract(text, '(本(?:書|資料|手順書)は[^。\n]*。?)', 1), ''), substring({_SQUEEZED_TEXT}, 1, 180)) AS purpose FROM d JOIN l USING (review_id, doc_ord)
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY doc_ord) <= 5),
o AS (SELECT review_id, arg_min(purpose, doc_ord) AS purpose, string_agg(line, chr(10) ORDER BY doc_ord) AS content_outline FROM r GROUP BY review_id),
n AS (SELECT review_id, 'high ' || count(*) FILTER (severity = 'high') || ', medium ' || count(*) FILTER (severity = 'medium') || ', low ' || count(*) FILTER (severity = 'low') AS said FROM i GROUP BY review_id)
SELECT review_id, purpose, content_outline, coalesce(said, 'high 0, medium 0, low 0') AS overall_evaluation FROM o LEFT JOIN n USING (review_id)"""

_LOW = r"lower(regexp_replace(trim({}, ' '), '[\s\x0B\x{{85}}\p{{Z}}]+', '', 'g'))"
_COMPARED = rf"""{_ITEMS},
whole AS (SELECT review_id, string_agg(text, chr(10) ORDER BY doc_ord) AS text FROM d GROUP BY review_id),
m AS (SELECT q.*, {_LOW.format("coalesce(nullif(d.text, ''), whole.text, '')")} AS t,
  list_filter(list_transform(regexp_extract_all(regexp_replace(concat_ws(chr(10), title, target_section, problem, fix_policy, template, re_review_condition), '{remediation.CONNECTIVES}', ' ', 'g'), '[A-Za-z][A-Za-z0-9_-]{{1,}}|[一-龥ぁ-んァ-ヶー]{{2,}}'),
    lambda x: trim(x, ' _-:：・、。,.()（）[]【】「」『』')), lambda x: length(x) BETWEEN 2 AND 32 AND lower(x) NOT IN ({", ".join(map(_text, remediation.STOPWORDS))})) AS useful
  FROM items q LEFT JOIN d ON d.review_id = q.review_id AND d.name = q.target_document JOIN whole ON whole.review_id = q.review_id),
z AS (SELECT *, list_transform(useful, lambda x: lower(x)) AS low FROM m),
y AS (SELECT *, list_filter(useful, lambda x, i: list_position(low, lower(x)) = i)[1:{remediation.MAX_TERMS}] AS terms FROM z),
x AS (SELECT *, list_filter(terms, lambda x: contains(t, {_LOW.format("x")})) AS matched, target_section NOT IN ('', {", ".join(map(_text, remediation.NOWHERE))}) AND contains(t, {_LOW.format("target_section")}) AS named FROM y),
w AS (SELECT *, len(terms) AS n, len(matched) AS k, CASE WHEN len(terms) > 0 THEN len(matched)::DOUBLE / len(terms) ELSE 0 END AS share FROM x),
compared AS (SELECT review_id, item_id, title, severity, target_document, target_section,
  CASE WHEN n = 0 THEN 'needs_review' WHEN share >= 0.55::DOUBLE OR (named AND share >= 0.35::DOUBLE) OR k >= 5 THEN 'improved' WHEN share >= 0.25::DOUBLE OR k >= 2 THEN 'partial' ELSE 'not_confirmed' END AS status,
  round(share, 3) AS score, matched[1:{remediation.SHOWN_TERMS}] AS matched_terms, list_filter(terms, lambda x: NOT list_contains(matched, x))[1:{remediation.SHOWN_TERMS}] AS missing_terms FROM w)"""
ORACLES["p15_compared_remediation"] = f"WITH {_COMPARED} SELECT * FROM compared"
ORACLES["a10_comparison_counts"] = f"""WITH {_COMPARED} SELECT review_id, count(*) FILTER (status = 'improved') AS improved, count(*) FILTER (status = 'partial') AS partial,
count(*) FILTER (status = 'not_confirmed') AS not_confirmed, count(*) FILTER (status = 'needs_review') AS needs_review FROM compared GROUP BY review_id"""

# there the issues name the designs
_OF_DESIGNS = _ITEMS.replace("'doc' || doc_id AS doc", "'基本設計' || doc_id || '.docx' AS doc")
ORACLES["j13_items_to_chapters"] = rf"""WITH {_OF_DESIGNS},
near AS (SELECT q.review_id, q.item_id, c.chapter_id, label, doc_ord * 100 + chapter_ord AS place, {_LOW.format("label")} AS a, {_LOW.format("target_section")} AS b FROM items q JOIN c ON c.review_id = q.review_id
  WHERE (contains(target_document, name) OR contains(name, target_document)) AND (contains(a, b) OR contains(b, a)))
SELECT review_id, item_id, arg_min(chapter_id, place) AS chapter_id, arg_min(label, place) AS chapter_label FROM near GROUP BY ALL"""
