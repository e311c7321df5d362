"""DuckDB SQL for masking and the release gate: the twelve rules in order, as lists of matches, values and the text between them.

RE2 has neither looking around nor Unicode boundaries: where a neighbour decides, it is matched and put back.
"""

from __future__ import annotations

import re

from inkveil.functions import detectors as D
from inkveil.functions.text import APPROVED, UNAPPROVED
from inkveil.operators import gate, masking
from inkveil.plans.oracles import _list, _text
from inkveil.plans.queries import ORACLES

_BLANK = r"\s\x0B\x{85}\p{Z}"
_APART, _END = r"(?:^|[^\p{L}\p{N}\p{M}_])", r"(?:$|[^\p{L}\p{N}\p{M}_])"


def _unicode(pattern: str) -> str:
    """White space as Java's U flag has it; flags that RE2 doesn't know go."""
    for flags, known in (("(?imdU)", "(?im)"), ("(?iU)", "(?i)"), ("(?iu)", "(?i)"), ("(?U)", "")):
        pattern = pattern.replace(flags, known)
    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\s", lambda m: f"[{_BLANK}]" if m[0] == r"\s" else m[0].replace(r"\s", _BLANK), pattern)


def _bounded(pattern: str) -> str:
    """Boundaries before the first group or capital, and at the end, by the neighbours."""
    pattern = _unicode(pattern).replace(r"\b(", f"{_APART}(", 1).replace(r"\b[A-Z]", f"{_APART}[A-Z]")
    return pattern.removesuffix(r"\b") + (_END if pattern.endswith(r"\b") else "")


def _labelled(english: str, japanese: str) -> str:
    return rf"(?im)(^[ \t]*(?:{english})|{_APART}(?:{japanese}))[{_BLANK}]*[:=：]+[{_BLANK}]*([^\r\n,;、；。]{{2,80}})"


_LABELS = {
    "D8": _labelled(D.COMPANY_EN, D.COMPANY_JA),
    "D9": _labelled(D.PROJECT_EN, D.PROJECT_JA),
    "D10": _labelled(D.TICKET_EN, D.TICKET_JA),
    "D11": _labelled(D.PERSON_EN, D.PERSON_JA),
}


def _rule(d: D.Detector) -> tuple[str, int]:
    """Pattern and group of the value."""
    if d.rule in _LABELS:
        return _LABELS[d.rule], 2
    if d.rule == "D3":
        core = D.IPV6.removeprefix(r"(?U)(?<![\w:])").removesuffix(r"(?![\w:])")
        return rf"(^|[^\p{{L}}\p{{N}}\p{{M}}_:])({core})(?:$|[^\p{{L}}\p{{N}}\p{{M}}_:])", 2
    return _bounded(d.pattern) if d.value else _unicode(d.pattern), d.value


def _token(category: str, n: str) -> str:
    return f"'[{category.upper()}_' || CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END || ']'"


def _stages(source: str, name: str) -> str:
    """CTEs ``name``0 to ``name``12: every rule on the text that the one before it left."""
    start = "CAST([] AS STRUCT(category VARCHAR, value VARCHAR, token VARCHAR, rule_ord INTEGER)[])"
    out = [f"{name}0 AS (SELECT *, coalesce(text, '') AS masked, {start} AS seen FROM {source})"]
    for i, d in enumerate(D.DETECTORS):
        pattern, group = _rule(d)
        pattern, kind = _text(pattern), f"s.category = '{d.category}'"

        def free(v: str) -> str:
            if not d.value:
                return f"{v} IS NOT NULL"
            test = f"NOT regexp_full_match(trim({v}, ' '), {_text(D.PLACEHOLDER)})"
            return f"{test} AND NOT regexp_matches({v}, {_text(_unicode(D.PUBLIC_TERM))})" if d.guarded else test

        out.append(rf"""{name}{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (m, v, p, own, fresh, masked), CASE WHEN len(m) = 0 THEN masked ELSE array_to_string(list_transform(p, lambda a, k: a || coalesce(
    CASE WHEN {free("v[k]")} THEN replace(m[k], v[k], struct_extract(list_filter(seen, lambda s: {kind} AND s.value = v[k])[1], 'token')) ELSE m[k] END, '')), '') END AS masked
  FROM (SELECT * REPLACE (list_concat(seen, list_transform(fresh, lambda x, k: {{'category': '{d.category}', 'value': x, 'token': {_token(d.category, "(len(own) + k)")}, 'rule_ord': {i}}})) AS seen)
  FROM (SELECT *, list_filter(v, lambda x, k: list_position(v, x) = k AND {free("x")} AND NOT list_contains(own, x)) AS fresh
  FROM (SELECT *, list_transform(list_filter(seen, lambda s: {kind}), lambda s: s.value) AS own, regexp_extract_all(masked, {pattern}, 0) AS m, regexp_extract_all(masked, {pattern}, {group}) AS v,
    string_split_regex(masked, {pattern}) AS p FROM {name}{i}))))""")
    return ",\n".join(out)


def _renamed(text: str) -> str:
    holder = _text(D.PLACEHOLDER)
    one = f"regexp_extract_all({text}, {holder})[k]"
    named = f"struct_extract(list_filter(names, lambda y: y.token = {one})[1], 'placeholder')"
    return f"CASE WHEN names IS NOT NULL AND contains({text}, '[') THEN array_to_string(list_transform(string_split_regex({text}, {holder}), lambda a, k: a || coalesce({named}, {one}, '')), '') ELSE {text} END"


_LAST = f"z{len(D.DETECTORS)}"
_IDENTIFYING = f"len(list_filter(seen, lambda s: s.category IN ({', '.join(map(_text, D.IDENTIFYING))}))) > 0"
_TESTS = {
    "secret": (f"regexp_matches(body, {_text(_bounded(D.SECRET))})", 1),
    "marker": (f"(regexp_matches(body, {_text(_bounded(D.MARKERS[0]))}) OR regexp_matches(body, {_text(D.MARKERS[1])}))", 3),
    "identifier": (_IDENTIFYING, 2),
    "legal": (f"regexp_matches(body, {_text(_bounded(D.LEGAL_ENTITY))})", 2),
    "many": (f"len(seen) >= {masking.MANY}", 2),
}
_FOUND = ", ".join(f"CASE WHEN {test} THEN {_text(masking.FINDINGS[k])} END" for k, (test, _) in _TESTS.items())
_SCORE = ", ".join(f"CASE WHEN {test} THEN {weight} ELSE 0 END" for test, weight in _TESTS.values())


def _tokens(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length({text}) / 4) AS INTEGER)) END"


def _masked(source: str) -> str:
    """CTEs of P0: z, the numbers of each value in its set, ledger, and documents."""
    joined = "chr(1) || s.category || chr(2) || s.value || chr(3)"
    return rf"""source AS ({source}),
{_stages("source", "z")},
said AS (SELECT review_id, doc_ord, seen, unnest(seen) AS s, generate_subscripts(seen, 1) AS pos FROM {_LAST}),
vals AS (SELECT review_id, doc_ord, doc_ord * 1000000 + pos AS place, s.category AS category, s.token AS token, s.value AS value, CASE WHEN contains(s.value, '[') THEN
  list_reduce(list_concat([s.value], list_transform(seen, lambda s: s.token || chr(4) || {joined})), lambda acc, x: replace(acc, split_part(x, chr(4), 1), split_part(x, chr(4), 2))) ELSE s.value END AS spelt FROM said),
numbered AS (SELECT review_id, category, spelt, place, value, CAST(row_number() OVER (PARTITION BY review_id, category ORDER BY place) AS INTEGER) AS n
  FROM (SELECT review_id, category, spelt, min(place) AS place, arg_min(value, place) AS value FROM vals GROUP BY ALL)),
called AS (SELECT *, '[' || upper(category) || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ']' AS placeholder FROM numbered),
local AS (SELECT review_id, doc_ord, list({{'token': token, 'placeholder': placeholder}}) AS names FROM vals JOIN called USING (review_id, category, spelt) GROUP BY ALL),
ledger AS (SELECT c.review_id, placeholder, {_renamed("c.value")} AS original, category, n FROM called c LEFT JOIN local l ON l.review_id = c.review_id AND l.doc_ord = c.place // 1000000),
named AS (SELECT z.* REPLACE ({_renamed("z.masked")} AS masked), coalesce(text, '') AS body FROM {_LAST} z LEFT JOIN local USING (review_id, doc_ord)),
scored AS (SELECT *, greatest({_SCORE}) AS score, substring(masked, 1, {masking.OUTBOUND_CHARS}) AS outbound_text,
  list_filter([{_FOUND}, CASE WHEN length(masked) > {masking.OUTBOUND_CHARS} THEN {_text(masking.FINDINGS["truncated"])} END], lambda x: x IS NOT NULL) AS findings FROM named),
documents_ AS (SELECT *, CASE WHEN score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS outbound_risk, {_tokens("outbound_text")} AS estimated_input_tokens FROM scored)"""


_TALKS = "SELECT conv_id AS review_id, CAST(turn AS INTEGER) AS doc_ord, role || '-' || turn AS name, text FROM conversations"
_DOCS = "SELECT CAST(floor(doc_id / 20) AS BIGINT) AS review_id, CAST(doc_id % 20 AS INTEGER) AS doc_ord, 'doc' || doc_id || ['.txt', '.md', '.csv', '.pdf'][doc_id % 4 + 1] AS name, text FROM documents"

ORACLES["p0_mask_documents"] = f"""WITH {_masked(_TALKS)} SELECT review_id, doc_ord, outbound_text, substring(masked, 1, {masking.PREVIEW_CHARS}) AS sanitized_excerpt, CAST(len(seen) AS INTEGER) AS n_replacements,
findings, estimated_input_tokens, outbound_risk FROM documents_"""
ORACLES["p0_mask_corpus"] = f"WITH {_masked(_DOCS)} SELECT review_id, doc_ord, name, outbound_text, outbound_risk, estimated_input_tokens FROM documents_"
ORACLES["w1_ledger"] = f"WITH {_masked(_DOCS)} SELECT * FROM ledger"
ORACLES["w2_continue_placeholders"] = f"""WITH {_masked(_TALKS)},
more AS (SELECT conv_id AS review_id, upper(role[1]) || lower(role[2:]) AS value, min(turn) AS first FROM conversations GROUP BY ALL),
fresh AS (SELECT m.*, coalesce((SELECT max(n) FROM ledger l WHERE l.review_id = m.review_id AND l.category = 'company'), 0) AS last FROM more m
  WHERE NOT EXISTS (FROM ledger l WHERE l.review_id = m.review_id AND l.category = 'company' AND l.original = m.value)),
added AS (SELECT review_id, value, CAST(last + row_number() OVER (PARTITION BY review_id ORDER BY first, value) AS INTEGER) AS n FROM fresh)
SELECT review_id, placeholder, original, category, n FROM ledger UNION SELECT review_id, {_token("company", "n")}, value, 'company', n FROM added"""

_REASON_TESTS = {
    "identifier": _IDENTIFYING,
    "label": f"regexp_matches(body, {_text(_unicode(gate.CUSTOMER))}) AND NOT ({_IDENTIFYING})",
    "topology": f"regexp_matches(body, {_text(_unicode(gate.TOPOLOGY))}) AND outbound_risk <> 'low'",
    "credential": "(contains(lower(body), 'password') OR contains(lower(body), 'token') OR contains(lower(body), 'secret'))",
    "risk": "outbound_risk = 'high'",
}


def _told(which: int) -> str:
    found = ", ".join(f"CASE WHEN {test} THEN {_text(gate.REASONS[k][which])} END" for k, test in _REASON_TESTS.items())
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


_LABELLED = "CASE decision " + " ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in gate.LABELS.items()) + " END"
_GATED = f"""{_masked(_DOCS)},
asked AS (SELECT *, regexp_matches(body, {_text(_unicode(gate.MARKER))}) AS marked, {_told(0)} AS why, {_told(1)} AS todo FROM documents_),
judged AS (SELECT *, CASE WHEN marked OR outbound_risk = 'high' THEN 'block' WHEN len(why) > 0 THEN 'mask_and_continue' ELSE 'safe' END AS decision,
  CASE WHEN marked THEN {_list([gate.REASONS["marker"][0]])} WHEN len(why) > 0 THEN why ELSE {_list([gate.REASONS["safe"][0]])} END AS reasons,
  CASE WHEN marked THEN {_list([gate.REASONS["marker"][1]])} WHEN len(why) > 0 THEN todo ELSE {_list([gate.REASONS["safe"][1]])} END AS actions FROM asked),
noted AS (SELECT *, list_concat(findings, list_transform(reasons, lambda r: 'ローカル機密度ゲート: ' || {_LABELLED} || '. ' || r)) AS notes FROM judged)"""
ORACLES["p2_p20_release_gate"] = f"""WITH {_GATED} SELECT review_id, doc_ord, CASE WHEN decision = 'safe' AND length(text) > {gate.JUDGED_CHARS} THEN 'mask_and_continue' ELSE decision END AS decision, reasons, actions, outbound_risk,
list_filter(notes, lambda x, k: list_position(notes, x) = k) AS findings, CAST(len(seen) AS INTEGER) AS n_replacements FROM noted"""
ORACLES["p20_set_summaries"] = f"""WITH {_GATED} SELECT review_id, CAST(sum(len(seen)) AS BIGINT) AS replacements,
CASE WHEN bool_or(outbound_risk = 'high') THEN 'high' WHEN bool_or(outbound_risk = 'medium') THEN 'medium' ELSE 'low' END AS max_outbound_risk, CAST(sum(estimated_input_tokens) AS BIGINT) AS estimated_input_tokens,
count(*) FILTER (decision = 'safe') AS n_safe, count(*) FILTER (decision = 'mask_and_continue') AS n_mask_and_continue, count(*) FILTER (decision = 'block') AS n_block, CAST(0 AS BIGINT) AS n_unknown,
CASE WHEN bool_or(decision = 'block' OR outbound_risk = 'high') THEN 'blocked' WHEN bool_or(decision = 'mask_and_continue') THEN 'confirmation_required' ELSE 'safe' END AS status FROM noted GROUP BY review_id"""

_NAMES = "|".join(APPROVED)
_ODD = ", ".join(f"regexp_extract_all(masked, {_text(p)})" for p in UNAPPROVED)
ORACLES["p17_merged_masker_output"] = rf"""WITH {_masked(_TALKS)},
told AS (SELECT review_id, doc_ord, regexp_replace(regexp_replace(text || ' [SITE_1] ***', '\[({_NAMES})_(\d)\]', '[\1_00\2]', 'g'), '\[({_NAMES})_(\d\d)\]', '[\1_0\2]', 'g') AS text FROM source WHERE doc_ord % 2 = 0),
{_stages("told", "y")},
again AS (SELECT review_id, doc_ord, masked AS t, list_sort(list_distinct(flatten([{_ODD}]))) AS odd FROM y{len(D.DETECTORS)}),
merged AS (SELECT d.*, t, coalesce(trim(t, ' '), '') <> '' AS used, list_concat(findings, ['checked'], CASE WHEN len(odd) > 0 THEN ['Unapproved placeholders: ' || array_to_string(odd, ', ')] ELSE [] END) AS notes
  FROM documents_ d LEFT JOIN again USING (review_id, doc_ord))
SELECT review_id, doc_ord, CASE WHEN used THEN t ELSE outbound_text END AS outbound_text, CASE WHEN used THEN list_filter(notes, lambda x, k: list_position(notes, x) = k) ELSE findings END AS findings,
CASE WHEN used AND outbound_risk = 'low' THEN 'medium' ELSE outbound_risk END AS outbound_risk FROM merged"""

ORACLES["r2_mask_stream"] = f"""WITH source AS ({_TALKS}), {_stages("source", "z")}
SELECT review_id, doc_ord, name, masked AS outbound_text, CAST(len(seen) AS INTEGER) AS n_replacements, {_tokens("masked")} AS estimated_input_tokens FROM {_LAST}"""
