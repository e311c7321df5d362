"""Queries on kinds of documents: classification over all profiles, numbered headings, and the like, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import classify, structure
from inkveil.operators.rules import FORTIOS_SIGNALS, IOS_SIGNALS
from inkveil.plans import tables as T
from inkveil.plans.mask_oracles import _DOCS, _unicode
from inkveil.plans.oracles import _DESIGNS, _list, _text
from inkveil.plans.queries import ORACLES, query
from inkveil.sources.scratch import materialised

# --- profiles and modes


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")" if words else "false"


def _count(tests) -> str:
    return "(" + " + ".join(f"CAST({t} AS INTEGER)" for t in tests) + ")"


_CONFIG_NAME = f"({_any('n', classify.CONFIG_NAMES)} OR ({_any('n', classify.PLATFORMS)} AND {_any('n', classify.CONFIG_WORDS)}) OR (suffix IN ({', '.join(map(_text, classify.CONFIG_SUFFIXES))}) AND {_any('n', classify.PLATFORMS)}))"
_NAMED = "CASE " + " ".join(f"WHEN {_CONFIG_NAME if p == 'network_config' else _any('n', words)} THEN '{p}'" for p, words in classify.NAME_WORDS.items()) + " END"
_FLAGS = {f"i{k}": f"regexp_matches(h, {_text(p)})" for k, p in enumerate(IOS_SIGNALS)} | {f"f{k}": f"contains(h, {_text(s)})" for k, s in enumerate(FORTIOS_SIGNALS)}
_FLAGS |= {p: _any("h", words) for p, words in classify.BODY_WORDS.items()} | {"code": _any("h", classify.CODE_WORDS)}


def _classified(docs: str) -> str:
    """CTEs: classified (review_id, document_profile, confidence, reason) and modes (review_id, document_profile, mode, depth) of docs (review_id, name, text)."""
    names, bodies = list(classify.NAME_WORDS), list(classify.BODY_WORDS)
    suffixes = lambda values: ", ".join(map(_text, values))
    most = "list_sort([" + ", ".join(f"{{'n': n_{p}, 'k': {-k}, 'p': '{p}'}}" for k, p in enumerate(names)) + "])[-1].p"
    config = f"({_count(f'i{k}' for k in range(len(IOS_SIGNALS)))} >= 2 OR {_count(f'f{k}' for k in range(len(FORTIOS_SIGNALS)))} >= 2)"
    by_name = "list_filter([" + ", ".join(f"CASE WHEN n_{p} > 0 THEN '{p}' END" for p in names) + "], lambda x: x IS NOT NULL)"
    by_body = "list_filter([CASE WHEN config THEN 'network_config' END, " + ", ".join(f"CASE WHEN {p} THEN '{p}' END" for p in bodies) + "], lambda x: x IS NOT NULL)"
    cases = [
        ("has_name AND code_files", "'source_code'", "'high'", "code_files"), ("code", "'source_code'", "CASE WHEN n_code = n THEN 'high' ELSE 'medium' END", "code_words"), ("len(names) >= 2", "most", "'conflict'", "several_names"),
        ("len(names) > 0 AND len(bodies) > 0 AND names[1] <> bodies[1]", "names[1]", "'conflict'", "name_against_body"), ("len(names) > 0", "names[1]", "'high'", "name"), ("len(bodies) > 0", "bodies[1]", "'medium'", "body"),
        ("has_name AND design_files AND n_code = 0", "'design'", "'medium'", "extension"),
    ]
    told = lambda which, last: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[which] if which < 3 else _text(c[3])}" for c in cases) + f" ELSE '{last}' END"
    low = "lower(coalesce(text, ''))"
    return rf"""docs AS MATERIALIZED ({docs}),
heads AS (SELECT *, lower(coalesce(name, '')) AS n, regexp_extract(lower(name), '(\.[^.]*)$', 1) AS suffix, lower(coalesce(name, '') || chr(10) || substring(coalesce(text, ''), 1, {classify.HEAD})) AS h, {low} AS low FROM docs),
flags AS (SELECT review_id, name, suffix, {_NAMED} AS named, ({_count(f"contains(low, {_text(w)})" for w in classify.CODE_SIGNALS)} >= 2 OR ({_any("low", classify.CODE_SIGNALS)} AND {_count(f"contains(low, {_text(w)})" for w in classify.CODE_MARKS)} >= 2)) AS like_code,
  {", ".join(f"{test} AS {name}" for name, test in _FLAGS.items())} FROM heads),
gathered AS (SELECT review_id, count(*) AS n, count(*) FILTER (like_code) AS n_code, bool_or(coalesce(name, '') <> '') AS has_name, bool_and(coalesce(name, '') = '' OR suffix IN ({suffixes(classify.CODE_SUFFIXES)})) AS code_files,
  bool_and(coalesce(name, '') = '' OR suffix IN ({suffixes(classify.DESIGN_SUFFIXES)})) AS design_files, {", ".join(f"count(*) FILTER (named = '{p}') AS n_{p}" for p in names)}, {", ".join(f"bool_or({f}) AS {f}" for f in _FLAGS)} FROM flags GROUP BY review_id),
chosen AS (SELECT *, {most} AS most, {by_name} AS names, {by_body} AS bodies FROM (SELECT *, {config} AS config FROM gathered)),
classified AS (SELECT review_id, {told(1, "design")} AS document_profile, {told(2, "low")} AS confidence, {told(3, "default")} AS reason FROM chosen),
sizes AS (SELECT review_id, sum(length(coalesce(text, ''))) AS chars, sum(len(regexp_extract_all(coalesce(text, ''), {_text(_unicode(classify.STEP.replace("(?mU)", "(?U)")).replace("^", "(?m)^", 1))}))) AS steps, bool_or({_any(low, classify.RISK_TERMS)}) AS risky FROM docs GROUP BY review_id),
modes AS (SELECT review_id, document_profile, confidence, reason, CASE WHEN document_profile = 'source_code' THEN 'code' WHEN document_profile = 'network_config' THEN 'config' WHEN document_profile LIKE '%runbook' THEN 'runbook' ELSE 'document' END AS mode,
  CASE WHEN document_profile LIKE '%runbook' THEN CASE WHEN chars <= {classify.LIGHT_CHARS} AND steps >= 2 THEN CASE WHEN risky THEN 'light_high_risk' ELSE 'light' END WHEN risky AND chars <= {classify.FORMAL_CHARS} THEN 'light_high_risk' ELSE 'formal' END END AS depth
  FROM classified JOIN sizes USING (review_id))"""


# the configurations and scripts that tables.py derives, in SQL
_CONFIGS = """SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS review_id, 'cisco-' || o_orderkey || '-config.cfg' AS name, concat_ws(chr(10), 'hostname core-sw-' || o_orderkey, lines, 'line vty 0 4',
  CASE WHEN k % 5 = 0 THEN ' transport input telnet ssh' ELSE ' transport input ssh' END, CASE WHEN k % 7 = 0 THEN 'snmp-server community public RO' END, CASE WHEN k % 3 = 0 THEN 'enable password x1' END, CASE WHEN k % 9 = 0 THEN 'enable secret y2' END,
  CASE WHEN k % 4 = 0 THEN 'ip http server' END, CASE WHEN k % 6 = 0 THEN 'access-list 101 permit ip any any' END, CASE WHEN k % 2 = 0 THEN 'aaa new-model' END, CASE WHEN k % 8 = 0 THEN 'logging host 10.0.0.9' END, CASE WHEN k % 10 = 0 THEN 'ntp server 10.0.0.8' END, 'router ospf 1') AS text
FROM (SELECT *, o_orderkey AS k FROM orders) JOIN (SELECT l_orderkey, string_agg('interface Gi0/' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || ' description to ' || l_returnflag ELSE '' END || chr(10) || '!', chr(10) ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k"""
_SCRIPTS = """SELECT CAST(floor(k / 20) AS BIGINT) AS review_id, 'job' || k || '.py' AS name, concat_ws(chr(10), 'def run_' || k || '(event, context):', CASE WHEN k % 2 = 0 THEN '    print(event)' END, CASE WHEN k % 3 = 0 THEN '    password = "abc123"' END, CASE WHEN k % 5 = 0 THEN '    requests.get(url)' END,
  CASE WHEN k % 7 = 0 THEN '    os.system(cmd)' END, CASE WHEN k % 11 = 0 THEN '    try:' || chr(10) || '        pass' || chr(10) || '    except Exception:' || chr(10) || '        pass' END, CASE WHEN k % 4 = 0 THEN '    requests.post(url, timeout=3, verify=False)' END, CASE WHEN k % 13 = 0 THEN '    run("rm -rf /tmp/x")' END) AS text
FROM (SELECT event_id AS k FROM events)"""
_ALL_KINDS = f"""SELECT 'd' || review_id AS review_id, name, text FROM d UNION ALL SELECT 'c' || review_id, name, text FROM ({_CONFIGS}) UNION ALL SELECT 's' || review_id, name, text FROM ({_SCRIPTS}) UNION ALL SELECT 'r' || review_id, name, text FROM ({_DOCS})"""
ORACLES["p1_p16_classified_sets"] = f"WITH {_DESIGNS}, {_classified(_ALL_KINDS)} SELECT * FROM modes"

# names of all profiles, of none, and without any; openings that speak for one, steps, and risky words
_KINDS = (
    "基本設計書.docx", "Design Spec.md", "企画書.pdf", "Business Case.pptx", "手順書.txt", "運用手順書.pdf", "監視手順.md", "Incident Response.txt", "core-fw running-config.txt", "cisco 設定.txt", "fortigate-1.conf", "deploy.py", "job.sh",
    "notes.txt", "image.png", "", "Runbook v2.md", "移行計画書.xlsx", "architecture.bin", "switch.cfg", "readme.md", "運用設計.docx",
)
_OPENINGS = ("", "ロールバック手順\n", "on-call: team\n", "interface Gi0/1\nrouter ospf 1\n", "config firewall policy\nset srcaddr all\n", "1. stop\n2. reboot\n3. start\n", "1. look\n2. listen\n", "systemctl restart x\n", "{ function x(); }\n", "no-go\n")
# words that make any prose a script are taken apart, so that names and openings decide
_PLAIN = "replace(replace(replace(replace(replace(replace(lower({0}), 'from ', 'fro m '), 'class ', 'clas s '), 'def ', 'de f '), 'sub ', 'su b '), 'import ', 'impor t '), 'except', 'excep t')"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in sets of one to three, with names and openings of all kinds that hang on the id."""
    k = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    set_ = F.floor(k / 3) * 2 + F.when(k % 9 < 2, 1).otherwise(0)
    text = F.concat(pick(_OPENINGS, k * 7 + F.floor(k / 11)), F.expr(_PLAIN.format("text")))
    return T.table(spark, sf_dir, "documents").select(set_.alias("review_id"), pick(_KINDS, k * 5 + F.floor(k / 7)).alias("name"), text.alias("text"))


_KINDS_SQL = f"""SELECT CAST(floor(doc_id / 3) AS BIGINT) * 2 + CASE WHEN doc_id % 9 < 2 THEN 1 ELSE 0 END AS review_id, ({_list(_KINDS)})[CAST((doc_id * 5 + doc_id // 7) % {len(_KINDS)} AS INTEGER) + 1] AS name,
({_list(_OPENINGS)})[CAST((doc_id * 7 + doc_id // 11) % {len(_OPENINGS)} AS INTEGER) + 1] || {_PLAIN.format("text")} AS text FROM documents"""


@query(f"WITH {_classified(_KINDS_SQL)} SELECT * FROM modes")
def p1_p16_all_profiles(spark, sf_dir):
    """Sets whose names and texts speak for every profile, agree or not, with runbooks of all depths."""
    return classify.classified_modes(kinds(spark, sf_dir))


@query(f"WITH {_classified(_KINDS_SQL)} SELECT review_id, {', '.join(f'n_{p}' for p in classify.NAME_WORDS)} FROM gathered")
def a12_names_of_profiles(spark, sf_dir):
    """How many files of a set a profile's names speak for."""
    rows = kinds(spark, sf_dir).select("review_id", classify.name_profile(F.col("name")).alias("p"))
    return rows.groupBy("review_id").agg(*[F.count_if(F.col("p") == p).alias(f"n_{p}") for p in classify.NAME_WORDS])


@query(f"WITH {_classified(_KINDS_SQL)} SELECT review_id, {', '.join(_FLAGS)} FROM gathered")
def a13_signals_of_sets(spark, sf_dir):
    """Signals in the beginnings of a set's documents."""
    rows = classify.body_signals(kinds(spark, sf_dir))
    return rows.groupBy("review_id").agg(*[F.bool_or(c).alias(c) for c in _FLAGS])


# --- numbered headings

# numbers that run on, that leave one out, too many out, begin late, stand still, go beyond the last chapter, and too few of them
_RUNS = ((1, 2, 3, 4), (1, 2, 3, 4, 5, 7), (1, 3, 5, 7), (2, 3, 4), (1, 2, 2, 3), (1, 2, 3, 6), (1, 2), tuple(range(1, 16)), tuple(range(1, 17)), (1, 2, 3, 4, 6, 7, 8, 9, 10, 12))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into sections of equal length under headings `n. title`, their numbers by the document's id."""
    runs = F.array(*[F.array(*map(F.lit, r)) for r in _RUNS])
    run = F.element_at(runs, (F.pmod("doc_id", F.lit(len(_RUNS))) + 1).cast("int"))
    # written, as each part would run the replacement again
    rows = materialised(T.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+|第", " ").alias("t"), run.alias("run")))
    size = F.ceil(F.length("t") / F.size("run")).cast("int")
    parts = F.transform("run", lambda n, i: F.concat(n.cast("string"), F.lit(". title "), n.cast("string"), F.lit("\nbody: "), F.substring(F.col("t"), i * size + 1, size)))
    review, order = F.floor(F.col("doc_id") / 20).alias("review_id"), (F.col("doc_id") % 20).cast("int").alias("doc_ord")
    return materialised(rows.select(review, order, F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.array_join(parts, "\n").alias("text"), "doc_id"))


_RUNS_SQL = "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in _RUNS) + "]"
_NUMBERED_SQL = rf"""t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\s\x0B]+|第', ' ', 'g') AS t, ({_RUNS_SQL})[CAST(doc_id % {len(_RUNS)} AS INTEGER) + 1] AS run FROM documents),
s AS (SELECT doc_id, t, run, CAST(ceil(length(t) / len(run)) AS BIGINT) AS size, list_transform(range(1, len(run)), lambda i: run[i + 1] - run[i]) AS steps FROM t),
c AS (SELECT doc_id, size, t, unnest(run) AS n, unnest(range(0, len(run))) AS i FROM s
  WHERE len(run) >= {structure.LEAST_CHAPTERS} AND run[1] = 1 AND run[-1] <= {structure.LAST_CHAPTER} AND len(list_filter(steps, lambda x: x < 1 OR x > 2)) = 0 AND len(list_filter(steps, lambda x: x = 1)) >= 0.8 * len(steps))"""


@query(f"""WITH {_NUMBERED_SQL} SELECT doc_id, i AS chapter_ord, 'ch' || n AS chapter_id, n AS number, length(trim(n || '. title ' || n || chr(10) || 'body: ' || substring(t, i * size + 1, size))) AS body_chars FROM c""")
def w6_numbered_chapters(spark, sf_dir):
    """Headings `n. title` make chapters only where their numbers run on."""
    found = structure.extract_chapters(numbered(spark, sf_dir))
    return found.select("doc_id", F.col("chapter_ord").cast("long").alias("chapter_ord"), "chapter_id", "number", F.length("body").alias("body_chars"))
