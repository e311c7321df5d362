"""Queries on matching, sets of any size, streams that go on, dictionaries, and what callers bring, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import detectors as D
from inkveil.operators import audit, budget, dictionary, gate, masking, matching, plugins, replies, structure
from inkveil.plans import tables as T
from inkveil.plans.mask_oracles import _DOCS, _GATED, _masked
from inkveil.plans.oracles import _FINDINGS, _text
from inkveil.plans.queries import _LOG_SQL, ORACLES, query
from inkveil.sources import dictionaries
from inkveil.sources.scratch import materialised, scratch_dir
from inkveil.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- names in texts

# a: texts with an id; names: the first one to three words of the conversations, so that names begin and contain others
_NAMES_SQL = """a AS (SELECT conv_id, turn, text, array_slice(string_split(text, ' '), 1, 3) AS w FROM conversations WHERE text IS NOT NULL),
names AS (SELECT DISTINCT array_to_string(w[1:k], ' ') AS name FROM a, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k AND length(array_to_string(w[1:k], ' ')) > 0),
sizes AS (SELECT DISTINCT length(name) AS size FROM names),
heads AS (SELECT DISTINCT name[1:3] AS h FROM names),
every AS (SELECT conv_id, turn, text, CAST(unnest(range(1, length(text) + 1)) AS INTEGER) AS i FROM a),
here AS MATERIALIZED (SELECT * FROM every WHERE substring(text, i, 3) IN (FROM heads) OR substring(text, i, 2) IN (FROM heads) OR substring(text, i, 1) IN (FROM heads)),
best AS MATERIALIZED (SELECT conv_id, turn, i, max(size) AS size FROM here, sizes WHERE i + size <= length(text) + 1 AND EXISTS (FROM names WHERE name = substring(text, i, size)) GROUP BY ALL)"""


def _talk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.split("text", " "), 1, 3)
    each = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    return T.table(spark, sf_dir, "conversations").filter("text is not null").select(F.explode(each).alias("text")).filter("text <> ''").distinct()


@query(f"""WITH RECURSIVE {_NAMES_SQL},
picked AS (SELECT conv_id, turn, min({{'i': i, 'size': size}}) AS p FROM best GROUP BY ALL
  UNION ALL SELECT b.conv_id, b.turn, min({{'i': b.i, 'size': b.size}}) FROM picked q JOIN best b ON b.conv_id = q.conv_id AND b.turn = q.turn AND b.i >= q.p.i + q.p.size GROUP BY ALL)
SELECT conv_id, turn, substring(text, p.i, p.size) AS name, CAST(p.i - 1 AS INTEGER) AS start, CAST(p.i - 1 + p.size AS INTEGER) AS "end" FROM picked JOIN a USING (conv_id, turn)""")
def j4_longest_names(spark, sf_dir):
    """All places of names in conversations; of names that overlap the first, then the longest."""
    said = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return matching.longest_matches(said, _talk_names(spark, sf_dir)).select("conv_id", "turn", F.col("phrase_text").alias("name"), "start", "end")


@query(f"""WITH {_NAMES_SQL} SELECT conv_id, name, count(*) AS turns FROM a JOIN names ON contains(text, name) GROUP BY ALL""")
def j4_many_phrases(spark, sf_dir):
    """In how many turns of a conversation each name stands, within longer ones too."""
    said = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return matching.contained_phrases(said, _talk_names(spark, sf_dir)).groupBy("conv_id", F.col("phrase_text").alias("name")).agg(F.count(F.lit(1)).alias("turns"))


@query("""WITH q AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT '')
SELECT q.name AS text, count(s.s_name) AS hits, coalesce(list(s.s_name ORDER BY s.s_name) FILTER (s.s_name IS NOT NULL), [])[1:5] AS top_names, CASE WHEN q.name = '' THEN 'empty query' ELSE '' END AS error
FROM q LEFT JOIN (SELECT 'Branch of ' || n_name || ' no ' || s_suppkey AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON q.name <> '' AND contains(s.s_name, q.name) GROUP BY q.name""")
def j5_registry_lookup(spark, sf_dir):
    """Hits and first names of a registry for uncertain candidates; nations whose name begins another's have hits there too."""
    nations = T.table(spark, sf_dir, "nation")
    asked = nations.select(F.col("n_name").alias("text")).unionAll(nations.limit(1).select(F.lit("  "))).withColumn("confirmed", F.lit(False))
    registry = T.table(spark, sf_dir, "supplier").join(nations.hint("merge"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Branch of "), "n_name", F.lit(" no "), F.col("s_suppkey").cast("string")).alias("name"))
    return dictionary.registry_lookup(asked, registry)


# what a model might take for names: parts, technical terms in full width and brackets, rejected forms
_TERMS = ("【ＶＰＣ】", "・Amazon SES エンドポイント", "Amazon Japan", "AWS Summit", "ｒｅｄ　ｗｉｄｇｅｔ", "3.1 構成図", "DMARC1; p", "foo foo", "（red ring）", "Kubernetes", "山田太郎")
_KEPT = ("Amazon Japan", "AWS Summit", "（red ring）", "山田太郎")


@query(f"""WITH p AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name AS text FROM p WHERE p_name NOT LIKE '%widget' UNION ALL SELECT unnest([{", ".join(map(_text, _KEPT))}]))
SELECT c_custkey AS review_id, text, 'ner' AS source FROM customer CROSS JOIN t UNION ALL SELECT c_custkey, 'Kubernetes', 'seed_dict' FROM customer""")
def j2_outside_candidates(spark, sf_dir):
    """Candidates from outside the dictionaries lose terms of the list (widgets of all colours) and technical forms; the dictionary's own stay."""
    parts = T.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    listed = parts.filter(F.col("text").like("%widget")).select(F.lit(None).cast("string").alias("customer_id"), F.lit("goods").alias("category"), F.lower("text").alias("term_norm"))
    terms = parts.unionAll(spark.createDataFrame([(t,) for t in _TERMS], "text string")).withColumn("source", F.lit("ner"))
    terms = terms.unionAll(spark.createDataFrame([("Kubernetes", "seed_dict")], "text string, source string"))
    # dealt out before they are crossed, as each customer becomes a row for each term
    customers = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review_id")).repartition(8 * spark.sparkContext.defaultParallelism)
    every = customers.crossJoin(F.broadcast(materialised(terms)))  # a fixed list and the names of parts
    return dictionary.without_tech_terms(every, listed)


# --- sets of any size

_ONE_SET = "SELECT CAST(0 AS BIGINT) AS review_id, CAST(doc_id AS INTEGER) AS doc_ord, 'doc' || doc_id AS name, text FROM documents"


@query(f"WITH {_masked(_ONE_SET)} SELECT * FROM ledger")
def w1_ledger_of_one_set(spark, sf_dir):
    """All documents as one set, numbered by ranges."""
    docs = T.table(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("review_id"), F.col("doc_id").cast("int").alias("doc_ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    return masking.number_sets(materialised(masking.masked_text(docs)))[1]


@query("""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS t FROM documents),
w AS (SELECT doc_id, k, t, 1 AS n, t AS total, 1 AS batch FROM d WHERE k = 1
  UNION ALL SELECT d.doc_id, d.k, d.t, CASE WHEN w.n >= 6 OR w.total + d.t > 2500 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 6 OR w.total + d.t > 2500 THEN d.t ELSE w.total + d.t END, w.batch + CASE WHEN w.n >= 6 OR w.total + d.t > 2500 THEN 1 ELSE 0 END
  FROM w JOIN d ON d.k = w.k + 1)
SELECT 0 AS review_id, batch, list('doc' || doc_id ORDER BY doc_id) AS document_names, count(*) AS call_count, CAST(sum(t) AS BIGINT) AS total_input_tokens FROM w GROUP BY batch""")
def w12_batches_of_one_set(spark, sf_dir):
    """All documents as one set, packed in blocks."""
    docs = T.gated_docs(spark, sf_dir).select(F.lit(0).alias("review_id"), F.col("doc_id").alias("doc_ord"), "name", F.col("estimated_input_tokens").alias("call_input_tokens"))
    return budget.pack_batches(docs, tokens=2500)


ORACLES["s22_payload_parts"] = f"""WITH {_FINDINGS},
l AS (SELECT review_id, doc_ord, string_agg(label, chr(10) ORDER BY chapter_ord) AS labels FROM c GROUP BY ALL),
p AS (SELECT review_id, row_number() OVER s AS part, '文書 ' || row_number() OVER s || '/' || count(*) OVER (PARTITION BY review_id) || ': ' || name || chr(10) || text || chr(10) || labels AS text
  FROM d JOIN l USING (review_id, doc_ord) WINDOW s AS (PARTITION BY review_id ORDER BY doc_ord)),
r AS (SELECT review_id, concat_ws(' ', severity, kind, chapter_name, item_name) AS line, row_number() OVER (PARTITION BY review_id ORDER BY list_position(['high', 'medium', 'low', 'info'], severity), kind, chapter_id NULLS FIRST, item_id NULLS FIRST) AS k FROM f),
g AS (SELECT review_id, string_agg(line, chr(10) ORDER BY k) FILTER (k <= 20) AS findings, count(*) - 20 AS more FROM r GROUP BY review_id)
SELECT review_id, part, text FROM p UNION ALL SELECT review_id, (SELECT max(part) FROM p WHERE p.review_id = g.review_id) + 1, concat_ws(chr(10) || chr(10), findings, CASE WHEN more > 0 THEN 'n more: ' || more END) FROM g"""


@query(ORACLES["s22_payload_parts"])
def s22_payload_parts(spark, sf_dir):
    """Payloads as ordered parts, one document each."""
    docs = T.designs(spark, sf_dir)
    return replies.payload_parts(docs.select("review_id", "doc_ord", "name", F.col("text").alias("outbound_text")), structure.check_structure(docs))


# --- streams

# two files of the log: what came in time, and every fifth decision, which came when the first file was done
_LATE_SQL = f"""WITH {_LOG_SQL}, m AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM log WHERE event_id % 5 <> 0),
kept AS (SELECT date_trunc('day', ts) AS day, * FROM log, m WHERE event_id % 5 <> 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)"""


def _totals_of_two_runs(spark: SparkSession, sf_dir: str, make) -> tuple[str, DataFrame]:
    """Runs the job on what came in time, and once more when the late file is there; the folder of its results and what it computes."""
    root, out = _folder(spark, "log"), _folder(spark, "totals")
    rows = T.decisions(spark, sf_dir)
    for late in (False, True):
        part = rows.filter((F.col("event_id") % 5 == 0) == F.lit(late)).drop("event_id").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
        part.write.mode("append").options(**audit.WRITTEN).json(root)
        totals = make(jobs.read_decision_stream(spark, root))
        jobs.upsert_totals(totals, out).trigger(availableNow=True).start().awaitTermination()
    return out, totals


@query(f"""{_LATE_SQL}, t AS (SELECT day, customer_id, term, count(*) FILTER (decision = 'mask') AS mask_count, count(*) AS total, min(ts) AS first_seen, max(ts) AS last_seen FROM kept GROUP BY ALL)
SELECT *, CASE WHEN total < 5 THEN 'insufficient_data' WHEN mask_count / total >= 0.9 THEN 'promote_seed_mask' WHEN mask_count / total <= 1.0 - CAST(0.9 AS DOUBLE) THEN 'promote_seed_skip' ELSE 'context_dependent' END AS recommendation FROM t""")
def r1_late_rows(spark, sf_dir):
    """R1 in update mode by days: rows that come later than the watermark are dropped, others change what stood there."""
    out, totals = _totals_of_two_runs(spark, sf_dir, lambda rows: jobs.windowed_totals(rows, late="3 days").withColumn("day", F.col("window.start")).drop("window"))
    return jobs.current_totals(spark, out, totals.schema, ("day", "customer_id", "term")).drop("mask_ratio")


@query(f"""WITH {_LOG_SQL}, t AS (SELECT customer_id, term, count(*) FILTER (decision = 'mask') AS mask_count, count(*) AS total, min(ts) AS first_seen, max(ts) AS last_seen FROM log GROUP BY ALL)
SELECT *, CASE WHEN total < 5 THEN 'insufficient_data' WHEN mask_count / total >= 0.9 THEN 'promote_seed_mask' WHEN mask_count / total <= 1.0 - CAST(0.9 AS DOUBLE) THEN 'promote_seed_skip' ELSE 'context_dependent' END AS recommendation FROM t""")
def r1_updated_totals(spark, sf_dir):
    """R1 in update mode: each batch writes the terms that it changed; the newest row of a term counts, compacted too."""
    out, totals = _totals_of_two_runs(spark, sf_dir, jobs.decision_totals)
    jobs.compact_totals(spark, out, totals.schema)
    return jobs.current_totals(spark, out, totals.schema).drop("mask_ratio")


@query(f"WITH {_masked(_DOCS)} SELECT * FROM ledger")
def r2_ledger_of_open_sets(spark, sf_dir):
    """Sets whose documents arrive in two batches, with the job stopped and started in between; the ledger is that of whole sets."""
    root, source = _folder(spark, "open"), _folder(spark, "docs")
    for first in (True, False):
        T.review_docs(spark, sf_dir).filter((F.col("doc_ord") < 12) == F.lit(first)).write.mode("append").parquet(source)
        rows = spark.readStream.schema("review_id long, doc_ord int, name string, text string").parquet(source)
        jobs.mask_open_sets(rows, root).trigger(availableNow=True).start().awaitTermination()
    return jobs.masked_sets(spark, root)[1]


# --- dictionaries and what callers bring


@query("""WITH n AS (SELECT n_nationkey AS k, upper(n_name[1]) || lower(n_name[2:]) AS text, n_name AS canonical FROM nation)
SELECT NULL AS customer_id, text, 'GPE' AS label, canonical, k % 2 = 0 AS confirm FROM n WHERE k % 3 <> 0 UNION ALL SELECT 'c1', text, 'GPE', NULL, true FROM n WHERE k % 3 = 0
UNION ALL SELECT 'broken', 'seeds-2.json', NULL, NULL, NULL""")
def s11_dictionary_files(spark, sf_dir):
    """Names in files, common ones and those of customer c1; a broken file is told, another customer's is not opened."""
    root = _folder(spark, "names")
    n = T.table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))

    entry = lambda *more: F.to_json(F.collect_list(F.struct(F.initcap("n_name").alias("text"), F.lit("gpe").alias("label"), *more)))
    names = {}
    names["common"] = n.filter("k % 3 <> 0").agg(entry(F.col("n_name").alias("canonical"), (F.col("k") % 2 == 0).alias("confirm")))
    names["customers/c1"] = n.filter("k % 3 = 0").agg(entry())
    names["customers/c2"] = n.limit(1).select(F.lit('[{"text": "Elsewhere", "label": "ORG"}]'))
    for place, rows in names.items():
        _saved(spark, rows, f"{root}/{place}/seeds.json")
    _saved(spark, n.limit(1).select(F.lit('[{"text": "cut off')), f"{root}/common/seeds-2.json")
    seeds, broken = dictionaries.read_seed_files(spark, root, "c1")
    told = broken.select(F.lit("broken").alias("customer_id"), F.element_at(F.split("path", "/"), -1).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("canonical", "string"), ("confirm", "boolean"))])
    return seeds.unionByName(told)


def _saved(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """One row of text as a file of that name."""
    rows.coalesce(1).write.text(f"{path}.parts")
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = make(f"{path}.parts")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    files.rename(part, make(path))
    files.delete(folder, True)


@query("""SELECT NULL AS customer_id, 'goods' AS category, lower(p_name) AS term_norm FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'c1', 'user', unnest(['aws', '構成図'])""")
def s12_allow_files(spark, sf_dir):
    """Terms in files by category, and a customer's plain list; a term of both is the common one, full width and brackets go."""
    root = _folder(spark, "terms")
    parts = T.table(spark, sf_dir, "part").select("p_name").distinct()
    _saved(spark, parts.agg(F.to_json(F.create_map(F.lit("goods"), F.collect_list(F.upper("p_name"))))), f"{root}/common/allow.json")
    _saved(spark, parts.agg(F.to_json(F.concat(F.array(F.lit("ＡＷＳ"), F.lit("【構成図】"), F.lit("  ")), F.collect_list("p_name")))), f"{root}/customers/c1/allow.json")
    return dictionaries.read_allow_files(spark, root, "c1")[0]


_RULES_SQL = "SELECT c_custkey AS review_id, 0 AS doc_ord, '[GRADE_001] of ' || CASE WHEN n.n_nationkey > 3 THEN '[NATION_002]' ELSE '[NATION_001]' END || ' and ' || CASE WHEN n.n_nationkey < 3 THEN '[NATION_002]' ELSE '[NATION_001]' END AS masked"


@query(f"""{_RULES_SQL} FROM customer JOIN nation n ON c_nationkey = n.n_nationkey UNION ALL SELECT -1, 0, 'bad' UNION ALL SELECT -1, 1, 'empty' UNION ALL SELECT -1, 2, 'none'""")
def x2_rules_of_a_table(spark, sf_dir):
    """Detectors made of rows; a broken pattern and one without its group are told and left out."""
    nations = T.table(spark, sf_dir, "nation")
    rows = nations.select((F.col("n_nationkey") + 10).cast("int").alias("rule_ord"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("rule"), F.lit("nation").alias("category"), F.concat(F.lit(r"\b"), "n_name", F.lit(r"\b")).alias("pattern"), F.lit(0).alias("value_group"), F.lit(False).alias("guarded"))
    more = [(1, "G", "grade", r"(grade): ([A-Z]+ Customer#\d+)", 2, False), (2, "bad", "x", "(unclosed", 0, False), (3, "none", "x", "a(b)", 2, False), (4, "empty", "x", "z*", 0, False)]
    rules = rows.unionAll(spark.createDataFrame(more, rows.schema))
    found, bad = plugins.detectors_of(rules, ())
    told = spark.createDataFrame([(-1, i, name) for i, (name, _) in enumerate(sorted(bad))], "review_id long, doc_ord int, masked string")
    docs = T.table(spark, sf_dir, "customer").join(nations.hint("merge"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("review_id"), F.lit(0).alias("doc_ord"), F.concat(F.lit("grade: A "), "c_name", F.lit(" of "), "n_name", F.lit(" and NATION_3")).alias("text"))
    return masking.masked_text(docs, found).select("review_id", "doc_ord", F.regexp_replace("masked", "^grade: ", "").alias("masked")).unionAll(told)


def _local_model(texts: list[str]) -> list[str | None]:
    """What a caller might bring: it can't take texts with a digit, and its answer is JSON."""
    import json

    if any(c.isdigit() for t in texts for c in t):
        raise RuntimeError("no digits, please")
    return [json.dumps({"sanitized_text": f"checked: {t}", "findings": ["checked"], "outbound_risk": "low"}) for t in texts]




@query("""SELECT conv_id AS review_id, CAST(turn AS INTEGER) AS doc_ord, regexp_matches(coalesce(text, ''), '[0-9]') AS failed, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'RuntimeError: no digits, please' END AS error,
CASE WHEN NOT regexp_matches(coalesce(text, ''), '[0-9]') THEN length(coalesce(text, '')) + 9 END AS reply_chars FROM conversations""")
def x3_x5_answers(spark, sf_dir):
    """A caller's function in batches; a text on which it fails fails alone."""
    said = plugins.answered(T.talks(spark, sf_dir), _local_model)
    read = replies.parse_masker_response(said.filter("not failed").select("review_id", "doc_ord", "reply"))
    read = read.select("review_id", "doc_ord", F.length("sanitized_text").alias("reply_chars"))
    return said.select("review_id", "doc_ord", "failed", "error").join(read.hint("merge"), ["review_id", "doc_ord"], "left")


@query(f"""WITH {_GATED} SELECT review_id, doc_ord, CASE WHEN doc_ord % 3 = 0 AND decision <> 'block' THEN 'block' WHEN doc_ord % 3 = 1 AND decision <> 'block' THEN 'safe' ELSE decision END AS decision,
CASE WHEN doc_ord % 3 < 2 AND (decision <> 'block' OR doc_ord % 3 = 0) THEN ['told: ' || name] ELSE reasons END AS reasons, CASE WHEN doc_ord % 3 = 0 OR (doc_ord % 3 = 1 AND decision <> 'block') THEN 'caller' ELSE 'rules' END AS judged_by FROM judged""")
def x4_callers_judgement(spark, sf_dir):
    """A caller's expressions decide on two thirds of the documents; elsewhere they are null, and the rules' judgement stays, as it does where rules block."""
    documents, _, _ = masking.mask_documents(T.review_docs(spark, sf_dir))
    own = F.when(F.col("doc_ord") % 3 == 0, "block").when(F.col("doc_ord") % 3 == 1, "safe")
    told = plugins.judged(gate.assess_sensitivity(documents), {"decision": own, "reasons": F.when(own.isNotNull(), F.array(F.concat(F.lit("told: "), "name")))})
    return told.select("review_id", "doc_ord", "decision", "reasons", "judged_by")
