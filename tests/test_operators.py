"""Small fixtures for the other operators."""

from inkveil.functions import text as X
from inkveil.operators import audit, budget, classify, dictionary, gate, masking, remediation, replies, risk, rules, structure
from inkveil.plans import queries, tables
from inkveil.sources import files
from inkveil.streaming import jobs
from pyspark.sql import functions as F

DOCS = "review_id string, doc_ord int, name string, text string"


def test_recommendation_edges(spark):
    rows = spark.createDataFrame([(5, 5), (10, 0), (10, 5), (2, 2), (10, 9), (100, 89), (10, 1)], "total int, masks int")
    found = [r[0] for r in rows.select(audit.recommend(F.col("total"), F.col("masks") / F.col("total"))).collect()]
    assert found == ["promote_seed_mask", "promote_seed_skip", "context_dependent", "insufficient_data", "promote_seed_mask", "context_dependent", "context_dependent"]


def test_gate_decisions(spark):
    docs = [("r", 0, "a", "社外秘 memo"), ("r", 1, "b", "顧客名: 東京商事"), ("r", 2, "c", "plain words"), ("r", 3, "d", "担当者が決める"), ("r", 4, "e", "password superSecret")]
    documents, _, sets = gate.release_gate(spark.createDataFrame(docs, DOCS))
    assert [r["decision"] for r in documents.orderBy("doc_ord").collect()] == ["block", "mask_and_continue", "safe", "mask_and_continue", "mask_and_continue"]
    assert sets.first()["status"] == "blocked" and sets.first()["max_outbound_risk"] == "high"


def test_chapters_and_structure(spark):
    docs = [("r", 0, "a", "第 1 章 はじめに\n目的は基盤\n第 2 章 要件\n機能要件 業務要件 監視 アラート\n第 4 章 ネットワーク\nVPC"), ("q", 0, "c", "1. a\nx\n3. b\n5. c\n7. d"), ("s", 0, "d", "1. はじめに\n目的\n2. 要件\n3. 構成")]
    rows = spark.createDataFrame(docs, DOCS)
    assert [(r["review_id"], r["chapter_id"]) for r in structure.extract_chapters(rows).orderBy("review_id", "chapter_ord").collect()] == [("r", "ch1"), ("r", "ch2"), ("r", "ch4"), ("s", "ch1"), ("s", "ch2"), ("s", "ch3")]
    found = {(r["review_id"], r["kind"], r["chapter_id"]) for r in structure.check_structure(rows).collect()}
    assert ("r", "structure_organization_suggestion", "ch11") in found and ("r", "missing_chapter", "ch3") in found and ("q", "chapter_structure_missing", None) in found
    assert len(structure.standard_items()) == 78 and len(structure.standard_chapters()) == 15


def test_configurations(spark):
    ios = "interface Gi0/1\n ip address 10.0.0.1\ninterface Gi0/2\n!\nline vty 0 4\n transport input telnet\nsnmp-server community x\nenable password y\nip http server\naccess-list 1 permit ip any any"
    forti = 'config firewall policy\n    edit 1\n        set srcaddr "all"\n        set dstaddr "all"\n        set service "ALL"\n        set action accept\n    next\nend'
    rows = spark.createDataFrame([("a", ios), ("b", forti), ("c", "prose")], "name string, text string")
    assert rules.audit_ios(rows).count() == 9
    assert {r["title"] for r in rules.audit_fortios(rows).collect()} >= {rules.WIDE_POLICY.title, rules.UNLOGGED_POLICY.title}
    assert {r["name"]: r["vendor"] for r in rules.config_profile(rows).collect()} == {"a": "cisco_ios", "b": "fortinet_fortios", "c": "unknown"}


def test_code_risks(spark):
    code = "import os\ndef run(event):\n    password = 'x'\n    os.system(cmd)\n    print(event)\n"
    found = {r["title"]: r["evidence"] for r in rules.scan_code_risks(spark.createDataFrame([("a.py", code)], "name string, text string")).collect()}
    assert found["危険なコマンド実行の可能性"].startswith("run 内 / 4行目付近") and "'x'" not in found["ハードコードされた認証情報の疑い"] and len(found) == 3


def test_profiles(spark):
    docs = [("1", 0, "基本設計書.docx", "x"), ("2", 0, "運用手順書.pdf", "x"), ("3", 0, "a.py", "x"), ("4", 0, "設計書.docx", "切戻し"), ("5", 0, "x.txt", "hello"), ("6", 0, "x.bin", "import this")]
    found = {r["review_id"]: (r["document_profile"], r["confidence"]) for r in classify.classify_review_set(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == {"1": ("design", "high"), "2": ("change_runbook", "high"), "3": ("source_code", "high"), "4": ("design", "conflict"), "5": ("design", "medium"), "6": ("source_code", "medium")}


def test_text_risks(spark):
    rows = spark.createDataFrame([("r", 0, "a", "必要に応じて切替する。監視とアラート。")], DOCS)
    one = risk.ambiguous_expressions(rows).first()
    assert one["finding_id"] == "AF-001" and one["severity"] == "medium"
    assert {r["persona"]: r["risk_level"] for r in risk.reader_risks(rows).collect()}["監査人"] == "high"
    none = spark.createDataFrame([], "review_id string, issue_ord int, severity string, title string, details string, source_document string, section string")
    assert {r["scenario_id"] for r in risk.premortem(rows, none).collect()} == {"PM-001", "PM-002"}


def test_dictionary_masking(spark):
    rows = spark.createDataFrame([("r", 0, "a", "NTTデータ と NTT の会議、東京")], DOCS)
    seeds = dictionary.load_seeds(spark, [{"text": "NTT", "label": "ORG"}, {"text": "NTTデータ", "label": "ORG"}, {"text": "東京", "label": "GPE", "confirm": False}, {"text": "会議", "label": "PRODUCT"}])
    documents, ledger, _ = masking.mask_documents(rows)
    found = dictionary.seed_candidates(rows.drop("name"), seeds)
    decisions = spark.createDataFrame([("r", 0, "東京", False)], "review_id string, doc_ord int, text string, mask boolean")
    masked, out, logged = dictionary.dictionary_mask(documents.select("review_id", "doc_ord", "outbound_text"), ledger, found, decisions)
    text = masked.first()["outbound_text"]
    names = {r["original"]: r["placeholder"] for r in out.collect()}
    assert text == f"{names['NTTデータ']} と {names['NTT']} の会議、東京" and logged.count() == 3


def test_many_phrases_go_by_their_first_characters(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "xyz")], "id int, text string")
    phrases = spark.createDataFrame([("c d",), ("yz",), ("no",)], "text string")
    assert sorted((r["id"], r["phrase_text"], r["start"]) for r in dictionary.find_phrases(docs, phrases).collect()) == [(1, "c d", 2), (2, "yz", 1)]


def test_replies(spark):
    good = '```json\n{"summary": {"purpose": "p"}, "issues": [{"severity": "HIGH", "title": "t", "issue": "i"}, {"severity": "severity", "title": "title"}]}\n```'
    rows = spark.createDataFrame([("r", "a", good), ("r", "b", "ISSUE|low|T|D|R|x"), ("r", "c", "nothing")], "review_id string, doc string, reply string")
    issue = replies.parse_issues(rows).collect()
    assert len(issue) == 1 and issue[0]["severity"] == "high" and issue[0]["details"] == "【問題点】i"
    assert {r["title"] for r in replies.parse_pipe_issues(rows.filter("doc <> 'a'")).collect()} == {"T", replies.UNPARSED}


def test_remediation_scores(spark):
    item = {"title": "監視設計 アラート閾値 alpha", "target_section": "", "problem": "", "fix_policy": "", "template": "", "re_review_condition": ""}
    items = spark.createDataFrame([("r", "1", "high", "a", *item.values())], "review_id string, item_id string, severity string, target_document string, title string, target_section string, problem string, fix_policy string, template string, re_review_condition string")
    docs = spark.createDataFrame([("r", 0, "a", "監視 設計 と ALPHA")], DOCS)
    found = remediation.compare_remediation(items, docs).first()
    assert found["status"] == "improved" and found["matched_terms"] == ["監視設計", "alpha"] and found["score"] == 0.667


def test_batches_equal_a_sequential_twin(spark):
    sizes = [12_000, 14_000, 1, 1, 1, 1, 1, 1, 30_000, 5]
    rows = spark.createDataFrame([("r", i, f"d{i}", t) for i, t in enumerate(sizes)], "review_id string, doc_ord int, name string, call_input_tokens int")
    batches, now, total = [], [], 0
    for i, t in enumerate(sizes):
        if len(now) >= 6 or now and total + t > 25_000:
            batches.append(now)
            now, total = [], 0
        now.append(f"d{i}")
        total += t
    assert [r["document_names"] for r in budget.pack_batches(rows).orderBy("batch").collect()] == [*batches, now]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("日本".encode("cp932"))
    (tmp_path / "b.txt").write_bytes("日本".encode())
    assert {r["text"] for r in files.read_text_corpus(spark, str(tmp_path)).collect()} == {"日本"}
    row = spark.createDataFrame([("<p>a &amp; b</p><script>x</script>", 'a,"b,c"\nd')], "html string, text string")
    assert row.select(files.strip_markup(F.col("html"))).first()[0] == "a & b"
    assert files.flatten_csv(row).first()["text"] == "a | b,c\nd"
    assert row.select(X.normalise_placeholders(F.lit("[SITE_1] [URL_22] [X_1]"))).first()[0] == "[SITE_001] [URL_022] [X_1]"


def test_audit_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select '1' schema_version, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) ts, 'u' user_id, concat('c', id % 2) customer_id, 's' session_id, 'd' doc, concat('t', id % 3) term, 'ORG' label, 'x' source, if(id % 2 = 0, 'mask', 'skip') decision, 'c' context from range(20)")
    bad = audit.append_decisions(rows.unionByName(rows.limit(1).withColumn("customer_id", F.lit("../x"))), str(tmp_path / "log"))
    assert bad.count() == 1
    stream = jobs.decision_totals(jobs.read_decision_stream(spark, str(tmp_path / "log")))
    stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    own = lambda df: sorted((r["customer_id"], r["term"], r["mask_count"], r["total"]) for r in df.collect())
    assert own(spark.table("totals")) == own(jobs.decision_totals(audit.read_audit(spark, str(tmp_path / "log"))))


def test_derived_tables_hold_whole_texts(spark, tmp_path):
    texts = {i: "".join(chr(97 + (i + j * j) % 26) for j in range(n)) + "END" for i, n in enumerate((0, 1, 400, 1300, 9001, 20000), 20)} | {26: ""}
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", texts[25])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for r in tables.designs(spark, str(tmp_path)).collect():
        i = int(r["name"].removeprefix("基本設計").removesuffix(".docx"))
        lines = r["text"].split("\n")
        assert "".join(lines[1::3]) == texts[i] and len(lines) == 3 * (i % 12 + 3)
    for r in tables.issues(spark, str(tmp_path)).collect():
        assert r["issue"] + r["details"] + r["recommendation"] == texts[r["issue_ord"]]
    assert texts[25] in str(queries.QUERIES["s18_s21_other_replies"](spark, str(tmp_path)).collect())


def test_bounded_words_match_as_their_pattern_does(spark):
    texts = ["DR", "xDR", "dr.", "ıP ip", "SſLA", "ſLA", "KPI 1", "İP", "İPS", "24時間稼働", "124時間", "DRテストx", "可用性", "é dr é", "", None]
    words = ["DR", "IP", "SLA", "KPI", "24時間", "DRテスト", "可用性", "%"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("x", X.folded(F.col("t")))
    for r in rows.select("t", *[X.has_bounded(F.col("x"), w).alias(f"a{i}") for i, w in enumerate(words)], *[F.col("t").rlike(X.bounded_pattern(w)).alias(f"b{i}") for i, w in enumerate(words)]).collect():
        assert [r[f"a{i}"] for i in range(len(words))] == [r[f"b{i}"] for i in range(len(words))], r["t"]


def test_chapters_are_found_once(spark):
    """Each text is split once for each kind of heading, not again for filters that Spark infers nor for texts without chapters."""
    docs = spark.createDataFrame([("r", "第 1 章 a\nb")], "review_id string, text string")
    plan = structure.extract_chapters(docs, whole=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_words_in_ideographs_are_found_in_the_shortened_text(spark):
    """The same words as in the squeezed text, blanks of all kinds within words and marks between them included."""
    from inkveil.functions.text import cjk_only, is_cjk, squeeze_word, squeezed

    words = sorted({w for rules in (structure.ITEM_WORDS, structure.CHAPTER_WORDS) for found in rules.values() for w in map(squeeze_word, found) if is_cjk(w)})
    bits = [x for w in words[::4] for x in (w, w[:1] + " \n" + w[1:], w[:1] + "　" + w[1:], w[:1] + "x" + w[1:], w[:1] + "１" + w[1:], w[:1] + " . " + w[1:])]
    texts = [*bits, *(f"abc {x}１２{y} z" for x, y in zip(bits, bits[1:])), None, "", " 　 ", "only latin", "😀目😀的", "目 的", "目\u0085的"]
    listed = F.array(*map(F.lit, words))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(squeezed(F.col("text")).alias("s"), cjk_only(F.col("text")).alias("j"))
    one = rows.select(F.filter(listed, lambda w: F.contains("s", w)).alias("a"), F.filter(listed, lambda w: F.contains("j", w)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in one) and sum(len(r["a"]) > 0 for r in one) > 50


def test_heading_lines_are_found_once(spark):
    docs = spark.createDataFrame([("r", "第 1 章 a\nb")], "review_id string, text string")
    plan = structure.extract_chapters(docs, whole=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2


def test_bodies_of_chapters_lose_the_white_space_of_the_pattern(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "t string")
    assert sorted(r["t"] for r in rows.filter(F.col("t").rlike(r"^(?U)\s$") | F.col("t").rlike(r"(?U)^\s+|\s+$")).collect()) == sorted(structure.WHITE_SPACE)
    text = "第 1 章 a　\n\x85b\xa0c  \n\n 　第 2 章 b \r\n第 3 章 c\n😀 ퟿\n​\n"
    found = structure.extract_chapters(spark.createDataFrame([("r", text)], "review_id string, text string")).orderBy("chapter_ord").collect()
    assert [r["body"] for r in found] == ["第 1 章 a　\n\x85b\xa0c", "第 2 章 b", "第 3 章 c\n😀 ퟿\n​"]


def test_words_in_ideographs_are_found_in_their_runs(spark):
    """Plain searches of the words of scenarios and personas: nothing may stand within a word, and marks join no two runs."""
    words = sorted({w for rules in (*risk.PERSONAS.values(), *(s[2] for s in risk.SCENARIOS.values())) for found in rules.values() for w in found if X.is_cjk(w)})
    bits = [x for w in words[::3] for x in (w, "a" + w + "b", w + w[:1], w[:1] + " " + w[1:], w[:1] + "\n" + w[1:], w[:1] + "　" + w[1:], w[:1] + "|" + w[1:], w[:1] + "x" + w[1:])]
    texts = [*bits, *(x + y for x, y in zip(bits, bits[1:])), None, "", "only latin", "😀監視😀"]
    listed = F.array(*map(F.lit, words))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.cjk_runs(F.col("t")).alias("j"))
    one = rows.select(F.filter(listed, lambda w: F.contains("t", w)).alias("a"), F.filter(listed, lambda w: F.contains("j", w)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in one) and sum(len(r["a"] or ()) > 0 for r in one) > 50
