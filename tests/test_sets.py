"""Matching, ranking, packing, streams, dictionaries and what callers bring, against plain Python."""

import json
import os
import random
from collections import Counter

import pytest

from inkveil.operators import audit, budget, dictionary, gate, masking, matching, plugins, ranking, remediation
from inkveil.sources import dictionaries
from inkveil.sources.scratch import scratch_dir
from inkveil.streaming import jobs
from pyspark.sql import functions as F

DOCS = "review_id string, doc_ord int, name string, text string"


def scanned(text, names):
    """Leftmost, then longest, one place after the other."""
    by_size, at, out = sorted({len(n) for n in names}, reverse=True), 0, []
    while at < len(text):
        for size in by_size:
            if text[at : at + size] in names and len(text[at : at + size]) == size:
                out.append((at, at + size, text[at : at + size]))
                at += size
                break
        else:
            at += 1
    return out


def found(spark, texts, names):
    docs = spark.createDataFrame([*enumerate(texts)], "id int, text string").repartition(3)
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "text string, k int")
    return sorted((r["id"], r["start"], r["end"], r["phrase_text"]) for r in matching.longest_matches(docs, table).collect())


def wanted(texts, names):
    return sorted((i, *m) for i, t in enumerate(texts) for m in scanned(t or "", set(names) - {""}))


NESTED = ["NTT", "NTTデータ", "データ", "東京", "東京都", "京都", "a", "ab", "bc", "\\E.x", "😀b", ""]
NESTED_TEXTS = ["NTTデータとNTTのデータ", "東京都東京京都東京都", "abcababc", "a\\E.x\\E.xx", "😀bab😀", "", None, "nothing else", "NTT" * 300]


def test_nested_adjacent_and_repeated_names(spark):
    assert found(spark, NESTED_TEXTS, NESTED) == wanted(NESTED_TEXTS, NESTED)


def test_shards_find_what_one_automaton_finds(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARD_NAMES", 2)
    texts = [*NESTED_TEXTS, NESTED_TEXTS[0], NESTED_TEXTS[2]]
    assert found(spark, texts, NESTED) == wanted(texts, NESTED)
    # equal rows are matched each
    docs = spark.createDataFrame([(1, "abcab")] * 3, "id int, text string")
    names = spark.createDataFrame([(n,) for n in NESTED], "text string")
    assert Counter(r["start"] for r in matching.longest_matches(docs, names).collect()) == {0: 3, 3: 3}


def test_a_hundred_thousand_names(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9))) for _ in range(120_000)})[:100_000]
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    assert found(spark, texts, names) == wanted(texts, names)


def test_no_names_no_texts_and_facts_of_names(spark):
    assert found(spark, ["abc"], []) == [] and found(spark, [], ["a"]) == []
    docs = spark.createDataFrame([(7, "x", "ab")], "id int, start string, text string").withColumnRenamed("start", "from")
    names = spark.createDataFrame([("a", "ORG"), ("a", "GPE")], "text string, label string")
    assert sorted(r["phrase_label"] for r in matching.longest_matches(docs, names).collect()) == ["GPE", "ORG"]
    both = matching.contained_phrases(docs, spark.createDataFrame([("a",), ("ab",), ("b",)], "text string"))
    assert sorted((r["phrase_text"], r["start"]) for r in both.collect()) == [("a", 0), ("ab", 0), ("b", 1)]


def test_a_name_within_a_longer_one_is_no_candidate(spark):
    rows = spark.createDataFrame([("r", 0, "a", "NTTデータ だけ"), ("r", 1, "b", "NTTデータ と NTT")], DOCS)
    seeds = dictionary.load_seeds(spark, [{"text": "NTT", "label": "ORG"}, {"text": "NTTデータ", "label": "ORG"}])
    got = sorted((r["doc_ord"], r["text"], r["start"]) for r in dictionary.seed_candidates(rows.drop("name"), seeds).collect())
    assert got == [(0, "NTTデータ", 0), (1, "NTT", 9), (1, "NTTデータ", 0)]


def test_names_with_signs_of_patterns_are_masked(spark):
    rows = spark.createDataFrame([("r", 0, "a", r"uses \E(x)[1]$ and a.b, not axb")], DOCS)
    seeds = dictionary.load_seeds(spark, [{"text": r"\E(x)[1]$", "label": "ORG"}, {"text": "a.b", "label": "PERSON"}])
    documents, ledger, _ = masking.mask_documents(rows)
    none = spark.createDataFrame([], "review_id string, doc_ord int, text string, mask boolean")
    masked, _, _ = dictionary.dictionary_mask(documents.select("review_id", "doc_ord", "outbound_text"), ledger, dictionary.seed_candidates(rows.drop("name"), seeds), none)
    assert masked.first()["outbound_text"] == "uses [COMPANY_001] and [PERSON_001], not axb"


# --- sets of any size


def test_ranks_and_sums_of_a_group_that_holds_all(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(3000)] + [(None, i, 1) for i in range(5)] + [("few", 1, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, o int, v int").repartition(8)
    got = {(r["g"], r["o"]): (r["n"], r["s"]) for r in ranking.ranked(table, ["g"], ["o"], sums={"s": "v"}).collect()}
    want, sums = {}, Counter()
    for g, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        sums[g] += v or 0
        want[g, o] = (sum(1 for k in want if k[0] == g) + 1 if g != "hot" else o + 1, sums[g])
    assert got == want


def test_one_set_is_numbered_in_many_tasks(spark):
    docs = spark.createDataFrame([(0, i, f"d{i}", f"mail a{i % 700}@x{i}.example and 10.0.{i % 250}.7") for i in range(1500)], "review_id int, doc_ord int, name string, text string").repartition(6)
    masked = masking.masked_text(docs)
    ledger = masking.number_sets(masked)[1]
    seen, want = {}, {}
    for r in masked.orderBy("doc_ord").collect():
        for s in r["seen"]:
            own = seen.setdefault(s["category"], {})
            own.setdefault(s["value"], len(own) + 1)
    want = {(c, v): n for c, own in seen.items() for v, n in own.items()}
    assert {(r["category"], r["original"]): r["n"] for r in ledger.collect()} == want and len(want) == 1750


def packed(ts, calls, tokens):
    out, n, t, batch = [], 0, 0, 0
    for x in ts:
        if n == 0 or n >= calls or t + x > tokens:
            batch, n, t = batch + 1, 1, x
        else:
            n, t = n + 1, t + x
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_batches_of_sets_of_all_sizes(spark, monkeypatch, block):
    monkeypatch.setattr(budget, "BLOCK", block)
    rng = random.Random(block)
    sizes = {"a": 700, "b": 1, "c": 6, "d": 7, "e": 8, "f": 9, "g": 65}
    rows = [(r, i, f"{r}{i}", rng.choice([0, 1, 50, 400, 999, 5000])) for r, n in sizes.items() for i in range(n)]
    got = budget.pack_batches(spark.createDataFrame([*rows, (None, 0, "x", 1)], "review_id string, doc_ord int, name string, call_input_tokens int").repartition(7), 6, 2000).collect()
    want = {}
    for r in sizes:
        own = [x for x in rows if x[0] == r]
        batches = packed([x[3] for x in own], 6, 2000)
        if batches[-1] > 1:
            for x, k in zip(own, batches, strict=True):
                want.setdefault((r, k), []).append(x)
    assert {(r["review_id"], r["batch"]): r["document_names"] for r in got} == {k: [x[2] for x in v] for k, v in want.items()}
    assert all(r["total_input_tokens"] == sum(x[3] for x in want[r["review_id"], r["batch"]]) and r["call_count"] == len(r["document_names"]) for r in got)


def test_remediation_looks_in_the_document_or_in_all_of_the_set(spark):
    fields = ("review_id", "item_id", "title", "severity", "target_document", "target_section", "problem", "fix_policy", "template", "re_review_condition")
    rows = [
        ("r", "1", "rollback", "high", "a", "", "owner", "", "", ""), ("r", "2", "rollback", "high", "gone", "", "owner", "", "", ""),
        ("r", "3", "rollback", "high", "empty", "", "nowhere", "", "", ""), ("r", "4", "", "low", "a", "", "", "", "", ""),
    ]
    items = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    docs = spark.createDataFrame([("r", 0, "a", "the ROLL BACK plan"), ("r", 1, "b", "Owner: x"), ("r", 2, "empty", ""), ("q", 0, "gone", "nowhere")], DOCS)
    got = {r["item_id"]: (r["status"], r["matched_terms"], r["missing_terms"]) for r in remediation.compare_remediation(items, docs).collect()}
    assert got["1"] == ("partial", ["rollback"], ["owner"]) or got["1"][1:] == (["rollback"], ["owner"])
    assert got["2"][1:] == (["rollback", "owner"], []) and got["2"][0] == "improved"
    assert got["3"][1:] == (["rollback"], ["nowhere"]) and got["4"][0] == "needs_review"


# --- streams


def test_late_rows_are_dropped_and_old_state_goes(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"

    def arrive(days, term):
        rows = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", "c", term, "mask") for d in days], "ts string, customer_id string, term string, decision string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").options(**audit.WRITTEN).json(log)

    def run():
        totals = jobs.windowed_totals(jobs.read_decision_stream(spark, log), late="2 days").withColumn("day", F.col("window.start")).drop("window")
        job = jobs.upsert_totals(totals, out).trigger(availableNow=True).start()
        job.awaitTermination()
        return job.recentProgress, {(r["day"].day, r["term"]): r["total"] for r in jobs.current_totals(spark, out, totals.schema, ("day", "customer_id", "term")).collect()}

    arrive([1, 2, 3, 4, 5, 5, 20], "x")
    progress, totals = run()
    assert totals == {(1, "x"): 1, (2, "x"): 1, (3, "x"): 1, (4, "x"): 1, (5, "x"): 2, (20, "x"): 1}
    # the watermark is January 18: only the window of the 20th has state left
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    arrive([5, 17, 18, 20, 21], "x")
    progress, totals = run()
    assert totals[5, "x"] == 2 and (17, "x") not in totals and totals[18, "x"] == 1 and totals[20, "x"] == 2 and totals[21, "x"] == 1
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 2


def test_sets_stay_open_over_batches_and_restarts(spark, tmp_path):
    source, root = f"{tmp_path}/docs", f"{tmp_path}/out"
    schema = "review_id string, doc_ord int, name string, text string"
    batches = [
        [("r", 0, "a", "mail a@x.example, 10.0.0.1"), ("q", 0, "a", "10.9.9.9")],
        [("r", 1, "b", "10.0.0.2 and 10.0.0.1, b@x.example"), ("p", 0, "n", "nothing")],
        [("r", 2, "c", "password: [IPV4_001] a@x.example"), ("q", 1, "b", "10.9.9.9 10.9.9.8")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.mask_open_sets(stream, root).trigger(availableNow=True).start().awaitTermination()
    documents, ledger = jobs.masked_sets(spark, root, "string")
    whole, once, _ = masking.mask_documents(spark.createDataFrame([r for rows in batches for r in rows], schema))
    columns = ["review_id", "placeholder", "original", "category", "n"]
    assert sorted(map(tuple, ledger.select(*columns).collect())) == sorted(map(tuple, once.select(*columns).collect()))
    assert {(r["review_id"], r["doc_ord"]): r["outbound_text"] for r in documents.collect()} == {(r["review_id"], r["doc_ord"]): r["outbound_text"] for r in whole.collect()}
    # a batch that is run again after a failure comes to the same, and leaves no scratch tables
    before = len(os.listdir(scratch_dir(spark)))
    jobs.mask_batch(spark.createDataFrame(batches[2], schema), 2, root)
    assert len(os.listdir(scratch_dir(spark))) == before
    again = jobs.masked_sets(spark, root, "string")[1]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, once.select(*columns).collect()))


# --- what callers bring


def test_dictionary_files(spark, tmp_path):
    def save(path, value):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")

    save("common/seeds.json", [{"text": " ACME ", "label": "org"}, {"text": "", "label": "ORG"}, {"text": "Ｘ社", "label": "ORG", "canonical": "X", "confirm": False}])
    save("common/seeds-more.json", [{"text": "ACME", "label": "ORG"}])
    save("customers/c1/seeds.json", [{"text": "Own", "label": "PERSON", "extra": 1}])
    save("customers/c2/seeds.json", [{"text": "Other", "label": "ORG"}])
    save("customers/c1/seeds-bad.json", '{"no": "list"')
    save("common/allow.json", {"cloud": ["ＶＰＣ", "S3", None], "mail": ["smtp"]})
    save("customers/c1/allow.json", ["vpc", "・Backlog"])
    save("customers/c1/allow-bad.json", {"cloud": "no list"})
    seeds, broken = dictionaries.read_seed_files(spark, str(tmp_path), "c1")
    assert sorted(map(tuple, seeds.collect()), key=str) == sorted([(None, "ACME", "ORG", None, True), (None, "Ｘ社", "ORG", "X", False), ("c1", "Own", "PERSON", None, True)], key=str)
    assert [r["path"].rsplit("/", 1)[1] for r in broken.collect()] == ["seeds-bad.json"]
    terms, broken = dictionaries.read_allow_files(spark, str(tmp_path), "c1")
    assert sorted(map(tuple, terms.collect()), key=str) == sorted([(None, "cloud", "vpc"), (None, "cloud", "s3"), (None, "mail", "smtp"), ("c1", "user", "backlog")], key=str)
    assert [r["path"].rsplit("/", 1)[1] for r in broken.collect()] == ["allow-bad.json"]
    assert dictionaries.read_seed_files(spark, str(tmp_path))[0].count() == 2 and dictionaries.read_seed_files(spark, str(tmp_path), "none")[0].count() == 2
    assert dictionaries.read_seed_files(spark, f"{tmp_path}/nowhere")[0].count() == 0
    with pytest.raises(ValueError):
        dictionaries.read_seed_files(spark, str(tmp_path), "../c2")


def test_rules_of_a_table(spark):
    schema = "rule_ord int, rule string, category string, pattern string, value_group int, guarded boolean"
    rows = [(2, "b", "Order_No", r"order (\d+)", 1, None), (1, "a", "code", "Z[0-9]{3}", None, False), (3, "a", "code", "y", 0, False), (4, "open", "x", "(", 0, False), (5, "group", "x", "x", 1, False), (6, "empty", "x", "x*", 0, False), (7, "cat", "1 2", "x", 0, False), (8, "none", None, "x", 0, False)]
    detectors, bad = plugins.detectors_of(spark.createDataFrame(rows, schema))
    assert [d.rule for d in detectors[12:]] == ["a", "b"] and sorted(name for name, _ in bad) == ["a", "cat", "empty", "group", "none", "open"]
    text = masking.masked_text(spark.createDataFrame([("order 77 of Z123 by 10.0.0.1, order 8",)], "text string"), detectors).first()["masked"]
    assert text == "order [ORDER_NO_001] of [CODE_001] by [IPV4_001], order [ORDER_NO_002]"
    with pytest.raises(ValueError):
        plugins.detectors_of(spark.range(300).selectExpr("cast(id as int) rule_ord", "cast(id as string) rule", "'x' category", "'y' pattern", "0 value_group", "false guarded"))


def test_functions_fail_for_their_texts_alone(spark):
    docs = spark.createDataFrame([("r", i, None if i == 3 else f"text {i}") for i in range(10)], "review_id string, doc_ord int, text string").coalesce(1)

    def reply(texts):
        if "text 7" in texts:
            raise KeyError("seven")
        return [None if t == "" else t.upper() for t in texts]

    got = {r["doc_ord"]: r for r in plugins.answered(docs, reply).collect()}
    assert got[7]["failed"] and got[7]["reply"] is None and "seven" in got[7]["error"]
    assert got[2]["reply"] == "TEXT 2" and not got[2]["failed"] and got[3]["reply"] is None and not got[3]["failed"]
    short = plugins.answered(docs, lambda texts: ["one"] if len(texts) > 1 else texts)
    assert [r["reply"] for r in short.orderBy("doc_ord").collect()] == [f"text {i}" if i != 3 else "" for i in range(10)]


def test_a_callers_judgement(spark):
    docs = [("r", 0, "a", "社外秘 memo"), ("r", 1, "b", "plain words"), ("r", 2, "c", "plain too"), ("r", 3, "d", "担当者が決める")]
    documents, _, _ = masking.mask_documents(spark.createDataFrame(docs, DOCS))
    assessed = gate.assess_sensitivity(documents)
    own = F.when(F.col("doc_ord") == 0, "safe").when(F.col("doc_ord") == 1, "block").when(F.col("doc_ord") == 2, "maybe")
    got = {r["doc_ord"]: r for r in plugins.judged(assessed, {"decision": own, "actions": F.when(F.col("doc_ord") == 1, F.array(F.lit("ask")))}).collect()}
    assert [(got[i]["decision"], got[i]["judged_by"]) for i in range(4)] == [("block", "rules"), ("block", "caller"), ("safe", "rules"), ("mask_and_continue", "rules")]
    assert got[1]["actions"] == ["ask"] and got[1]["reasons"] == assessed.filter("doc_ord = 1").first()["reasons"]
    for bad in ({"decision": F.col("nowhere")}, {"decision": F.lit(1)}, {"reasons": F.lit("x")}, {"decision": own, "reasons": F.lit("x")}):
        with pytest.raises(ValueError):
            plugins.judged(assessed, bad)


def test_short_texts_within_each_other(spark):
    rng = random.Random(5)
    texts = ["", "a", "第 1 章 要件", "第 1 章", "章", "基本設計1.docx", "基本設計12.docx", "計1"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(60)]
    left, right = ([(rng.choice("xy"), t) for t in rng.sample(texts, 50)] for _ in range(2))
    table = lambda rows: spark.createDataFrame([*rows, rows[0], ("x", None)], "k string, text string")
    got = Counter((r["k"], r["left"], r["right"]) for r in matching.containing_pairs(table(left), table(right), ["k"]).collect())
    assert got == {(k, a, b): 1 for k, a in left for j, b in right if j == k and (a in b or b in a)}


def test_each_candidate_text_is_judged_once(spark, tmp_path):
    """Rows of one text share one judgement, so the work on texts does not grow with their rows; null texts and other columns stay."""
    asked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: asked.add(1) or t).asNondeterministic()
    rows = spark.createDataFrame([(i, t, "ner") for i in range(50) for t in ("Kubernetes", "red widget", "山田太郎", None)] + [(0, "Kubernetes", "watchlist")], "k int, text string, source string").coalesce(1)
    listed = spark.createDataFrame([("red widget",)], "term_norm string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dictionary, "nfkc_trim", lambda c: seen(c))
        out = dictionary.without_tech_terms(rows, listed)
        kept = Counter((r["text"], r["source"]) for r in out.collect())
    assert out.columns == rows.columns
    assert kept == {("山田太郎", "ner"): 50, (None, "ner"): 50, ("Kubernetes", "watchlist"): 1}
    assert asked.value < 200  # the rows; each text is normalised for several patterns


def test_texts_are_read_once_by_the_rules_and_profiles_of_sets(spark):
    """A counter in the text's own expression: it must be made once for each text, whatever number of rules, profiles and modes look at it."""
    from inkveil.operators import classify, rules

    made = spark.sparkContext.accumulator(0)

    def text(name):
        made.add(1)
        return {"a.cfg": "interface Gi0/1\nline vty 0 4\nenable password x", "b.py": "password = 'x'\nos.system(y)", "c.md": "目的 rollback"}[name]

    one = F.udf(text)
    docs = spark.createDataFrame([("r", 0, "a.cfg", "network_config"), ("r", 1, "b.py", "source_code"), ("s", 0, "c.md", "change_runbook")], "review_id string, doc_ord int, name string, document_profile string")
    docs = docs.withColumn("text", one("name"))
    rules.rule_review(docs).collect()
    assert made.value == 3
    made.value = 0
    assert {(r["review_id"], r["document_profile"], r["mode"], r["depth"]) for r in classify.classified_modes(docs).collect()} == {("r", "network_config", "config", None), ("s", "change_runbook", "runbook", "formal")}
    assert made.value == 3


def test_rules_give_one_row_for_quiet_sets_of_each_profile(spark):
    from inkveil.operators import rules

    schema = "review_id string, doc_ord int, name string, text string, document_profile string"
    docs = spark.createDataFrame([("q", 0, "a", "", "source_code"), ("q", 1, "b", None, "source_code"), ("n", 0, "c", "telnet", None), ("x", 0, "d", "os.system(a)", "source_code"), ("x", 1, "e", "", "source_code")], schema)
    found = sorted((r["review_id"], r["name"], r["title"], r["issue_id"]) for r in rules.rule_review(docs).collect())
    assert found == [("n", "-", rules.NOTHING.title, "I-001"), ("q", "-", rules.NOTHING.title, "SC-001"), ("x", "d", "危険なコマンド実行の可能性", "SC-001")]


def test_documents_of_one_group_of_rows_are_read_by_more_than_one_task(spark, tmp_path):
    from inkveil.plans import tables

    text = F.expr("array_join(transform(sequence(1, 150), i -> sha2(concat(id, '-', i), 256)), '')")
    spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for made in (tables.designs, tables.review_docs):
        assert made(spark, str(tmp_path)).select(F.length("text"), F.spark_partition_id().alias("p")).agg(F.max("length(text)"), F.countDistinct("p")).first()[1] > 1


def test_texts_are_read_once_by_counts_diagrams_and_summaries(spark):
    """As above; of a set's documents only the first five are read for a summary."""
    from inkveil.functions import detectors
    from inkveil.operators import replies, rules

    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"第 1 章 目的\nhost fw-0{k} 10.0.0.{k}\n第 2 章 範囲\nVLAN {k} dmz\n第 3 章 終わり\nvrf a"

    docs = spark.range(8).select(F.lit("r").alias("review_id"), F.col("id").cast("int").alias("doc_ord"), F.concat(F.lit("d"), "id").alias("name"), F.udf(text)("id").alias("text"))
    counts = {(r["name"], r["category"], r["n"]) for r in detectors.mention_counts(docs.select("name", "text")).collect()}
    assert counts == {(f"d{k}", c, 1) for k in range(8) for c in ("ipv4", "hostname")} and made.value == 8
    made.value = 0
    found = sorted(rules.diagram_signals(docs).collect(), key=lambda r: r["doc_ord"])
    assert found[3]["identifier"] == ["10.0.0.3", "VLAN 3", "vrf a"] and found[3]["zone"] == ["VLAN 3 dmz"] and made.value == 8
    one = replies.local_summary(docs, spark.createDataFrame([("r", "high")], "review_id string, severity string")).first()
    assert one["content_outline"].split("\n") == [f"d{k}: 第 1 章 目的 / 第 2 章 範囲 / 第 3 章 終わり" for k in range(5)]


def test_absent_texts_have_no_identifiers_and_no_counts(spark):
    from inkveil.functions import detectors

    rows = spark.createDataFrame([("a", None), ("b", "vLaN 7, VRF x"), ("c", "none")], "name string, text string")
    assert [r[0] for r in rows.select(detectors.network_identifiers(F.col("text"))).collect()] == [None, ["vLaN 7", "VRF x"], []]
    assert detectors.mention_counts(rows).count() == 0


def test_texts_are_read_once_by_premortems(spark):
    """As above; the text of an issue is made once too, not for each word of a filter that Spark infers."""
    from inkveil.operators import risk

    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"前書き VPN\n第 1 章 監視\nadr{k} xDR\n第 2 章 DR\nRTO rpo 復旧\n第 3 章 終わり\nDR" if k else "MFA"

    docs = spark.range(3).select(F.lit("r").alias("review_id"), F.col("id").cast("int").alias("doc_ord"), F.concat(F.lit("d"), "id").alias("name"), F.udf(text)("id").alias("text"))
    issues = spark.createDataFrame([("r", 0, "low", "a", "plain", "d9", "s"), ("r", 1, "low", "b", "Saml", "d1", "第 2 章"), ("q", 0, "low", "c", "VPN", "", "")], "review_id string, issue_ord int, severity string, title string, details string, source_document string, section string")
    out = risk.premortem(docs, issues)
    found = {r["scenario_id"]: (r["source_document"], r["section"], r["trigger_source"], r["confirmed_elements"], r["review_hint"]) for r in out.collect()}
    assert found == {
        "PM-001": ("d1", "第 2 章 DR", "document", ["RTO/RPO"], []),
        "PM-002": ("d1", "第 1 章 監視", "document", [], []),
        "PM-003": ("d0", "文書全体", "both", ["監視"], ["b"]),
        # VPN stands ahead of all chapters, so none of them is the best one
        "PM-004": ("レビュー対象全体", "文書全体", "document", [], []),
    }
    assert made.value == 3
    assert out._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1


def test_issues_of_one_group_of_rows_are_read_by_more_than_one_task(spark, tmp_path):
    from inkveil.plans import tables

    text = F.expr("array_join(transform(sequence(1, 150), i -> sha2(concat(id, '-', i), 256)), '')")
    rows = spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert tables.issues(spark, str(tmp_path)).select(F.length("issue"), F.spark_partition_id().alias("p")).agg(F.max("length(issue)"), F.countDistinct("p")).first()[1] > 1
