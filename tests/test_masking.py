"""Masking against a plain Python twin, and properties of ledgers."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions import detectors as D
from inkveil.operators import masking

DATA = "/root/testdata/sf0.001"
FIXTURE = [
    "hostname tokyo-rtr-01\npassword superSecret!\n10.0.0.1 and 10.0.0.2, 10.0.0.1\nsnmp-server community public",
    "社外秘 10.0.0.2 10.0.0.9\n顧客名: 東京商事\n案件名：新基盤\n担当者: yamada@example.com\n変更番号: CHG-1, 連絡先: 佐藤",
    "fe80::1 and ::1 and 2001:db8:0:0:0:0:0:1 mac 00:11:22:33:44:55 https://a.example/x?y=1",
    "customer: Amazon SES\nvendor: ACME Inc.\nuse vendor SMTP AUTH\nprd.db_12 combat-01 localhost-01",
    "token: abc token=abc key = [IPV4_009]",
    "",
]


def python_pattern(java: str) -> re.Pattern:
    flags = 0
    if m := re.match(r"\(\?([a-zA-Z]+)\)", java):
        java = java[m.end():]
        flags = (re.I if "i" in m[1] else 0) | (re.M if "m" in m[1] else 0)
    return re.compile(java, flags)


def twin(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Rules in order, each on the text that the ones before left."""
    numbers: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    for d in D.DETECTORS:
        public = python_pattern(D.PUBLIC_TERM)

        def put(m):
            value = m.group(d.value)
            if d.value and re.fullmatch(D.PLACEHOLDER, value.strip()) or d.guarded and public.fullmatch(value):
                return m.group(0)
            if (d.category, value) not in numbers:
                counts[d.category] = counts.get(d.category, 0) + 1
                numbers[d.category, value] = f"[{d.category.upper()}_{counts[d.category]:03d}]"
            return m.group(0).replace(value, numbers[d.category, value])

        text = python_pattern(d.pattern).sub(put, text)
    return text, list(numbers)


def test_stages_equal_the_twin(spark):
    rows = spark.createDataFrame(list(enumerate(FIXTURE)), "id int, text string")
    for r in masking.masked_text(rows).collect():
        text, values = twin(FIXTURE[r["id"]])
        assert r["masked"] == text
        assert [(s["category"], s["value"]) for s in r["seen"]] == values


def test_corpus_equals_the_twin(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for r in masking.masked_text(rows).collect():
        assert r["masked"] == twin(r["text"] or "")[0]


def test_numbers_run_through_a_set(spark):
    rows = spark.createDataFrame([("r", i, f"d{i}", t) for i, t in enumerate(FIXTURE[:2])] + [("q", 0, "n", None)], "review_id string, doc_ord int, name string, text string")
    documents, ledger, mentions = masking.mask_documents(rows)
    second = documents.filter("review_id = 'r' and doc_ord = 1").first()
    assert "[IPV4_002] [IPV4_003]" in second["outbound_text"] and second["outbound_risk"] == "high"
    pairs = [(r["review_id"], r["category"], r["original"], r["placeholder"]) for r in ledger.collect()]
    assert len({p[:3] for p in pairs}) == len({(p[0], p[3]) for p in pairs}) == len(pairs)
    assert mentions.count() == 12
    assert documents.filter("review_id = 'q'").first()["outbound_text"] == ""


def test_continued_ledger(spark):
    ledger = spark.createDataFrame([("r", "[COMPANY_002]", "A", "company", 2)], "review_id string, placeholder string, original string, category string, n int")
    values = spark.createDataFrame([("r", "company", "A", 0), ("r", "company", "B", 5), ("r", "site", "X", 1)], "review_id string, category string, value string, first int")
    assert {(r["original"], r["placeholder"]) for r in masking.continue_placeholders(ledger, values).collect()} == {("A", "[COMPANY_002]"), ("B", "[COMPANY_003]"), ("X", "[SITE_001]")}


@pytest.mark.parametrize(("sample", "found"), [("tokyo-rtr-01", True), ("fw-1", True), ("PRD.DB_12", True), ("combat-01", False), ("gemma-4-31b", False)])
def test_bare_hostnames(sample, found):
    assert bool(python_pattern(D.HOSTNAME_BARE).search(sample)) is found


def test_texts_that_are_not_searched_have_no_match(spark):
    """Marks and shapes of the detectors, and the words that stand for patterns, leave out no text with a match, letters that fold to ASCII ones included."""
    from inkveil.functions.text import folded
    from inkveil.operators import gate

    parts = ("fw-01", "bK-7", "ipſ_3", "apı.2", "sw-٣", "::1", "1:2:3:4:5:6:7:8", "fe80::", "a:b", "aa:bb:cc:dd:ee:ff", "aa-bb-cc-dd-ee-ff", "x@y.zz", "https://a", "Owner： Jo Li", "Client = Ab Cd", "顧客名:山田", "Acme Foo Inc.", "Acme Ltd", "株式会社山田", "Co", "CONFİDENTIAL", "confıdential", "ſite name", "RACK", "機密", "Kacheless", "key: abc", "ſecret=x1", "3.5", "Project: Zeta", "Ticket= INC-7", "1.2.3.4", "hostname: h1")
    rows = [(i, t) for i, t in enumerate([*parts, *(f"x {a} y {b}" for a in parts for b in parts[::3]), *(f"{a}{b}" for a in parts[::2] for b in parts)])]
    t = F.col("text")
    tests = {d.rule: (d.found_in(t), t.rlike(d.pattern)) for d in D.DETECTORS}
    tests |= {"legal": (D.has_legal_entity(t), t.rlike(D.LEGAL_ENTITY)), "marker": (D.has_marker(t, folded(t)), t.rlike(D.MARKERS[0]) | t.rlike(D.MARKERS[1]))}
    tests |= {k: (gate.has_any(folded(t), gate._words(p)), t.rlike(p)) for k, p in (("m", gate.MARKER), ("c", gate.CUSTOMER), ("t", gate.TOPOLOGY))}
    found = spark.createDataFrame(rows, "id int, text string").select(*[F.count_if(a != b).alias(f"differs_{k}") for k, (a, b) in tests.items()], *[F.count_if(b).alias(f"found_{k}") for k, (_, b) in tests.items()]).first()
    assert all(v == 0 for k, v in found.asDict().items() if k.startswith("differs")), found
    assert all(v > 0 for k, v in found.asDict().items() if k.startswith("found")), found


def test_a_set_is_summed_up_over_texts_that_are_judged_once(spark):
    from inkveil.operators import gate

    docs = spark.createDataFrame([(1, 0, "a.txt", "confidential"), (1, 1, "b.txt", "plain"), (2, 0, "c.txt", None)], "review_id long, doc_ord int, name string, text string")
    plan = gate.release_gate(docs)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS _legal#") == plan.count(" AS _plain#") == 1
