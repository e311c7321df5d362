"""Queries against their DuckDB SQL on the smallest tables."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from inkveil.operators import risk

TABLES = ("orders", "lineitem", "events", "documents", "labels", "nation", "customer", "conversations", "pages", "part", "supplier")
NAMES = ("p4_purpose", "p7_code_evidence", "p10_ambiguous_expressions", "p11_reader_risks", "p13_dictionary_mask", "d_all_detectors", "p2_p20_release_gate", "p17_merged_masker_output", "p9_diagram_signals", "j12_j15_j17_issue_joins", "j4_longest_names", "x3_x5_answers", "s12_allow_files", "p1_p16_all_profiles", "w14_device_pairs", "j17_refuted_claims", "s1_encodings", "s2_uploads", "d13_d15_marks")


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def agrees(spark, name, data, tables):
    db = duckdb.connect()
    for table in tables:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = entry.queries()[name](spark, data)
    told = db.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    rows = told.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert Counter(plain(tuple(r)) for r in found.select(*columns).collect()) == Counter(map(plain, rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    agrees(spark, name, entry.DATA, TABLES)


# every rule of masking, public terms, placeholders that stand there already, umlauts at boundaries, texts without any value
PLANTED = (
    "password: hunter2, key=abc123\nhost 10.0.0.1 and again 10.0.0.1, then 10.0.0.2 by fe80::1 end",
    "Owner: Jane Doe; rest\nProject: Alpha Two\nTicket: INC-77\nCustomer: Acme Foo Inc. and more",
    "顧客名：山田商店、担当者: 佐藤。案件名: 基盤更改\n社外秘",
    "hostname = core-sw-01.example.net mail a.b@mail.example mac aa:bb:cc:dd:ee:ff at fw-01 https://x.example/10.0.0.1/a end",
    "password: [IPV4_001] token = [SECRET_9] and url https://10.0.0.2/x",
    "Service: AWS Lambda\nsystem: VPC\nproject: Alpha Two",
    "Äpassword: no, Acme Coó, ñConfidential: topology rack",
    "",
    None,
    "confidential " + "word " * 4000 + "10.9.9.9",
)


@pytest.mark.parametrize("name", ("w1_ledger", "p0_mask_corpus", "p2_p20_release_gate", "p20_set_summaries"))
def test_masking_of_planted_values_agrees_with_sql(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array([7 * i for i in range(len(PLANTED))], pa.int64()), "text": pa.array(PLANTED, pa.string())}), f"{tmp_path}/documents.parquet")
    agrees(spark, name, str(tmp_path), ["documents"])


def test_names_that_end_a_text_agree_with_sql(spark, tmp_path):
    """A longer name's length must not count where the text is over: the end of the match is that of the name."""
    texts = ("Ab.", "Long name here and Ab.", "x Ab.", "Ab.Ab.", "")
    pq.write_table(pa.table({"conv_id": pa.array(range(len(texts)), pa.int64()), "turn": pa.array([0] * len(texts), pa.int64()), "text": pa.array(texts, pa.string())}), f"{tmp_path}/conversations.parquet")
    agrees(spark, "j4_longest_names", str(tmp_path), ["conversations"])


def test_premortems_of_planted_words_agree_with_sql(spark, tmp_path):
    """Words in all cases and at all kinds of edges, evidence in other documents or issues than the trigger, ties between chapters, sets that say nothing."""
    words = sorted({w for _, triggers, needed, _ in risk.SCENARIOS.values() for group in (triggers, *needed.values()) for w in group})
    edges = (" {} ", "x{}", "{}9", "({})", "{0}{0}", "{}テスト", "é{}é", "_{}_", "1 {}\n", "{}")
    texts = [edges[i % 10].format((w, w.lower(), w.upper(), w.title())[i // 10 % 4]) + " lorem ipsum dolor " * (i % 5) for i, w in enumerate(words * 4)]
    texts += ["Active\nDirectory Active  Directory", "ACTIVE DIRECTORY's", "ſAML KpI TLſ", "DRテストDR", "", None, "　  \n"]
    ids = [3 * i for i in range(len(texts))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": [f"s{i % 4}" for i in ids]}), f"{tmp_path}/documents.parquet")
    some = [i for i in ids if i % 2 == 0]
    pq.write_table(pa.table({"doc_id": pa.array(some, pa.int64()), "quality": pa.array([i % 2 for i in some], pa.int64()), "toxic": pa.array([i % 3 for i in some], pa.int64())}), f"{tmp_path}/labels.parquet")
    agrees(spark, "p12_premortem", str(tmp_path), ["documents", "labels"])
