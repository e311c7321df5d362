"""The corpus pipeline: each stage, and run(), against plain Python on a small table with hard cases."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from inkveil.llm import decontaminate
from tests.llm.test_operators import LOWER, WORD, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, component string, findings string"
SAID = {"de": ["der", "und", "straße", "nicht", "schön", "wetter", "heute", "morgen"], "fr": ["le", "être", "garçon", "pas", "très", "demain", "maison", "soir"]}
ITEM = "what is the name of the river that flows through the old town and under the stone bridge"


def edit_distance(item, text):
    """The least edit distance of item to any stretch of text."""
    cost = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(cost[j - 1] + (word != other), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    say = lambda lang, n: " ".join(rng.choice(SAID[lang]) + str(rng.randint(0, 30)) * (rng.random() < 0.5) for _ in range(n))
    texts = [(say(k, rng.randint(30, 80)), k) for _ in range(30) for k in ("de", "fr")]
    base = texts[0][0]
    near = base.split()
    near[10] = "geändert"
    item = ITEM.split()
    del item[3]
    texts += [(base, "de"), (" ".join(near), None), (texts[1][0].upper(), "fr"), (say("de", 20) + " " + ITEM.upper(), "de"), (say("fr", 20) + " " + " ".join(item), None)]
    texts += [(say("de", 30) + " password=abcdef123 " + say("de", 5), "de"), (None, "de"), ("", None), ("12 34 ...", "fr"), (say("fr", 4000), "fr")]
    out = [(i, t, k, None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, (t, k) in enumerate(texts)]
    out += [out[4], (5, say("de", 40), "de", "s1", 1, "x", "y", "z"), (None, say("fr", 40), "fr", "s1", 1, "x", "y", "z")]
    return out


def ids(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())


def test_stages_and_run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "source_mix"]
    key = lambda r: (r[0] if r[0] is not None else -1, r[1] or "")

    # without a letter there is no language; all others are of the two languages or clearly nearer to one of them
    want = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == sorted(map(key, want))

    # the least doc_id of each component; equal rows once
    now = spark.createDataFrame(rows, SCHEMA)
    component = {(d, n): c for d, n, c in brute_components([(r[0], r[1]) for r in rows if r[0] != 5], 5, 80, 100)}
    one = {key(r) for r in rows if r[0] is None or r[0] == 5 or any(c == r[0] for (d, _), c in component.items() if d == r[0])}
    kept = stages["near_duplicates"](spark, now, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == sorted(one)

    dirty = lambda t: edit_distance(words(ITEM), words(t)) <= int(len(words(ITEM)) * decontaminate.RATE)
    kept = stages["decontamination"](spark, now, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == sorted(key(r) for r in rows if not dirty(r[1]))
    assert sum(dirty(r[1]) for r in rows) == 2

    kept = stages["secret_scan"](spark, now, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == sorted((key(r)[0], key(r)[1].replace("password=abcdef123", "[SECRET]")) for r in rows)

    found = stages["source_mix"](spark, now, str(tmp_path)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in found) == sorted((key(r)[0], len(words(r[1]))) for r in rows)

    # all of them, one after the other
    alive = [r for r in dict.fromkeys(want) if key(r) in one and not dirty(r[1])]
    found = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in found) == sorted(key(r)[0] for r in alive)
    assert abs(sum(r["taken"] for r in found) - 1.5 * sum(r["size"] for r in found)) <= 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
