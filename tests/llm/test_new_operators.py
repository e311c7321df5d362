"""Toxicity, phrase mining and centroid clustering against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkveil.llm import centroids, phrases, sampling, toxicity

DOCS = "doc_id long, text string, lang string"


# --- phrases


def _plain(rows, least, top, longest=5):
    """All phrases counted in one dictionary, by the definition."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _mined(spark, rows, least, top, **more):
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, least, top, **more).collect())


def _prose(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    fixed = ["alpha beta gamma", "New York City hall", "da da da", "x y", "Été à Paris"]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(rng.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize(("least", "top", "share"), [(4, 1000, 0.125), (3, 12, 0.1), (3, 5, 0.02)])
def test_phrases_equal_counting_all(spark, least, top, share):
    rows = [*_prose(1, 150), ("en", None), ("en", ""), (None, "alpha beta gamma"), *[("de", "ein Satz, ein Satz; noch ein Satz")] * 5]
    got = _mined(spark, rows, least, top, share=share)
    assert got == _plain(rows, least, top)
    assert {r[0] for r in got} == {"en", "fr", "und", "de"}


def test_phrases_settle_early_without_losing_any(spark, monkeypatch):
    # rare pairs score highest; few words need be open, and what is never counted could not have come in
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice([f"r{rng.randint(0, 9)} s{rng.randint(0, 1)}", "the of", "of the", "the the"]) for _ in range(60))) for _ in range(60)]
    limits = []
    seen = phrases._opened
    monkeypatch.setattr(phrases, "_opened", lambda words, langs: limits.append(langs.first()["upto"]) or seen(words, langs))
    assert _mined(spark, rows, 5, 4, share=0.05) == _plain(rows, 5, 4)
    assert len(limits) <= 3


def test_phrases_of_hot_and_long_texts_and_repeated_rows(spark):
    rows = [("en", "same line here again. " * 3)] * 40 + [("en", "left right " * 5000)] + [("en", "z" * 5000 + " left right")] * 4
    assert _mined(spark, rows, 4, 100) == _plain(rows, 4, 100)


def test_phrases_ties_go_by_count_then_bytes(spark):
    rows = [("en", "b c. B C; a d! é f? a d\x0bé f")] * 4
    got = _mined(spark, rows, 2, 2)
    assert got == _plain(rows, 2, 2) and [r[2] for r in got] == ["a d", "b c"]


def test_phrases_of_an_empty_table_and_other_columns(spark):
    assert _mined(spark, [], 1, 5) == []
    docs = spark.createDataFrame([("en", "a b a b", 1, 2, "x")], "lang string, text string, f int, code int, phrase string")
    assert [r["phrase"] for r in phrases.collocations(docs, 2, 5).collect()] == ["a b"]


def test_words_that_share_a_code_get_another_seed(spark, monkeypatch):
    asked = []
    real = phrases.word_counts

    def once(docs, seed, least):
        asked.append(seed)
        counts = real(docs, seed, least)
        if seed:
            return counts
        from inkveil.sources.scratch import materialised
        from pyspark.sql import functions as F

        return materialised(counts.withColumn("shared", F.lit(True)))

    monkeypatch.setattr(phrases, "word_counts", once)
    rows = [("en", "a b c a b c")] * 3
    assert _mined(spark, rows, 2, 10) == _plain(rows, 2, 10) and asked == [0, 1]


# --- centroids


def _lloyd(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(now)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, n, d in last:
        each[n] += d
    return sorted(((i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, n, d in last), key=str)


def _clustered(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((tuple(r) for r in centroids.clustered(table).collect()), key=str)


def test_centroids_equal_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.4, 64).astype(np.float32)]) for i in range(300)]
    rows += [(300, None), (301, rows[0][1][:63]), (302, [None] + rows[0][1][1:]), (303, [math.nan] + rows[0][1][1:]), (304, [math.inf] + rows[0][1][1:])]
    rows += [(1000, rows[7][1])] * 90 + [(None, rows[3][1]), (7, rows[9][1])]
    assert _clustered(spark, rows) == _lloyd(rows)


def test_centroids_of_ties_few_and_no_vectors(spark):
    flat = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert _clustered(spark, flat) == _lloyd(flat)
    few = flat[:3]
    assert _clustered(spark, few) == _lloyd(few)
    assert _clustered(spark, []) == []


def test_centroids_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 3e5, 64).astype(np.float32)]) for i in range(60)]
    assert _clustered(spark, rows) == _lloyd(rows)
    # beyond 2**27 a distance may not fit a long: such rows take no part
    assert _clustered(spark, [*rows, (99, [3e9] * 64)]) == _lloyd(rows)


def test_progressive_search_equals_all_distances():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-9, 9, (500, 64)), rng.integers(-9, 9, (16, 64))
    c[5] = c[3]
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    of, distance = centroids.nearest(x, c)
    assert (of == every.argmin(1)).all() and (distance == every.min(1)).all()
    plain = centroids.walsh_hadamard(np.eye(64, dtype=np.int64))
    assert (plain @ plain.T == 64 * np.eye(64)).all()


# --- toxicity


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]


FILL, INSULTS, GROUPS = _words(11, 60), _words(12, 3), _words(13, 3)


def _talk(seed, n):
    """Only an insult next to a group is toxic; several insults, or several groups, are not."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        told = [[rng.choice(INSULTS), rng.choice(GROUPS)], rng.sample(INSULTS, 2), rng.sample(GROUPS, 2), []][i % 4]
        words = [rng.choice(FILL) for _ in range(rng.randint(4, 12))] + told
        rng.shuffle(words)
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


def test_pairs_of_terms_are_learned_that_additive_weights_miss():
    told, asked = _talk(1, 6000), _talk(2, 800)
    model = toxicity.train([t for t, _ in told], [y for _, y in told])
    import pyarrow as pa

    p = model.scores(*toxicity.lowered(pa.array([t for t, _ in asked])))
    y = np.array([y for _, y in asked])
    assert (p[y == 1] >= 0.7).mean() > 0.95 and (p[y == 0] >= 0.7).mean() < 0.02
    # additive weights: two insults, and two groups, must stay below what one of each reaches, which no weights do
    alone = toxicity.ToxicityModel(model.terms, model.weights, np.zeros_like(model.factors), model.bias, True)
    q = alone.scores(*toxicity.lowered(pa.array([t for t, _ in asked])))
    best = max(((q >= c) == y).mean() for c in np.unique(q))
    assert ((p >= 0.5) == y).mean() > 0.97 and best < 0.9


def test_model_scores_as_the_definition_says():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = ["idiota", "clown", "ab", "çaèé", "longerword"]
    told = [(" ".join(rng.choice(words, 6)), i % 2) for i in range(40)]
    model = toxicity.train([t for t, _ in told], [y for _, y in told])
    terms, _, _ = toxicity.pieces_of(*toxicity.lowered(pa.array([" ".join(words)])))
    model = toxicity.ToxicityModel(np.unique(terms[terms != 0]), rng.normal(size=len(np.unique(terms[terms != 0]))), rng.normal(size=(len(np.unique(terms[terms != 0])), 8)) * 0.3, -1.0, True)
    text = "Clown, ab AB unknown longerworld çaèé"
    per_word = {w: toxicity.pieces_of(*toxicity.lowered(pa.array([w])))[0] for w in ("clown", "ab", "unknown", "longerworld", "çaèé")}
    own = sorted({int(np.searchsorted(model.terms, t)) for ts in per_word.values() for t in ts if t in model.terms})
    z = model.bias + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
    assert model.scores(*toxicity.lowered(pa.array([text])))[0] == pytest.approx(1 / (1 + math.exp(-z)))
    # a long text scores as its worst piece; words beyond it don't dilute
    long = "unknown " * 5000 + text + " unknown" * 5000
    assert model.scores(*toxicity.lowered(pa.array([long])))[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_on_hard_tables(spark):
    told = _talk(5, 6000)
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(told)), (9001, None), (9002, ""), (9003, "1 2 3"), (None, told[0][0])], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, (_, y) in enumerate(told)), (9001, 1), (None, 1), (5, None), (77777, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs.selectExpr("*", "1 as h", "2 as _text"), model).collect()}
    assert len(got) == len(told) + 4
    assert got[9001]["score"] == got[9002]["score"] == got[9003]["score"] < 0.7 and got[None]["score"] == got[0]["score"]
    assert np.mean([got[i]["predicted"] == y for i, (_, y) in enumerate(told)]) > 0.9
    one = toxicity.fit(docs, labels.filter("label = 1"))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, one).collect()} == {(0.5, 0)}
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs, none).agg({"score": "max"}).first()[0] == 0.5


def test_samples_keep_texts_beside_many_copies(spark):
    from pyspark.sql import functions as F

    copies = spark.range(20_000).select(F.lit("one text that is repeated").alias("text"), F.lit("xx").alias("lang"))
    others = spark.range(60).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("xx").alias("lang"))
    rows = copies.unionAll(others).withColumn("h", F.xxhash64("text"))
    assert len(sampling.least_hashed(rows, "lang", 1500, "text")) == 61
    assert len(sampling.least_hashed(rows, "lang", 40, "text")) == 40


def test_columns_may_be_called_as_internal_ones(spark):
    from inkveil.llm import decontaminate, language, lm, quality

    rows = [(i, f"{w} {w} text number {i} of this kind", w, "x", i) for i in range(40) for w in ("aa", "zz")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, _text string, _hash int")
    kept = ("doc_id", "_text", "_hash")
    assert language.predict(docs, language.fit(docs), kept, prefix="_of_").columns == [*kept, "_of_lang_pred", "_of_score"]
    assert language.predict(docs, language.fit(docs), kept).select("_text").distinct().collect()[0][0] == "x"
    labels = docs.selectExpr("doc_id", "cast(lang = 'aa' as int) as label")
    assert quality.score(docs, quality.fit_by_id(docs, labels), kept).filter("_text = 'x'").count() == 80
    assert toxicity.score(docs, toxicity.fit(docs, labels), kept).filter("_text = 'x'").count() == 80
    model, counts = lm.fit(docs)
    assert lm.score(docs, model, counts, kept).filter("_text = 'x'").count() == 80
    items = docs.limit(1).selectExpr("1 as item_id", "'text number 3 of this kind zz' as text")
    assert "_text" in decontaminate.contaminated(docs, items, keep=kept).columns


def test_quality_gives_both_labels_the_same_weight(spark):
    from inkveil.llm import quality

    rng = random.Random(1)
    good, bad = (["".join(rng.choice(a) for _ in range(6)) for _ in range(40)] for a in ("abcdefgh", "rstuvwxy"))
    texts = lambda words, n: [" ".join(rng.choice(words) for _ in range(60)).encode() for _ in range(n)]
    few, many = texts(bad, 40), texts(good, 600)
    model = quality.train({1: many, 0: few})
    p = model.scores([*texts(bad, 50), *texts(good, 50)])
    assert (p[:50] < 0.5).mean() > 0.9 and (p[50:] >= 0.5).mean() > 0.9
    # half way between the labels is even, however many there are of each
    x = np.concatenate([np.random.default_rng(0).normal(-1, 1, 4000), np.random.default_rng(1).normal(1, 1, 200)])
    intercept, slope = quality._logistic(x, np.array([1.0] * 4000 + [0.0] * 200))
    assert slope < 0 and abs(intercept) < 0.3
