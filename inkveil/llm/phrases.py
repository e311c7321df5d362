"""Phrase collocation mining: best-first branch-and-bound growth.

For each language, phrases of 2 to ``LONGEST`` words that occur at least ``LEAST`` times are scored by their weakest
cut into two parts, floor(1000 * a * n / (l * r)), and those that a longer phrase explains wholly are dropped. The first
``TOP`` are wanted, so most phrases need never be counted: a cut behind the first word has r >= a, and one before the
last word has l >= a, hence the score is at most floor(1000 * n / f) for f the count of the first word, and of the last.
The frontier of a language is ordered by that bound, which is the order of rising counts: words of a count up to a limit
are open, the rest wait. Phrases grow word by word from open first words (prefixes) and towards open last words
(suffixes); one whose prefix or suffix occurs under ``LEAST`` times is never counted. A language is settled as soon as its
TOP-th surviving score lies above the bound of all words that wait; else its limit is raised to the count whose bound is that score, or,
while fewer than TOP survive, to ``RAISE`` times the open share of its words. Ties at the TOP-th score are settled with it.

Tables: words get 64-bit codes of language and word (another seed is taken if a word of LEAST or more occurrences shares its code
with one of another 64-bit check); texts are written once as codes, rare words and piece ends as 0. Tasks get the open words and the frequent prefixes as
bitmaps of bounded size; a bit set for another word only lets more be counted. Counts are exact: blocks are grouped by
the words themselves and added up by Spark. A phrase is the binary string of its words' codes.

A longer phrase explains p wholly if it occurs as often as p. Then the phrase of one word more within it does so too, and it
is counted whenever p is: both of its ends are open.

Defined results: null and empty texts hold no words; a null lang counts as ``und``; repeated rows count as often as they
stand there; ties go by a, then by phrase; a language without candidates has no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.texts import BYTE_CODES, U64, mix, powers, row_blocks, text_bytes
from inkveil.sources.scratch import dropped, materialised

LEAST = 100
LONGEST = 5
TOP = 2000
#: The share of a language's frequent words that is open at first, and how much it grows while fewer than TOP phrases survive.
SHARE, RAISE = 0.125, 8
NONE = "und"
BLOCK = 1 << 20
#: Codes in a row of the written texts, and rows that are looked at together.
ROW, ROWS = 8192, 32
#: A bitmap has about 16 bits for each entry, and 2**MOST_BITS (32 MB) at most.
MOST_BITS, PART = 28, 15
_ENDS, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True
_LOWER[65:91] += 32


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang")


class _Words:
    """The words of a block of rows (lang, text): their places, rows, codes, and whether a piece ends before them."""

    def __init__(self, batch: pa.RecordBatch, seed: int) -> None:
        self.buf, off = text_bytes(batch.column(1))
        self.langs = batch.column(0).to_pylist()
        word = np.zeros(len(self.buf) + 2, bool)
        word[1:-1] = ~_GAPS[self.buf]
        # rows touch each other in the buffer: a word ends with its row
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[off] = True
        inside = word[1:-1]
        start = np.flatnonzero(inside & (~word[:-2] | edge[:-1]))
        end = np.flatnonzero(inside & (~word[2:] | edge[1:])) + 1
        self.start, self.end = start, end
        self.row = np.searchsorted(off, start, "right") - 1
        ends = np.concatenate([[0], np.cumsum(_ENDS[self.buf])])
        self.cut = np.ones(len(start), bool)
        self.cut[1:] = (self.row[1:] != self.row[:-1]) | (ends[start[1:]] != ends[start[:-1]])
        up, down = powers(len(self.buf))
        total = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(BYTE_CODES[_LOWER[self.buf]] * up[: len(self.buf)], out=total[1:])
        own = np.array([xxhash.xxh64_intdigest(x, seed) for x in self.langs], U64)
        code = mix(mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)) ^ own[self.row])
        self.code = np.where(code == 0, U64(1), code)
        self.powers = up, down

    def check(self, at: np.ndarray) -> np.ndarray:
        """Other hashes of some words."""
        up, down = self.powers
        total = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(BYTE_CODES[::-1][_LOWER[self.buf]] * up[: len(self.buf)], out=total[1:])
        start, end = self.start[at], self.end[at]
        return mix((total[end] - total[start]) * down[start])

    def spelled(self, i: int) -> str:
        return _LOWER[self.buf[self.start[i] : self.end[i]]].tobytes().decode()


def word_counts(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """code, own, f of the words that occur ``least`` times, and for each lang one row whose f counts all words.

    own: a hash of the language. shared: the code stands for several words, or the hash for several languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, 1, BLOCK):
                words = _Words(batch, seed)
                code, at, n = np.unique(words.code, return_index=True, return_counts=True)
                langs, place = np.unique(np.array(words.langs, object), return_inverse=True)
                each = np.bincount(place[words.row], minlength=len(langs))
                none = np.zeros(len(langs), np.int64)
                own = np.array([xxhash.xxh64_intdigest(x, seed) for x in langs], U64).view(np.int64)
                lang = pa.array([*[None] * len(at), *langs], pa.string())
                columns = [np.concatenate([x, y]) for x, y in ((code.view(np.int64), none), (own[place[words.row[at]]], own), (words.check(at).view(np.int64), none), (n, each))]
                yield pa.RecordBatch.from_arrays([lang, *map(pa.array, columns)], names=["lang", "code", "own", "check", "f"])

    rows = docs.select(_lang(), "text").mapInArrow(run, "lang string, code bigint, own bigint, check bigint, f bigint")
    # words have no lang here, so that all but the few rows of languages are numbers
    total = rows.groupBy("code", "lang").agg(F.sum("f").alias("f"), *[f(c).alias(f"_{f.__name__}_{c}") for c in ("own", "check") for f in (F.min, F.max)])
    shared = (F.col("_min_own") != F.col("_max_own")) | (F.col("_min_check") != F.col("_max_check"))
    return materialised(total.filter((F.col("f") >= least) | F.col("lang").isNotNull()).select("lang", "code", F.col("_min_own").alias("own"), "f", shared.alias("shared")))


class _Bits:
    """A set of 64-bit codes as a bitmap by their highest bits."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]) -> None:
        self.shift = U64(64 - bits)
        self.map = np.zeros(1 << max(0, bits - 3), np.uint8)
        for part, data in parts:
            self.map[part << (PART - 3) : (part << (PART - 3)) + len(data)] = np.frombuffer(data, np.uint8)

    def has(self, code: np.ndarray) -> np.ndarray:
        at = code >> self.shift
        return (self.map[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def bitmap(codes: DataFrame) -> Broadcast:
    """codes (code) as a broadcast _Bits; the tasks set the bits, the driver gets at most 2**MOST_BITS of them."""
    bits = min(MOST_BITS, max(PART, int(codes.count() * 16).bit_length()))
    at = F.shiftrightunsigned("code", 64 - bits)
    part, place = F.shiftright(at, PART).cast("int"), at.bitwiseAND((1 << PART) - 1)
    found = codes.select(part.alias("part"), place.alias("place")).groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits")).collect()
    return codes.sparkSession.sparkContext.broadcast(_Bits(bits, [(r["part"], bytes(r["bits"])) for r in found]))


def coded(docs: DataFrame, frequent: Broadcast, seed: int) -> DataFrame:
    """codes: binary strings of the codes of many texts; 0 where a piece ends or a word is not frequent. Each begins with 0 and has about ROW codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, 1, BLOCK):
                words = _Words(batch, seed)
                code = np.where(frequent.value.has(words.code), words.code, U64(0))
                out = np.insert(code, np.flatnonzero(words.cut), U64(0))
                out = out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])] if len(out) else out
                if len(out) > 2:
                    ends = np.flatnonzero(out == 0)
                    cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(0, len(out), ROW)), len(ends) - 1)])
                    yield pa.RecordBatch.from_arrays([pa.array([part.astype("<u8").tobytes() for part in np.split(out, cuts[1:])], pa.binary())], names=["codes"])

    return materialised(docs.select(_lang(), "text").mapInArrow(run, "codes binary"))


def _flat(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The codes of some rows at a time, with a 0 behind them."""
    for at in range(0, batch.num_rows, ROWS):
        yield np.append(text_bytes(batch.column(0).slice(at, ROWS))[0].view("<u8").astype(U64), U64(0))


def spelled(docs: DataFrame, wanted: Broadcast, seed: int) -> DataFrame:
    """code, word of the wanted words, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, 1, BLOCK):
                words = _Words(batch, seed)
                code, at = np.unique(words.code, return_index=True)
                few = wanted.value.has(code)
                yield pa.RecordBatch.from_arrays([pa.array(code[few].view(np.int64), pa.int64()), pa.array([words.spelled(i) for i in at[few]], pa.string())], names=["code", "word"])

    return docs.select(_lang(), "text").mapInArrow(run, "code bigint, word string").distinct()


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of phrases that are a word longer than those of ``left``."""
    return mix(left * U64(0x9E3779B97F4A7C15) + right)


def _grouped(columns: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of ``columns`` stand together, and the places where they begin. keys: hashes of the rows."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    differs = np.zeros(len(order), bool)
    for c in columns:
        differs[1:] |= c[order][1:] != c[order][:-1]
    if (differs & ~new).any():  # two phrases with one hash
        order = np.lexsort(columns)
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def phrases_of(texts: DataFrame, size: int, open_words: Broadcast, shorter: Broadcast | None, least: int) -> DataFrame:
    """phrase, f of the phrases of ``size`` words with an open first or last word; the part without the other end must be in ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code in (code for batch in batches for code in _flat(batch)):
            n = len(code) - size + 1
            if n < 1:
                continue
            is_open = open_words.value.has(code)
            first, last = is_open[:n], is_open[size - 1 :]
            keep = first | last
            for j in range(size):
                keep &= code[j : n + j] != 0
            if shorter:
                known = shorter.value.has(_hashes(code, size - 1))
                keep &= (~first | known[:n]) & (~last | known[1 : n + 1])
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            columns = [code[at + j] for j in range(size)]
            keys = columns[0]
            for c in columns[1:]:
                keys = _joined(keys, c)
            order, begin = _grouped(columns, keys)
            flat = np.column_stack([c[order[begin]] for c in columns]).astype("<u8")
            data = pa.Array.from_buffers(pa.binary(8 * size), len(begin), [None, pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([data, pa.array(np.diff(np.append(begin, len(order))), pa.int64())], names=["phrase", "f"])

    rows = texts.mapInArrow(run, "phrase binary, f bigint")
    return materialised(rows.groupBy("phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))


def _hashes(code: np.ndarray, size: int) -> np.ndarray:
    """The codes of all runs of ``size`` words."""
    n = len(code) - size + 1
    out = code[:n]
    for j in range(1, size):
        out = _joined(out, code[j : n + j])
    return out


def _phrase_codes(phrases: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(batch.num_rows, -1)
                out = words[:, 0].copy()
                for j in range(1, words.shape[1]):
                    out = _joined(out, words[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["code"])

    return phrases.select("phrase").mapInArrow(run, "code bigint")


def _part(begin: int | Column, words: int | Column) -> Column:
    """Words of a phrase, from a place that counts from 0."""
    return F.substring(F.col("phrase"), F.lit(begin) * 8 + 1, F.lit(words) * 8)


def survivors(words: DataFrame, counted: list[DataFrame], longest: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases with two open ends that no longer one explains. words: lang, phrase, f, n, open."""
    ends = words.filter("open").select("phrase", "lang", "n")
    longer = counted[0]
    for more in counted[1:]:
        longer = longer.unionAll(more)
    size = (F.length("phrase") / 8).cast("int")
    last = ends.select(F.col("phrase").alias("_last"))
    own = longer.withColumn("_first", _part(0, 1)).withColumn("_last", F.substring("phrase", -8, 8))
    own = own.join(ends.withColumnRenamed("phrase", "_first").hint("merge"), "_first").join(last.hint("merge"), "_last", "left_semi")
    inner = longer.filter(size > 2).select(F.explode(F.array(_part(0, size - 1), _part(1, size - 1))).alias("_inner"), F.col("f").alias("_f"))
    inner = inner.groupBy("_inner").agg(F.max("_f").alias("_f"))
    own = own.join(inner.hint("merge"), (F.col("phrase") == F.col("_inner")) & (F.col("f") == F.col("_f")), "left_anti")
    cuts = own.select("lang", "phrase", "f", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("_left", _part(0, F.col("k"))).withColumn("_right", _part(F.col("k"), size - F.col("k")))
    every = words.select("phrase", "f").unionAll(longer)
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(every.select(F.col("phrase").alias(side), F.col("f").alias(name)).hint("merge"), side)
    # products of up to 38 digits
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(f as decimal(16,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    least = cuts.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    return least.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def _as_phrase(code: str) -> Column:
    """A word's code as it stands in a phrase, least byte first."""
    digits = F.lpad(F.hex(code), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def _opened(words: DataFrame, langs: DataFrame) -> DataFrame:
    """words with n and whether they are open. langs: lang, n, upto (the limit)."""
    return words.join(langs.select("lang", "n", "upto").hint("merge"), "lang").withColumn("open", F.col("f") <= F.col("upto"))


def _upto(words: DataFrame, share: float) -> DataFrame:
    """lang, upto: the least power of the square root of 2 under which lie ``share`` of the frequent words' occurrences."""
    step = F.ceil(2 * F.log2("f")).cast("int")
    sums = words.groupBy("lang", step.alias("step")).agg(F.sum("f").alias("f"))  # some 130 rows for each language at most
    so_far = F.sum("f").over(Window.partitionBy("lang").orderBy("step"))
    whole = F.sum("f").over(Window.partitionBy("lang"))
    return sums.withColumn("_far", so_far).withColumn("_all", whole).filter(F.col("_far") >= share * F.col("_all")).groupBy("lang").agg(F.ceil(F.pow(F.lit(2.0), F.min("step") / 2)).cast("long").alias("upto"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, share: float = SHARE) -> DataFrame:
    """docs: lang, text. lang, rank, phrase, a, l, r, n, score."""
    for seed in count():
        counts = word_counts(docs, seed, least)
        sums = counts.filter("lang is not null").select("lang", "own", F.col("f").alias("n"))
        if counts.filter("shared and lang is null").isEmpty() and sums.groupBy("own").count().filter("count > 1").isEmpty():
            break
        dropped(counts)
    words = counts.filter("lang is null").select("own", "code", "f", _as_phrase("code").alias("phrase")).join(sums.select("own", "lang").hint("merge"), "own").drop("own")
    sums = sums.drop("own")
    texts = coded(docs, bitmap(words.select("code")), seed)
    langs = materialised(sums.join(_upto(words, share).hint("merge"), "lang"))
    while True:
        now = materialised(_opened(words, langs))
        opened = bitmap(now.filter("open").select("code"))
        counted: list[DataFrame] = []
        for size in range(2, longest + 1):
            shorter = bitmap(_phrase_codes(counted[-1])) if counted else None
            counted.append(phrases_of(texts, size, opened, shorter, least))
        found = materialised(survivors(now, counted, longest))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
        last = found.withColumn("_n", rank).filter(F.col("_n") <= top).groupBy("lang").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("score", "a")).alias("last"))
        most = now.groupBy("lang").agg(F.max("f").alias("most"), F.min(F.when(~F.col("open"), F.col("f"))).alias("waits"))
        state = langs.join(last.hint("merge"), "lang", "left").join(most.hint("merge"), "lang")
        bound = F.expr("cast(cast(n as decimal(17,0)) * 1000 div cast(waits as decimal(18,0)) as bigint)")
        enough = F.coalesce(F.col("found"), F.lit(0)) >= top
        state = state.withColumn("settled", F.col("waits").isNull() | (enough & (F.col("last.score") > bound)))
        reached = F.expr("cast(cast(n as decimal(17,0)) * 1000 div cast(greatest(last.score, 1) as decimal(18,0)) as bigint)")
        state = materialised(state.withColumn("reached", F.when(F.col("settled"), F.col("upto")).when(enough, F.greatest(reached, F.col("upto")))))
        if state.filter("not settled").isEmpty():
            break
        share = min(1.0, share * RAISE)
        more = _upto(words, share).withColumnRenamed("upto", "_more") if share < 1 else state.select("lang", F.col("most").alias("_more"))
        after = materialised(state.join(more.hint("merge"), "lang").select("lang", "n", F.coalesce("reached", F.greatest("_more", "upto")).alias("upto")))
        dropped(langs, now, found, state, *counted)
        langs = after
    # the first ``top`` and all that tie with the last of them
    edge = state.filter(F.col("found") >= top).select("lang", F.col("last.score").alias("_score"), F.col("last.a").alias("_a"))
    first = found.join(edge.hint("merge"), "lang", "left").filter(F.col("_score").isNull() | (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("a") >= F.col("_a"))))
    first = materialised(first)
    place = F.explode(F.sequence(F.lit(0), (F.length("phrase") / 8).cast("int") - 1)).alias("i")
    each = first.select("phrase", place).select("phrase", "i", _part(F.col("i"), 1).alias("_w"))
    wanted = materialised(words.join(each.hint("merge"), F.col("_w") == words["phrase"], "left_semi").select("code", words["phrase"].alias("_w")))
    names = spelled(docs, bitmap(wanted), seed).join(wanted.hint("merge"), "code").select("_w", "word")
    texts = each.join(names.hint("merge"), "_w").groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("_text"))
    rows = first.join(texts.hint("merge"), "phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "_text"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", F.col("_text").alias("phrase"), "a", "l", "r", "n", "score")


def _sql(least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> str:
    """The same in DuckDB SQL, by counting all phrases."""
    parts = " union all ".join(f"select lang, {m} m, w[i:i + {m - 1}] p from (select lang, w, unnest(generate_series(1, len(w) - {m - 1})) i from pieces where len(w) >= {m})" for m in range(1, longest + 1))
    return f"""
with texts as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') w from (select lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) p from texts)),
counts as materialized (select lang, m, p, count(*) f from ({parts}) group by all),
total as (select lang, sum(f) n from counts where m = 1 group by lang),
longer as (select lang, p[1:m - 1] q, max(f) f from counts where m > 2 group by all union all select lang, p[2:m] q, max(f) f from counts where m > 2 group by all),
kept as (select * from counts c where m >= 2 and f >= {least} and not exists (select 1 from longer o where o.lang = c.lang and o.q = c.p and o.f = c.f)),
cuts as (select lang, p, f a, m, unnest(generate_series(1, m - 1)) k from kept),
scored as (select c.lang, c.p, c.a, c.k, x.f l, y.f r, n, (1000::hugeint * c.a * n) // (x.f::hugeint * y.f) score
  from cuts c join total using (lang) join counts x on x.lang = c.lang and x.p = c.p[1:c.k] join counts y on y.lang = c.lang and y.p = c.p[c.k + 1:c.m]),
least as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(p, ' '))) as rank, array_to_string(p, ' ') as phrase, a, l, r, n::bigint as n, score::bigint as score
from least qualify row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(p, ' '))) <= {top}"""


ORACLE = _sql()
