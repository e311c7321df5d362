"""LM scoring with Brown's class-based bigrams.

P(word | previous) = P(class | previous class) * P(word | class). Tokens are the words of a text and one end
token. Exchange clustering assigns items to classes so that the likelihood of the class bigrams grows: each
item in turn moves to the class where it fits best. Items are the ``WORDS`` most frequent words and, for all
other words, ``ENDINGS`` groups by a hash of their last two bytes. This fixed core is clustered on the driver; after it, tasks put
every other word into the class that makes its own occurrences, with the classes left and right of them, most likely. Words that no
training text has stay in their group's class. A word is emitted by (c + 0.5) / (N + 0.5 (V + U)), for a class of
N tokens, V words and U groups of unknown words, so every word has a positive probability and all sum to 1.

Counts are taken over all training texts, whatever their number: the counts of every word by a shuffle, with
the words of a block of text added up before it; the classes beside every word likewise; bigrams of items likewise, of which there
are at most (WORDS + ENDINGS + 1) ** 2, the bound of what the driver gets for clustering. Counts and classes of the most
frequent words (at most ``SHARED``, and the core) are broadcast, 24 bytes each; those of all other words come by a join
with the words of each text. This is so both when the bigrams of classes are counted and when a text is scored: every word has its own
class, as a neighbour too, whether it is broadcast or joined, so ``SHARED`` changes no result.

Defined results: null and empty texts have one token, the end; scores of equal texts are equal; repeated rows
count as often as they stand; without training texts every word is unknown and scores still exist; an empty table
gives no rows; other columns are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.texts import U64, lowered_word_ends, mix, row_blocks, text_bytes, unused, word_hashes
from inkveil.sources.scratch import dropped, materialised

WORDS = 1000
ENDINGS = 512
CLASSES = 48
SWEEPS = 6
SHARED = 1 << 18
BLOCK_BYTES = 1 << 20
END = np.int64(-1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the ending group of each, and the offsets of the rows."""
    buf, off = text_bytes(column)
    words, at = word_hashes(buf, off)
    ending = (mix(lowered_word_ends(buf, off)) % U64(ENDINGS)).astype(np.int64)
    words = words.view(np.int64)
    words[words == END] = -2
    return np.insert(words, at[1:], END), np.insert(ending, at[1:], ENDINGS), at + np.arange(len(at))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_blocks(whole, "text", BLOCK_BYTES):
            words, ending, _ = tokens(batch.column(0))
            found, first, count = np.unique(words, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ending[first].astype(np.int32)), pa.array(count)], names=["w", "e", "c"])


@dataclass
class ClassModel:
    words: np.ndarray  # sorted hashes of the shared words
    counts: np.ndarray
    items: np.ndarray  # for each shared word its item, or -1
    classes: np.ndarray  # of each item
    moves: np.ndarray  # log10 P(class | previous class)
    norm: np.ndarray  # log10 of N + 0.5 (V + U) of each class
    chosen: np.ndarray  # the class of each shared word
    total: int
    distinct: int

    def lookup(self, words: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is shared, its count if so, and its item."""
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        shared = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        count = np.where(shared, self.counts[at], 0) if len(self.words) else np.zeros(len(words), np.int64)
        item = np.where(shared & (self.items[at] >= 0), self.items[at], WORDS + ending) if len(self.words) else WORDS + ending
        return shared, count, item

    def class_of(self, words: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """The class of each token; that of its group for words that are not shared."""
        of_group = self.classes[WORDS + ending]
        if not len(self.words):
            return of_group
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.chosen[at], of_group)


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the items of a square matrix of bigram counts; the last item, the end, has the last class to itself."""
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    k = max(1, min(n_classes, n - 1))
    classes = np.zeros(n, np.int64)
    classes[order] = np.arange(n - 1) % k
    classes[-1] = k

    def g(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    one = np.eye(k + 1)[classes]
    out, into = bigrams @ one, bigrams.T @ one  # of each item, by class
    table = one.T @ out
    left, right = table.sum(1), table.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = classes[w], bigrams[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[a] -= own  # to and from the other members
            i[a] -= own
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= own
            left[a] -= o.sum() + own
            right[a] -= i.sum() + own
            t = table[:k]
            u = table[:, :k].T
            gain = (g(t + o) - g(t)).sum(1) + (g(u + i) - g(u)).sum(1)
            d = np.diagonal(table)[:k]
            gain += g(d + o[:k] + i[:k] + own) - g(d + o[:k]) - g(d + i[:k]) + g(d)
            gain -= g(left[:k] + o.sum() + own) - g(left[:k]) + g(right[:k] + i.sum() + own) - g(right[:k])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += o
            table[:, b] += i
            table[b, b] += own
            left[b] += o.sum() + own
            right[b] += i.sum() + own
            if b != a:
                moved += 1
                classes[w] = b
                out[:, a] -= bigrams[:, w]
                out[:, b] += bigrams[:, w]
                into[:, a] -= bigrams[w]
                into[:, b] += bigrams[w]
        if not moved:
            break
    return classes


def fit(train: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and the table of all words with their counts and classes (w, e, c, k)."""
    spark = train.sparkSession
    text = train.select("text")
    counts = materialised(text.mapInArrow(_word_counts, "w bigint, e int, c bigint").groupBy("w").agg(F.first("e").alias("e"), F.sum("c").alias("c")))
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r["c"] for r in bins), sum(r["n"] for r in bins)
    room, least = SHARED, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["bin"]
    # the core is always shared, also where more words than there is room for are as frequent as its own
    often = F.floor(F.log2("c") * 8) >= (least if least is not None else 1 << 30)
    ranked = counts.filter(F.col("w") != int(END)).orderBy(F.desc("c"), "w").limit(WORDS).toPandas()
    shared = pd.concat([counts.filter(often).toPandas(), ranked, counts.filter(F.col("w") == int(END)).toPandas()]).drop_duplicates("w").sort_values("w")
    words, number, ending = (shared[c].to_numpy() for c in ("w", "c", "e"))
    words, number = words.astype(np.int64), number.astype(np.int64)
    items = np.full(len(words), -1, np.int64)
    items[np.searchsorted(words, ranked["w"].to_numpy(np.int64))] = np.arange(len(ranked))
    items[words == END] = WORDS + ENDINGS
    n = WORDS + ENDINGS + 1
    model = ClassModel(words, number, items, np.zeros(n, np.int64), np.zeros((1, 1)), np.zeros(1), np.zeros(len(words), np.int64), total, distinct)
    sent = spark.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, "text", BLOCK_BYTES):
                found, ends, at = tokens(batch.column(0))
                item = sent.value.lookup(found, ends)[2]
                before = np.concatenate([[n - 1], item[:-1]])
                before[at[:-1]] = n - 1
                pair, count = np.unique(before * n + item, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "c"])

    found = text.mapInArrow(pairs, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    bigrams = np.zeros(n * n)
    bigrams[found["pair"].to_numpy(np.int64)] = found["c"].to_numpy(float)
    bigrams = bigrams.reshape(n, n)
    classes = exchange(bigrams)
    one = np.eye(classes.max() + 1)[classes]
    table = one.T @ bigrams @ one
    model.moves, model.classes = _moves(table), classes
    known = items >= 0
    model.chosen = np.where(known, classes[items], classes[WORDS + np.append(ending.astype(np.int64), 0)[:-1]])
    size = np.log10(table.sum(0) + 1)
    of_core, context, k = spark.sparkContext.broadcast(model), len(table), len(table) - 1
    towards = np.concatenate([model.moves[:, :k], model.moves[:k].T])  # of the class on the left, of the class on the right; by class

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = of_core.value
        for whole in batches:
            for batch in row_blocks(whole, "text", BLOCK_BYTES):
                found, ends, at = tokens(batch.column(0))
                one = m.classes[m.lookup(found, ends)[2]]
                left, right = np.concatenate([[k], one[:-1]]), np.append(one[1:], k)
                left[at[:-1]] = k
                # core words have their class already
                open_ = np.flatnonzero(m.lookup(found, ends)[2] >= WORDS)
                open_ = open_[found[open_] != END]
                distinct, index = np.unique(found[open_], return_inverse=True)
                pair, count = np.unique(np.concatenate([index * (2 * context) + left[open_], index * (2 * context) + context + right[open_]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[pair // (2 * context)]), pa.array((pair % (2 * context)).astype(np.int32)), pa.array(count)], names=["w", "slot", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                lists = batch.column(1)
                flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                number = np.zeros((batch.num_rows, 2 * context))
                number[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                gain = number @ towards - number[:, :context].sum(1)[:, None] * size[:k]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain.argmax(1).astype(np.int32))], names=["w", "k"])

    slots = text.mapInArrow(beside, "w bigint, slot int, c bigint").groupBy("w", "slot").agg(F.sum("c").alias("c"))
    chosen = materialised(slots.groupBy("w").agg(F.collect_list(F.struct("slot", "c")).alias("l")).mapInArrow(choose, "w bigint, k int"))
    core = spark.createDataFrame([(int(w), int(x)) for w, x in zip(words[known], model.chosen[known], strict=True)], "w bigint, k int")
    first, counts = counts, materialised(counts.join(chosen.unionByName(core).hint("merge"), "w"))
    dropped(first, chosen)
    shared = counts.filter(often).select("w", "k").toPandas()
    model.chosen[np.searchsorted(words, shared["w"].to_numpy(np.int64))] = shared["k"].to_numpy(np.int64)

    # the bigrams of classes again, by the classes of all words
    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, at, _, _, _ in _classed(batches):
            before = np.concatenate([[k], one[:-1]])
            before[at[:-1]] = k
            pair, count = np.unique(before * context + one, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "c"])

    rows, every = _sequences(train.select(F.lit(0).alias("row"), "text"), model, counts, ("row",))
    found = every.mapInArrow(class_pairs, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    dropped(rows)
    table = np.zeros(context * context)
    table[found["pair"].to_numpy(np.int64)] = found["c"].to_numpy(float)
    model.moves = _moves(table.reshape(context, context))
    sizes = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    groups = np.bincount(classes[WORDS : WORDS + ENDINGS], minlength=context)
    model.norm = np.array([np.log10(max(0.5, n + 0.5 * (v + groups[i]))) for i in range(context) for n, v in [sizes.get(i, (0, 0))]])
    return model, counts


def _moves(table: np.ndarray) -> np.ndarray:
    prior = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + len(table) * prior) / (table.sum(1, keepdims=True) + len(table)))


def _kinds(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"{c}: {t}" for c, t in docs.select(*keep).dtypes)


def _sequences(docs: DataFrame, model: ClassModel, counts: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A written table of texts as classes of tokens, and its rows with place, class and count of each word that is not shared (n_known, own, seq, row, more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = _kinds(docs, keep)
    ddl = f"uid bigint, w bigint, at int, n_known bigint, own double, seq binary, row struct<{kinds}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in row_blocks(whole, whole.num_columns - 1, BLOCK_BYTES):
                words, ending, at = tokens(batch.column(batch.num_columns - 1))
                shared, count, _ = model.lookup(words, ending)
                classes = model.class_of(words, ending).astype(np.uint8)
                rows = batch.num_rows
                add = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(rows)
                ids = uid + np.arange(rows)
                uid += rows
                row = pa.StructArray.from_arrays(batch.columns[:-1], names=list(keep))
                seq = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(classes.tobytes())]).cast(pa.binary())
                empty = lambda kind, n: pa.nulls(n, kind)
                # words that are not here count as unknown ones until they are found
                yield pa.RecordBatch.from_arrays([pa.array(ids), empty(pa.int64(), rows), empty(pa.int32(), rows), pa.array(add(shared.astype(np.int64))), pa.array(add(np.log10(count + 0.5))), seq, row], names=names)
                left = np.flatnonzero(~shared)
                if len(left):
                    own = np.repeat(np.arange(rows), np.diff(at))[left]
                    n = len(left)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(words[left]), pa.array((left - at[own]).astype(np.int32)), empty(pa.int64(), n), empty(pa.float64(), n), empty(pa.binary(), n), empty(row.type, n)], names=names)

    names = ["uid", "w", "at", "n_known", "own", "seq", "row"]
    # written at once: uids name rows of this very table
    rows = materialised(docs.select(*keep, F.col("text").alias(unused("_text", keep))).mapInArrow(run, ddl))
    heads, tails = rows.filter("w is null"), rows.filter("w is not null").select("uid", "w", "at")
    more = tails.join(counts.select("w", "c", "k").hint("merge"), "w").groupBy("uid").agg(F.collect_list(F.struct("at", "k", "c")).alias("more"))
    return rows, heads.drop("w", "at").join(more.hint("merge"), "uid", "left").select("n_known", "own", "seq", "row", F.coalesce("more", F.array().cast("array<struct<at:int,k:int,c:bigint>>")).alias("more"))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of rows of ``_sequences``: the class of every token, the offsets of the rows, the block, and row and count of each joined word."""
    for whole in batches:
        for batch in row_blocks(whole, "seq", BLOCK_BYTES >> 3):
            seq, at = text_bytes(batch.column(2))
            classes, more = seq.astype(np.int64), batch.column(4)
            flat, row = more.flatten(), np.repeat(np.arange(batch.num_rows), more.value_lengths().to_numpy(zero_copy_only=False))
            place, k, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            classes[at[row] + place] = k
            yield classes, at, batch, row, c


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    kinds = _kinds(docs, keep)
    _, every = _sequences(docs, model, counts, keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        norm, end = np.log10(model.total + 0.5 * (model.distinct + 1)), model.classes[-1]
        for classes, at, batch, row, c in _classed(batches):
            own = batch.column(1).to_numpy() + np.bincount(row, np.log10(c + 0.5) - np.log10(0.5), batch.num_rows)
            before = np.concatenate([[end], classes[:-1]])
            before[at[:-1]] = end
            n = np.diff(at)
            value = own + np.add.reduceat(model.moves[before, classes] - model.norm[classes], at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(batch.column(0).to_numpy() + np.bincount(row, minlength=batch.num_rows)), pa.array(own - n * norm), pa.array(value), batch.column(3)], names=["n", "n_known", "base", "value", "row"])

    out = every.mapInArrow(finish, f"n bigint, n_known bigint, base double, value double, row struct<{kinds}>")
    return out.select(
        *[F.col(f"row.{c}").alias(c) for c in keep], F.col("n").alias("n_tokens"), "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("value").alias("score"), F.pow(F.lit(10.0), -F.col("value") / F.col("n")).alias("perplexity"),
    )
