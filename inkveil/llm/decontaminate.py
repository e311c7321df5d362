"""Benchmark decontamination by the CGK random walk.

A benchmark item and a stretch of a document match if their word sequences (lower-cased A-Z) are within
an edit distance of ``RATE`` of the item's words. The CGK random walk maps edit distance to Hamming
distance: a pointer goes through the sequence; at each step the word under it is written out, and a
random bit that depends on the step and the word says whether the pointer moves. Close sequences soon
walk in step. Bit sampling makes the Hamming distance searchable: each of ``REPEATS`` walks writes
``BITS`` sampled steps into one key, and a window whose key equals that of an item, in any walk, is a
candidate. Candidates are verified exactly, by edit distance over all places near the window.

Walks stand where they can matter. An item of w words with at most d edits keeps a run of
ceil((w - d) / (d + 1)) words; a document without any such run of any item can hold no match. So each hit of
a run, at any place of an item, is an anchor: from it, one walk goes forwards over what the item and the document
have from there on, and one backwards over what they have up to its end, each over the item's words on that side, ``SPAN``
at most. Both are in step at the anchor wherever the item was edited before it (a dropped, replaced or lengthened
head, for example, leaves the forward walks of all later hits alone), and the anchors of a match lie
all over the item, so the spans together cover it whatever its length. Steps are sampled over the whole span.
Items are the query set: they are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words each (a proven bound),
one pass over the documents per block, whose result is written before the next one is sent, so nothing is shuffled and a benchmark of any size works. Very frequent runs only
cost their own anchors.

Recall: with r repeats an anchor whose walk agrees on each sampled step with probability p makes a candidate with
1 - (1 - p ** BITS) ** r, on either side. Tests measure it against planted matches with edits at the head, at the tail and
anywhere; at the defaults it is above 0.99 for matches with up to RATE edits.

Defined results: null or empty texts and items without words match nothing; items too short for a single edit within
``RATE`` match where their words stand exactly; repeated documents each get their rows; repeated items
are reported once per item_id; equal distances go to the leftmost start; an empty table gives
no rows; other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.texts import U64, mix, row_blocks, text_bytes, unused, word_hashes
from inkveil.sources.scratch import materialised

RATE = 0.2
REPEATS = 24
BITS = 2
SPAN = 32
BLOCK_WORDS = 1_000_000


@dataclass
class Items:
    """A block of items, with the tables that its search needs."""

    ids: list
    words: list[np.ndarray]
    rate: float = RATE
    seed: int = 11
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by_run: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            d = int(len(w) * self.rate)
            n = min(-(-(len(w) - d) // (d + 1)), 4)
            hashes = _runs(w, n)
            by_run.setdefault(n, []).extend((int(h), i, j) for j, h in enumerate(hashes))
        for n, found in by_run.items():
            order = sorted(found)
            self.runs[n] = (np.array([x[0] for x in order], U64), np.array([x[1] for x in order]), np.array([x[2] for x in order]))
        self.lengths = np.array([len(w) for w in self.words])
        rng = np.random.default_rng(self.seed)
        # a walk moves every second step or so: each samples BITS of the steps that a whole span takes, as shares of it
        self.steps = [np.sort(rng.random(BITS)) for _ in range(REPEATS)]
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, U64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for i in range(n):
        out = mix(out + words[i : len(words) - n + 1 + i] * U64(2 * i + 1))
    return out


def walk_keys(words: np.ndarray, begin: np.ndarray, end: np.ndarray, way: int, span: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
    """(anchors, repeats) keys: for each walk, the sampled characters of the CGK embedding of the words from ``begin`` on towards ``end`` (exclusive), backwards if ``way`` is -1. Steps are ``shares`` of twice the ``span``."""
    out = np.zeros((len(begin), len(shares)), U64)
    padded = np.append(words, U64(0))
    for r, share in enumerate(shares):
        at = begin.copy()
        wanted = [(2 * span * x).astype(np.int64) for x in share]
        live = np.arange(len(begin))
        for t in range(int(wanted[-1].max(initial=-1)) + 1):
            live = live[wanted[-1][live] >= t]
            here = at[live]
            inside = (end[live] - here) * way > 0
            word = np.where(inside, padded[here], U64(0))
            for want in wanted:
                take = want[live] == t
                if take.any():
                    mine = live[take]
                    out[mine, r] = mix(out[mine, r] + word[take] + U64(t + 1))
            bit = (mix(word ^ U64((r * 1000003 + t + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(40)) & U64(1)
            at[live] = here + np.where(inside, bit.astype(np.int64), 0) * way
    return out


def in_step(words: np.ndarray, at: np.ndarray, row: np.ndarray, hit: np.ndarray, n: int, owner: np.ndarray, place: np.ndarray, items: Items) -> np.ndarray:
    """Which anchors (word ``hit`` of a row, word ``place`` of an item, a run of ``n``) have an equal key in any walk on either side."""
    # items' keys once per place that was hit
    first = items.at[owner] + place
    _, some, back = np.unique(first, return_index=True, return_inverse=True)
    near = np.zeros(len(row), bool)
    for way in (1, -1):
        start = 0 if way == 1 else n - 1
        span = np.minimum(items.lengths[owner] - place if way == 1 else place + n, SPAN)
        of_item = walk_keys(items.flat, (first + start)[some], (first + start + way * span)[some], way, span[some], items.steps)
        stop = hit + start + way * span
        stop = np.minimum(stop, at[row + 1]) if way == 1 else np.maximum(stop, at[row] - 1)
        near |= (walk_keys(words, hit + start, stop, way, span, items.steps) == of_item[back]).any(axis=1)
    return near


def edit_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any stretch of ``text``, with that stretch's begin and end; most + 1 if above."""
    m = len(text)
    cost = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, word in enumerate(item):
        new = np.empty(m + 1, np.int64)
        from_ = np.empty(m + 1, np.int64)
        new[0], from_[0] = i + 1, 0
        swap = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        pick = swap <= drop
        new[1:] = np.where(pick, swap, drop)
        from_[1:] = np.where(pick, begin[:-1], begin[1:])
        # insertions: new[j] = min over k <= j of new[k] + j - k
        lead = np.minimum.accumulate((new - steps) * (m + 2) + steps)
        source = lead % (m + 2)
        new, from_ = new[source] + steps - source, from_[source]
        cost, begin = new, from_
    end = int(cost.argmin())
    best = int(cost[end])
    return (best, int(begin[end]), end) if best <= most else (most + 1, 0, 0)


def search(words: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item index, distance, begin, end) of all matches in rows words[at[i]:at[i + 1]]; one per row and item, the closest."""
    rows_of, item_of, begins = [], [], []
    for n, (hashes, owner, place) in items.runs.items():
        runs = _runs(words, n)
        if not len(runs):
            continue
        low = np.searchsorted(hashes, runs, "left")
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == runs)
        if not len(hit):
            continue
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + n <= at[row + 1]
        hit, row = hit[inside], row[inside]
        low = np.searchsorted(hashes, runs[hit], "left")
        count = np.searchsorted(hashes, runs[hit], "right") - low
        index = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows, hits, owners, places = np.repeat(row, count), np.repeat(hit, count), owner[index], place[index]
        for a in range(0, len(rows), 1 << 16):
            part = slice(a, a + (1 << 16))
            near = in_step(words, at, rows[part], hits[part], n, owners[part], places[part], items)
            rows_of.append(rows[part][near])
            item_of.append(owners[part][near])
            begins.append(hits[part][near] - places[part][near])
    if not rows_of:
        return []
    every = np.unique(np.column_stack([np.concatenate(rows_of), np.concatenate(item_of), np.concatenate(begins)]), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for row, owner, start in every:
        item = items.words[owner]
        most = int(len(item) * items.rate)
        key = (int(row), int(owner))
        if best.get(key, (1,))[0] == 0 or key in done and done[key] >= start:
            continue
        # one alignment covers all windows that begin within the next item's length
        a, b = max(int(at[row]), int(start) - most - 2), min(int(at[row + 1]), int(start) + 2 * len(item) + most)
        done[key] = int(start) + len(item) - 1
        found = edit_distance_within(item, words[a:b], most)
        if found[0] <= most and (key not in best or found[0] < best[key][0]):
            best[key] = (found[0], a + found[1] - int(at[row]), a + found[2] - int(at[row]))
    return [(r, o, *v) for (r, o), v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, rate: float = RATE, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """Blocks of items of at most ``most`` words (one larger item makes its own), read a row at a time."""
    ids, words, size = [], [], 0
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates(["item_id", "text"]).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        hashes, _ = word_hashes(*text_bytes(pa.array([row["text"]])))
        if not len(hashes):
            continue
        if ids and size + len(hashes) > most:
            yield Items(ids, words, rate)
            ids, words, size = [], [], 0
        ids.append(row["item_id"])
        words.append(hashes)
        size += len(hashes)
    if ids:
        yield Items(ids, words, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document and matching item: the columns of ``keep``, item_id, distance, begin and end (words of the document)."""
    schema = docs.select(*keep).schema
    for name, kind in (("item_id", benchmark.schema["item_id"].dataType), ("distance", "integer"), ("begin", "long"), ("end", "long")):
        schema = schema.add(name, kind)
    names = schema.names
    out = None

    def passed(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in row_blocks(whole, whole.num_columns - 1):
                    found = search(*word_hashes(*text_bytes(batch.column(batch.num_columns - 1))), items)
                    if found:
                        rows, owners, distance, begin, end = zip(*found, strict=True)
                        kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows))
                        ids = pa.array([items.ids[o] for o in owners])
                        yield pa.RecordBatch.from_arrays([*kept.columns, ids, pa.array(distance, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=names)

        return docs.select(*keep, F.col("text").alias(unused("_text", keep))).mapInArrow(run, schema)

    for part in _one_by_one(docs, item_blocks(benchmark, rate), passed):
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _one_by_one(docs: DataFrame, blocks: Iterator[Items], passed) -> Iterator[DataFrame]:
    """passed(broadcast) for each block. With several, each result is written, and its block released, before the next one is sent."""
    block = next(blocks, None)
    several = False
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        block = next(blocks, None)
        several |= block is not None
        if several:
            yield materialised(passed(shared))
            shared.destroy()
        else:
            yield passed(shared)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents without any match, all columns kept."""
    out = docs

    def passed(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in row_blocks(whole, "text"):
                    found = search(*word_hashes(*text_bytes(batch.column("text"))), items)
                    good = np.ones(batch.num_rows, bool)
                    good[[x[0] for x in found]] = False
                    yield batch.filter(pa.array(good))

        return out.mapInArrow(run, out.schema)

    for left in _one_by_one(docs, item_blocks(benchmark, rate), passed):
        out = left
    return out
