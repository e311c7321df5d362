"""Toxicity by a factorization machine over hashed terms.

A text is cut into overlapping pieces of ``PIECE`` words. The terms of a piece are 64-bit hashes of its words and of their
first ``STEMS`` bytes (so that inflected and compound words share terms), each counted once. A piece scores

    w0 + sum of w[t] + sum over pairs t < u of <v[t], v[u]>

so a pair of terms can mean more, or less, than the two alone: an insult next to a group's name weighs more than an insult and a
name apart, which no additive weights can tell. A text scores as its worst piece: what is said once in a long text counts as in a short one.

Training, in numpy on the driver: for a toxic text the piece that scores highest is learned from (all of its pieces in the first
``ALL`` epochs, when nothing is known yet), for another one a piece drawn by chance and the highest. Both labels weigh the
same, so 0.5 is the point of even likelihood in every table. Steps are AdaGrad's; weights near 0 are cut to 0, so that the model stays small.

Labels are learned from a bounded sample (at most ``SAMPLE`` different texts of each label, those with the least hashes, and of each a
stretch of at most ``SAMPLE_BYTES``). A term is learned if the log-likelihood ratio of its texts and the label is ``TOLD`` or more, which chance gives
to less than one of a million terms. Scoring covers every row and every word.

Defined results: null and empty texts score as a piece without terms; repeated rows score alike; ties don't matter; rows with a null label are not
learned from, a text whose copies have both labels is learned from as both; without labels of both kinds every score is 0.5; an empty
table gives no rows; other columns are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.sampling import labelled_texts
from inkveil.llm.texts import BYTE_CODES, U64, mix, powers, row_blocks, text_bytes, unused

PIECE = 24
STEMS = (4, 5)
FACTORS = 8
SAMPLE, SAMPLE_BYTES = 3000, 16384
TOLD = 30
EPOCHS, ALL = 16, 2
RATE, DECAY = 0.15, 5e-5
PREDICTED = 0.7
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pieces_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all pieces of lower-cased rows, where each piece begins among them, and its row. Rows without words have one empty piece."""
    word = np.zeros(len(buf) + 2, bool)
    word[1:-1] = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=total[1:])
    terms = [mix((total[end] - total[start]) * down[start])]
    for k in STEMS:
        at = np.minimum(start + k, end)
        terms.append(np.where(end - start > k, mix((total[at] - total[start]) * down[start] + U64(k)), U64(0)))
    each = np.column_stack(terms)
    # pieces begin every half piece; the last one of a row ends with it
    words = np.searchsorted(start, off)
    counts = np.diff(words)
    pieces = np.maximum(1, -(-(counts - PIECE) // (PIECE // 2)) + 1)
    row = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = words[row] + nth * (PIECE // 2)
    size = np.minimum(PIECE, words[row + 1] - first)
    begin = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(first - begin[:-1], size) + np.arange(begin[-1])
    return each[index].ravel(), begin * len(terms), row


@dataclass
class ToxicityModel:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    fitted: bool

    def known(self, terms: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that were learned, each once in a piece, and where each piece begins among them."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = np.flatnonzero(self.terms[at] == terms)
        piece = np.searchsorted(begin, there, "right") - 1
        once = np.unique(piece * len(self.terms) + at[there])
        return once % len(self.terms), np.searchsorted(once // len(self.terms), np.arange(len(begin)))

    def logits(self, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        v = self.factors[at]
        sums = _runs(np.column_stack([v, (v * v).sum(1), self.weights[at]]), begin)
        return self.bias + sums[:, -1] + 0.5 * ((sums[:, :-2] ** 2).sum(1) - sums[:, -2])

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(off) - 1, 0.5)
        terms, begin, row = pieces_of(buf, off)
        z = self.logits(*self.known(terms, begin))
        return _even(np.maximum.reduceat(z, np.searchsorted(row, np.arange(len(off) - 1)))) if len(row) else np.zeros(0)


def _even(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _runs(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; empty runs are 0. Each run is added up by itself, so it does not hang on its neighbours."""
    out = np.zeros((len(begin) - 1, values.shape[1]))
    full = begin[1:] > begin[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, begin[:-1][full], axis=0)
    return out


def _told(with_term: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each term and the label, from the numbers of texts with the term by label."""
    cells = np.stack([with_term, texts - with_term], 1).astype(float)
    expected = cells.sum(2, keepdims=True) * cells.sum(1, keepdims=True) / texts.sum()
    return 2 * np.sum(cells * np.log(np.maximum(cells, 1e-300) / np.maximum(expected, 1e-300)), axis=(1, 2))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 and the offsets of the rows."""
    return text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def _in_parts(texts: list[str], size: int = 100) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The pieces of some texts at a time, with the number of the first text: the driver holds the terms of few at once."""
    for k in range(0, len(texts), size):
        yield k, pieces_of(*lowered(pa.array(texts[k : k + size], pa.string())))


def _chosen(texts: list[str], y_of: np.ndarray) -> np.ndarray:
    """The terms that tell the labels apart, sorted."""
    names, counts = [], []
    for k, (terms, begin, row) in _in_parts(texts):
        of = row[np.repeat(np.arange(len(row)), np.diff(begin))] + k
        own, place = np.unique(terms, return_inverse=True)
        pairs = np.unique(place * len(texts) + of)
        label = y_of[pairs % len(texts)]
        names.append(own)
        counts.append(np.column_stack([np.bincount(pairs[label == c] // len(texts), minlength=len(own)) for c in (0, 1)]))
    names, place = np.unique(np.concatenate(names), return_inverse=True)
    both = np.concatenate(counts)
    with_term = np.column_stack([np.bincount(place, both[:, c], len(names)) for c in (0, 1)])
    return names[(_told(with_term, np.array([len(texts) - y_of.sum(), y_of.sum()])) >= TOLD) & (names != 0)]


def train(texts: list[str], labels: list[int], seed: int = 5) -> ToxicityModel:
    y_of = np.array(labels, float)
    none = ToxicityModel(np.zeros(0, U64), np.zeros(0), np.zeros((0, FACTORS)), 0.0, False)
    if len(set(labels)) < 2:
        return none
    rng = np.random.default_rng(seed)
    names = _chosen(texts, y_of)
    model = ToxicityModel(names, np.zeros(len(names)), rng.normal(0, 0.02, (len(names), FACTORS)), 0.0, True)
    parts = []
    for k, (terms, begin, row) in _in_parts(texts):
        parts.append((*model.known(terms, begin), row + k))
    at, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    share = np.where(y_of > 0, 0.5 / y_of.sum(), 0.5 / (1 - y_of).sum()) * len(texts)
    square_w, square_v, square_b = np.full(len(names), 1e-6), np.full((len(names), FACTORS), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        z = model.logits(at, begin)
        order = np.lexsort((-z, row))
        top = order[first[:-1]]
        chance = first[:-1] + (rng.random(len(texts)) * np.diff(first)).astype(np.int64)
        few = np.concatenate([top, chance[y_of == 0]]) if epoch >= ALL else np.arange(len(row))
        weight = (share / np.diff(first))[row[few]] if epoch < ALL else share[row[few]] * np.where(y_of[row[few]] == 0, 0.5, 1)
        mixed = rng.permutation(len(few))
        for part in np.array_split(mixed, max(1, len(few) // 128)):
            chosen, size = few[part], np.diff(begin)[few[part]]
            edges = np.concatenate([[0], np.cumsum(size)])
            index = at[np.repeat(begin[chosen] - edges[:-1], size) + np.arange(edges[-1])]
            v = model.factors[index]
            sums = _runs(v, edges)
            error = (_even(model.logits(index, edges)) - y_of[row[chosen]]) * weight[part]
            each = np.repeat(error, size)[:, None]
            unique, back = np.unique(index, return_inverse=True)
            grad_w = np.bincount(back, each[:, 0], len(unique)) / len(part) + DECAY * model.weights[unique]
            pull = each * (np.repeat(sums, size, axis=0) - v)
            grad_v = np.column_stack([np.bincount(back, pull[:, f], len(unique)) for f in range(FACTORS)]) / len(part) + DECAY * model.factors[unique]
            square_w[unique] += grad_w**2
            square_v[unique] += grad_v**2
            square_b += error.mean() ** 2
            model.weights[unique] -= RATE * grad_w / np.sqrt(square_w[unique])
            model.factors[unique] -= 0.3 * RATE * grad_v / np.sqrt(square_v[unique])
            model.bias -= RATE * error.mean() / np.sqrt(square_b)
    keep = (np.abs(model.weights) > 0.02) | (np.abs(model.factors).max(1, initial=0) > 0.06)
    return ToxicityModel(names[keep], model.weights[keep], model.factors[keep], model.bias, True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, label (1 toxic, 0 not). Takes at most ``sample`` texts of each label to the driver."""
    texts = labelled_texts(docs, labels, sample, sample_bytes)
    return train([t.decode(errors="ignore") for k in (0, 1) for t in texts[k]], [k for k in (0, 1) for _ in texts[k]])


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), least: float = PREDICTED) -> DataFrame:
    """The columns of ``keep``, score and predicted (1 from ``least`` on)."""
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    fields = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the terms of 2 * SAMPLE stretches, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, whole.num_columns - 1):
                p = shared.value.scores(*lowered(batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))], names=fields)

    return docs.select(*keep, F.col("text").cast("string").alias(unused("_text", keep))).mapInArrow(run, schema)
