"""Quality classifier by compression.

Two zstandard dictionaries are built: one from texts labelled good, one from texts labelled bad. A text
that looks like the good ones gets shorter with the good dictionary. The score comes from
(size with the good one - size with the bad one) / (size with the good one + size with the bad one), the
normalised difference, and is calibrated by a logistic fit on labelled texts that were left out of the
dictionaries. Whole texts are compressed in blocks of ``BLOCK`` bytes, so that the dictionary counts
throughout a long text and memory stays bounded; sizes are summed.

Labels are learned from a bounded sample (``SAMPLE`` different texts of each label, those with the smallest hashes,
and of each a stretch of ``SAMPLE_BYTES``, from a place that hangs on the hash): two dictionaries and two coefficients do not
need more. Scoring covers every row and every byte of its text.

Defined results: null and empty texts get the score of a difference of 0; repeated rows score alike; rows
with a null label are not learned from; without labels of both kinds every score is 0.5; an empty
table gives no rows; other columns are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.sampling import labelled_texts
from inkveil.llm.texts import row_blocks, unused

BLOCK = 8192
LEVEL = 3
DICTIONARY_BYTES = 100_000
SAMPLE = 3000
SAMPLE_BYTES = 16384


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        packers = [_packer(d) for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            sizes = [0, 0]
            for at in range(0, len(text), BLOCK):
                block = text[at : at + BLOCK]
                for k, packer in enumerate(packers):
                    sizes[k] += len(packer.compress(block))
            out[i] = (sizes[0] - sizes[1]) / max(1, sum(sizes))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.differences(texts), -30, 30)))


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    # the content as it is: every text of the sample counts, and nothing is trained but by choice of text
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False)


def _dictionary(texts: list[bytes]) -> bytes:
    """A slice of each text, from a place between its begin and its end that varies from text to text."""
    if not texts:
        return b""
    each = max(64, DICTIONARY_BYTES // len(texts))
    starts = [int(max(0, len(t) - each) * ((i * 0.618) % 1)) for i, t in enumerate(texts)]
    return b"".join(t[s : s + each] for t, s in zip(texts, starts, strict=True))[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, with both labels of the same weight, so that 0.5 is the point of even likelihood whatever their shares."""
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    scale = max(float(x.std()), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, a.T @ (weight * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """labelled: text, label (1 good, 0 bad). Takes at most ``sample`` rows of each label to the driver."""
    rows = labelled.select("text", "label").withColumn("doc_id", F.xxhash64("text"))
    return fit_by_id(rows.select("doc_id", "text"), rows.select("doc_id", "label"), sample, sample_bytes)


def fit_by_id(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """As fit, of docs (doc_id, text) and labels (doc_id, label); only ids and hashes are joined."""
    return train(labelled_texts(docs, labels, sample, sample_bytes))


def train(texts: dict[int, list[bytes]]) -> QualityModel:
    """texts: for each label its texts, in any order that hangs on nothing but them."""
    half = {k: (v[::2], v[1::2]) for k, v in texts.items()}
    model = QualityModel(_dictionary(half[1][0]), _dictionary(half[0][0]), 0.0, 0.0)
    if not model.good or not model.bad:
        return model
    left = [(t, k) for k in (0, 1) for t in half[k][1]]
    x = model.differences([t for t, _ in left])
    y = np.array([k for _, k in left], float)
    if len(set(y)) < 2:
        return model
    intercept, slope = _logistic(x, y)
    return QualityModel(model.good, model.bad, slope, intercept)


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score and predicted."""
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    fields = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, whole.num_columns - 1):
                texts = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_binary()), b"").to_pylist()
                p = shared.value.scores(texts)
                columns = [*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.select(*keep, F.col("text").alias(unused("_text", keep))).mapInArrow(run, schema)
