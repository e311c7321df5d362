"""Language identification by a byte convolutional network.

Bytes go through filters of several widths; each filter's maximum over a window (max pooling) is one
feature and a softmax layer on the features gives the languages' probabilities. A filter over one-hot
bytes is a table lookup per position, so a window costs width additions per filter. The network is
trained here, in numpy, by Adam on labelled texts. A text is cut into windows of ``WINDOW`` bytes that
cover all of it (the last one padded by spaces); the windows' probabilities are averaged by their bytes.

Training uses a bounded sample: at most ``SAMPLE`` different texts of each language, those with the smallest hashes, and
``SAMPLE_WINDOWS`` stretches of each, from places all over the text that hang on its hash. Prediction covers every row and every byte.

Defined results: ``und`` with score 0 for null texts and for texts without any letter; ``und`` too if
nothing was learned; repeated rows get equal results; an empty table gives no rows; other columns
are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.sampling import least_hashed
from inkveil.llm.texts import row_blocks, text_bytes, unused

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE = 1500
SAMPLE_WINDOWS = 4
EPOCHS = 14
BATCH = 128
RATE = 0.01
NONE = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """windows: (n, WINDOW) bytes. The pooled features, rectified, and the places of the maxima."""
        pooled, places = [], []
        for table in self.tables:
            width = len(table)
            span = windows.shape[1] - width + 1
            total = table[0][windows[:, :span]]
            for j in range(1, width):
                total += table[j][windows[:, j : j + span]]
            place = total.argmax(axis=1)
            pooled.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            places.append(place)
        return np.concatenate(pooled, 1) + self.bias, places

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """As features, without the places; a few windows at a time stay in the cache."""
        out = np.empty((len(windows), len(self.bias)), np.float32)
        for at in range(0, len(windows), 32):
            part, k = windows[at : at + 32], 0
            for table in self.tables:
                width, filters = len(table), table.shape[2]
                span = part.shape[1] - width + 1
                total = table[0].take(part[:, :span], 0)
                for j in range(1, width):
                    total += table[j].take(part[:, j : j + span], 0)
                out[at : at + 32, k : k + filters] = total.max(axis=1)
                k += filters
        return out + self.bias

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.pooled(windows), 0) @ self.out + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, the row of each and its number of bytes."""
    lengths = np.diff(off)
    counts = -(-lengths // WINDOW)
    rows = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = off[rows] + nth * WINDOW
    used = np.minimum(off[rows + 1] - begin, WINDOW) if len(rows) else np.zeros(0, np.int64)
    index = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    out = np.where(inside, buf[np.minimum(index, max(len(buf) - 1, 0))], np.uint8(32)) if len(rows) else np.zeros((0, WINDOW), np.uint8)
    return out, rows, used


def train(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel:
    """texts: one window of text each."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    size = FILTERS * len(WIDTHS)
    model = LanguageModel(names, tables, np.zeros(size, np.float32), rng.normal(0, 0.1, (size, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return model
    place = {k: i for i, k in enumerate(names)}
    cut = [(t.encode()[:WINDOW], place[k]) for t, k in zip(texts, languages, strict=True) if t]
    x, rows, _ = windows_of(*_join([t for t, _ in cut]))
    y = np.array([k for _, k in cut])[rows]
    params = [*model.tables, model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            windows, want = x[part], y[part]
            raw, places = model.features(windows)
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ model.out + model.out_bias)
            error[np.arange(len(part)), want] -= 1
            error /= len(part)
            back = (error @ model.out.T) * (raw > 0)
            grads = []
            for k, table in enumerate(model.tables):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(table)
                for j in range(len(table)):
                    cell = np.take_along_axis(windows, places[k] + j, 1) * np.int64(FILTERS) + np.arange(FILTERS)
                    grad[j] = np.bincount(cell.ravel(), own.ravel(), grad[j].size).reshape(grad[j].shape)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ error + 1e-4 * model.out, error.sum(0)]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """labelled: text, lang. At most ``sample`` texts of each language send SAMPLE_WINDOWS stretches of WINDOW characters to the driver."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    room = F.greatest(F.length("text") - F.lit(WINDOW), F.lit(0)) + 1
    parts = F.array_distinct(F.array(*[F.substring(F.col("text"), F.pmod(F.xxhash64("h", F.lit(i)), room).cast("int") + 1, F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]))
    found = [(part, r["lang"]) for r in least_hashed(rows.withColumn("parts", parts), "lang", sample, "parts") for part in r["parts"]]
    return train([t for t, _ in found], [k for _, k in found])


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns of ``keep``, lang_pred and score, whose names begin with ``prefix``."""
    schema = docs.select(*keep).schema.add(f"{prefix}lang_pred", "string").add(f"{prefix}score", "double")
    fields = [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, NONE], object)
        for whole in batches:
            for batch in row_blocks(whole, whole.num_columns - 1):
                column = batch.column(batch.num_columns - 1)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                windows, rows, used = windows_of(*text_bytes(column))
                sums = np.zeros((batch.num_rows, max(1, len(model.languages))))
                if len(windows) and model.languages:
                    np.add.at(sums, rows, model.probabilities(windows) * used[:, None])
                sums /= np.maximum(sums.sum(1, keepdims=True), 1e-300)
                known = letters & bool(model.languages)
                best = np.where(known, sums.argmax(1), len(model.languages))
                score = np.where(known, np.clip(sums.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=fields)

    return docs.select(*keep, F.col("text").alias(unused("_text", keep))).mapInArrow(run, schema)
