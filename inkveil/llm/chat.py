r"""Chat formatting with offset-aligned loss masks.

Template: each turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three marks are special tokens of
the encoder, so no token reaches over a turn's edge. Inside roles and texts every ``<``, backslashes,
``|`` gets one more backslash before the ``|``; removing one gives the original back, so no text can hold
a mark and nothing is lost.

A conversation is rendered whole and encoded once, with offsets. Its turns' text spans are sorted, and so
are the tokens' starts: two binary searches per span give the tokens under the loss mask. A token
that begins inside an assistant text is masked for the loss.

Rows are sorted by conversation and turn within partitions and streamed: a task holds one conversation
at a time; one of over ``PIECE_CHARS`` characters is rendered, encoded and digested in pieces that end
at turn edges. As marks are special tokens, the tokens of the pieces are the tokens of the whole.

Defined results: null roles, texts and turns: empty, empty and first; rows that tie in turn go by role and
text; rows with a null conv_id make one conversation of their own; repeated rows are repeated turns;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Described in the README of that folder; its path is a parameter of all functions here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans (code points) of its assistant texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def encoder(path: str = TOKENIZER):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in (START, SEP, END)])
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """offsets: (n, 2), sorted. 1 for each token that begins within a span."""
    mask = np.zeros(len(offsets), np.int8)
    if len(spans) and len(offsets):
        edges = np.array(spans)
        first = np.searchsorted(offsets[:, 0], edges[:, 0], "left")
        last = np.searchsorted(offsets[:, 0], edges[:, 1], "left")
        for a, b in zip(first, last, strict=True):
            mask[a:b] = 1
    return mask


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of ``formatted`` under the mask; tokens of one stretch touch or share a character."""
    own = offsets[mask == 1]
    if not len(own):
        return []
    ends = np.maximum.accumulate(own[:, 1])
    new = np.flatnonzero(own[1:, 0] > ends[:-1]) + 1
    starts = own[np.concatenate([[0], new]), 0]
    stops = ends[np.concatenate([new - 1, [len(own) - 1]])]
    return [formatted[a:b] for a, b in zip(starts, stops, strict=True)]


class _Digest:
    """What is read back from the formatted pieces of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, turns: list[tuple[str, str]], tokenizer) -> tuple[str, list[int], np.ndarray]:
        formatted, spans = render(turns)
        encoding = tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for text in map(unescape, masked_texts(formatted, offsets, mask)):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.tokens += len(offsets)
        self.loss_tokens += int(mask.sum())
        return formatted, encoding.ids, mask


def _conversations(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[object, list[tuple[str, str]], bool]]:
    """(conv_id, turns of one piece, whether it is the conversation's last piece), from sorted rows. kinds: gets conv_id's type."""
    now, turns, size, begun = None, [], 0, False
    for batch in batches:
        kinds[:] = [batch.schema.types[0]]
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv != now:
                yield now, turns, True
                turns, size = [], 0
            elif size > PIECE_CHARS:
                yield now, turns, False
                turns, size = [], 0
            now, begun = conv, True
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if begun:
        yield now, turns, True


def _sorted(rows: DataFrame) -> DataFrame:
    rows = rows.select("conv_id", "role", "text", "turn")
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()).select("conv_id", "role", "text")


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, piece (from 0), formatted, token_ids and loss_mask: one row per conversation or, beyond PIECE_CHARS, per piece."""
    ddl = f"conv_id {rows.select('conv_id').dtypes[0][1]}, piece bigint, formatted string, token_ids array<int>, loss_mask array<tinyint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, piece, kinds = encoder(tokenizer), 0, []
        for conv, turns, last in _conversations(batches, kinds):
            formatted, ids, mask = _Digest().add(turns, tool)
            yield _batch([(conv, piece, formatted, ids, mask.tolist())], ddl, [kinds[0], pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8())])
            piece = 0 if last else piece + 1

    return _sorted(rows).mapInArrow(run, ddl)


def digests(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation, read back from the formatted text and its masked tokens."""
    ddl = f"conv_id {rows.select('conv_id').dtypes[0][1]}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, digest, out, kinds = encoder(tokenizer), _Digest(), [], []
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for conv, turns, last in _conversations(batches, kinds):
            digest.add(turns, tool)
            if last:
                out.append((conv, digest.n_turns, digest.turns.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars, digest.tokens, digest.loss_tokens))
                digest = _Digest()
                if len(out) >= 1000:
                    yield _batch(out, ddl, [kinds[0], *types])
                    out = []
        if out:
            yield _batch(out, ddl, [kinds[0], *types])

    return _sorted(rows).mapInArrow(run, ddl)


def _batch(rows: list[tuple], ddl: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in ddl.split(", ")])
