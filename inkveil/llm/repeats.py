"""Suffix-array dedup: removes every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too.

Finding where equal strings can meet. Each string of LENGTH bytes is keyed by the least hash of its
``GRAM``-byte substrings. Equal strings have equal keys, and neighbouring strings mostly share theirs: a
maximal run of starts with one key (``RUN`` at most) is a *window*, of LENGTH - 1 + run bytes. Only keys that
occur twice in the corpus can hold a repeat; all other windows are dropped before any text is moved.

Deciding. All windows of a key come together, in the bucket of the text stretch with the least hash among them
(so that overlapping windows, which mostly meet the same other texts, form one *segment* that is sent once) or, for a key of over
``MERGED`` windows, in a bucket of its own. Segments end at places that hang on their bytes alone (one window in ``CUTS``), so
near copies differ in few of them. Segments that are equal form one class, counted map-side by hash; a class of
two or more repeats throughout. Only buckets that also hold a segment that occurs once are left to decide: one text of
each of their classes is fetched. In such a bucket, the starts that repeat are found on
the Burrows-Wheeler transform of its distinct segments: beginning with the interval of the empty string,
breadth-first backward extension visits the intervals of all strings of length 1, 2, 3, ... An interval that
ends at a place whose common prefix is still unknown fixes it to the length so far and is extended further;
others are dropped. After ``LENGTH`` rounds expansion stops: exactly the places still unknown lie between
suffixes with LENGTH or more common bytes. A key with over ``HOT`` windows (a passage in very many
contexts) would not fit in a task: its distinct single strings are grouped by two 64-bit hashes instead, with
map-side counts, which is exact as well.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing; overlapping repeats within
one text count; documents that share a doc_id (null included) are told apart by a hash of their text, and equal rows get
equal results, each being a copy of the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.texts import BYTE_CODES, U64, mix, row_blocks, text_bytes
from inkveil.sources.scratch import dropped, materialised

LENGTH = 200
GRAM = 128
RUN = 128
#: Up to so many windows of a key are brought together by their texts' stretches of LEADER_BYTES, more by the key.
MERGED = 64
LEADER_BYTES = 16384
#: Keys of more windows are decided string by string.
HOT = 4096
#: A segment ends before one in so many windows.
CUTS = 8
CHUNK_BYTES = 1 << 20
#: Longer texts are searched for windows in pieces of so many starts.
PIECE_BYTES = 1 << 20
_FACTORS = [U64(int(x)) for x in np.random.default_rng(5).integers(1, 2**62, 16) * 2 + 1]
_POSITION_BITS = 26


def _gram_hashes(buf: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Linear hashes of all substrings of the given powers of two; those that reach over the end are void."""
    out, level, k = {}, BYTE_CODES[buf], 1
    while True:
        if k in sizes:
            out[k] = level
        if k >= max(sizes):
            return out
        longer = level * _FACTORS[k.bit_length() - 1]
        longer[: max(0, len(level) - k)] += level[k:]
        level, k = longer, 2 * k


def _string_hash(grams: dict[int, np.ndarray], at: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place, from the hashes of their parts."""
    out, done = np.zeros(len(at), U64), 0
    for k in sorted(grams, reverse=True):
        while length - done >= k:
            out = mix(out * _FACTORS[12 + salt] + grams[k][at + done] + U64(k + salt))
            done += k
    return out


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the leftmost, by the upper bits) in every window of ``width``."""
    n = len(values) - width + 1
    pad = -len(values) % width
    packed = (values >> U64(_POSITION_BITS) << U64(_POSITION_BITS)) | np.arange(len(values), dtype=U64)
    packed = np.concatenate([packed, np.full(pad, 2**64 - 1, U64)]).reshape(-1, width)
    before = np.minimum.accumulate(packed, axis=1).ravel()
    after = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (least & U64(2**_POSITION_BITS - 1)).astype(np.int64)


def find_windows(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """All windows of all rows: row, start (in the row), run, key, and tie: whether the key has two places in it."""
    empty = {k: np.zeros(0, np.int64) for k in ("row", "start", "run")} | {"key": np.zeros(0, U64), "tie": np.zeros(0, bool)}
    if len(buf) < length:
        return empty
    values = mix(_gram_hashes(buf, (GRAM,))[GRAM])
    place = least_in_windows(values[: len(buf) - GRAM + 1], length - GRAM + 1)
    key = values[place]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(key)]
    inside = np.arange(len(key)) + length <= off[1:][row]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    begin, size = begin[inside[begin]], size[inside[begin]]
    pieces = -(-size // RUN)
    index = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[index] + nth * RUN
    run = np.minimum(size[index] - nth * RUN, RUN)
    # a string can repeat within its own window only if the key's place moves there
    moves = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    return {"row": row[start], "start": start - off[row[start]], "run": run, "key": key[start], "tie": moves[start + run - 1] != moves[start]}


def _windows_of_long(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """As find_windows, in bounded memory: a start's key hangs on its LENGTH bytes alone, so pieces that overlap by as many lose nothing."""
    parts = []
    for row, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        for at in range(0, int(b - a), PIECE_BYTES):
            piece = buf[a + at : min(b, a + at + PIECE_BYTES + LENGTH - 1)]
            found = find_windows(piece, np.array([0, len(piece)]))
            parts.append(found | {"row": found["row"] + row, "start": found["start"] + at})
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` (or more) bytes; each step triples the length that is compared."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    packed = np.zeros(n, U64)
    for j in range(8):
        packed = packed << U64(8) | wide[j : j + n]
    step, times, bits = 8, 3 if n < 1 << 21 else 2, U64(21 if n < 1 << 21 else 32)
    while True:
        order = np.argsort(packed)
        ranked = packed[order]
        rank_in_order = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(U64)
        if step >= depth or rank_in_order[-1] == n - 1:
            return order
        rank = np.zeros(n + step * (times - 1), U64)
        rank[order] = rank_in_order + U64(1)
        packed = rank[:n].copy()
        for k in range(1, times):
            packed <<= bits
            packed |= rank[k * step : k * step + n]
        step *= times


def repeated_starts(text: np.ndarray, room: np.ndarray, place: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """Which starts begin a string of ``length`` bytes that begins elsewhere too.

    text: bytes with every string closed by a 0 (no string holds one). room: bytes from each place to its string's end.
    place: where each byte comes from; what was sent twice from one place doesn't repeat by that.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform
    by_byte = np.argsort(before, kind="stable")
    step_back = np.empty(n, np.int64)
    step_back[by_byte] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        index = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        interval = np.repeat(np.arange(len(low)), size)
        byte = before[index]
        real = byte > 0
        index, interval, byte = index[real], interval[real], byte[real]
        if not len(index):
            break
        turn = np.argsort(byte, kind="stable")
        interval, byte, to = interval[turn], byte[turn], step_back[index[turn]]
        edge = np.flatnonzero((interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1])) + 1
        low = to[np.concatenate([[0], edge])]
        high = to[np.concatenate([edge - 1, [len(to) - 1]])] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    long = room[order] >= length
    same = np.zeros(n + 1, bool)
    same[1:n] = long[1:] & long[:-1] & ~known[1:n]
    if place is not None:
        # groups of neighbours with one string, of which all come from one place
        first = np.flatnonzero(~same[:n])
        where = place[order]
        alone = np.minimum.reduceat(where, first) == np.maximum.reduceat(where, first)
        same[1:n] &= ~np.repeat(alone, np.diff(np.append(first, n)))[1:]
    out = np.zeros(n, bool)
    out[order] = same[1:] | same[:-1]
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches that the given ones cover."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])) if len(begin) else np.zeros(0, np.int64)
    return begin[new], reach[np.append(new[1:], len(begin)) - 1] if len(new) else reach


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments sorted by bucket, as _cut gives them. Gives the repeated stretches of single ones."""
    held: list[tuple] = []
    size, last, kind = 0, None, pa.int64()

    def solved() -> pa.RecordBatch:
        joined = b"\0".join(x[6] for x in held) + b"\0"
        # UTF-8 has no byte over 0xF4, so a step up frees 0
        text = np.frombuffer(joined, np.uint8).copy()
        lengths = np.array([len(x[6]) for x in held])
        ends = np.cumsum(lengths + 1) - 1
        text += 1
        text[ends] = 0
        room = np.repeat(ends, lengths + 1) - np.arange(len(text))
        # a segment of several copies stands for other places too
        known: dict[tuple, int] = {}
        base = [((known.setdefault((x[1], x[2]), len(known)) + 1) << 32) + x[3] if x[5] == 1 else -(i << 32) for i, x in enumerate(held, 1)]
        within = np.arange(len(text)) - np.repeat(ends - lengths, lengths + 1)
        flags = repeated_starts(text, room, np.repeat(np.array(base, np.int64), lengths + 1) + within)
        out = []
        for x, end, size in zip(held, ends, lengths, strict=True):
            if x[5] == 1:
                for a, b in _spans(flags[end - size : end - size + x[4]]):
                    out.append((x[1], x[2], x[3] + a, x[3] + b - 1 + LENGTH))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "mark", "begin", "end"])

    for batch in batches:
        kind = batch.schema.types[1]
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= CHUNK_BYTES and row[0] != last:
                yield solved()
                held, size = [], 0
            held.append(row)
            size += len(row[6]) + 1
            last = row[0]
    if held:
        yield solved()


def _marks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """40 bits of a hash of each text, to tell rows of one doc_id apart."""
    return np.array([int.from_bytes(hashlib.blake2b(buf[a:b].tobytes(), digest_size=5).digest(), "big") for a, b in zip(off[:-1], off[1:], strict=True)], np.int64)


def _window_table(docs: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """All keys (key, n, leader) and all windows (doc_id, mark, place, key)."""

    def find(batches: Iterator[pa.RecordBatch], where: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, "text", 1 << 18):
                buf, off = text_bytes(batch.column(1))
                found = find_windows(buf, off) if len(buf) <= PIECE_BYTES else _windows_of_long(buf, off)
                mark, place = _marks(buf, off)[found["row"]], found["start"] << 8 | found["run"]
                key = pa.array(found["key"].view(np.int64))
                if where:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found["row"])), pa.array(mark), pa.array(place), key], names=["doc_id", "mark", "place", "key"])
                else:
                    # stretches of LEADER_BYTES of a text; windows of one key go to the one with the least hash
                    leader = mix(mark.astype(U64) << U64(24) ^ (found["start"] // LEADER_BYTES).astype(U64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([key, pa.array(1 + found["tie"].astype(np.int64)), pa.array(leader)], names=["key", "n", "leader"])

    base = docs.select("doc_id", "text")
    keys = base.mapInArrow(lambda batches: find(batches, False), "key bigint, n bigint, leader bigint")
    return keys, base.mapInArrow(lambda batches: find(batches, True), f"doc_id {id_type}, mark bigint, place bigint, key bigint")


def _segments(id_type: str):
    """(doc_id, text, array of (place, mark, bucket, hot)) to segments without their texts: windows of one bucket that overlap become one, up to the next cut."""
    names = ["bucket", "hot", "a", "b", "doc_id", "mark", "begin", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text or "").encode()
                buf = np.frombuffer(data, np.uint8)
                own = int(_marks(buf, np.array([0, len(data)]))[0])
                place, mark, bucket, hot = (wanted.values.field(k).to_numpy(zero_copy_only=False) for k in ("place", "mark", "bucket", "hot"))
                mine = np.flatnonzero(mark == own)
                if not len(mine):
                    continue  # another text of this doc_id is meant
                mine = mine[np.lexsort((place[mine], bucket[mine]))]
                start, run, bucket, hot = place[mine] >> 8, place[mine] & 255, bucket[mine], hot[mine]
                once = np.concatenate([[True], (start[1:] != start[:-1]) | (bucket[1:] != bucket[:-1])])  # equal rows come twice
                start, run, bucket, hot = start[once], run[once], bucket[once], hot[once]
                cut = mix(buf[start[:, None] + np.arange(8)].view(U64).ravel()) % U64(CUTS) == 0
                # windows whose texts overlap become one stretch; what lies between their starts is searched with them
                new = np.concatenate([[True], (start[1:] >= start[:-1] + run[:-1] + LENGTH) | (bucket[1:] != bucket[:-1]) | hot[1:] | hot[:-1] | cut[1:]])
                first = np.flatnonzero(new)
                begins, ends = start[first], (start + run)[np.append(first[1:], len(start)) - 1]
                digests = b"".join(hashlib.blake2b(data[i : j + LENGTH - 1], digest_size=16).digest() for i, j in zip(begins.tolist(), ends.tolist(), strict=True))
                hashes = np.frombuffer(digests, np.int64).reshape(-1, 2)
                same = [doc_id] * len(first), [own] * len(first)
                for column, values in zip(out, (bucket[first], hot[first], hashes[:, 0], hashes[:, 1], *same, begins, ends - begins), strict=True):
                    column.extend(values if isinstance(values, list) else values.tolist())
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), batch.schema.types[0], *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run, f"bucket bigint, hot boolean, a bigint, b bigint, doc_id {id_type}, mark bigint, begin bigint, starts bigint"


def _cut(id_type: str):
    """(doc_id, text, array of (bucket, mark, begin, starts, copies)) to the wanted stretches with their texts."""
    names = ["bucket", "doc_id", "mark", "begin", "starts", "copies", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text or "").encode()
                own = int(_marks(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])
                done = set()  # equal rows
                for bucket, mark, begin, starts, copies in zip(*(wanted.values.field(k).to_pylist() for k in ("bucket", "mark", "begin", "starts", "copies")), strict=True):
                    if mark == own and (bucket, begin) not in done:
                        done.add((bucket, begin))
                        for column, value in zip(out, (bucket, doc_id, own, begin, starts, copies, data[begin : begin + starts + LENGTH - 1]), strict=True):
                            column.append(value)
            kinds = (pa.int64(), batch.schema.types[0], *[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run, f"bucket bigint, doc_id {id_type}, mark bigint, begin bigint, starts bigint, copies bigint, text binary"


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For windows of a hot key: each string by itself, as two hashes."""
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            buf, off = text_bytes(part.column("text"))
            run = part.column("starts").to_numpy()
            row = np.repeat(np.arange(part.num_rows), run)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
            grams = _gram_hashes(buf, tuple(1 << i for i in range(8) if LENGTH >> i & 1))
            a, b = (_string_hash(grams, off[row] + nth, LENGTH, salt) for salt in (0, 1))
            picked = pa.array(row)
            columns = [part.column(k).take(picked) for k in ("doc_id", "mark", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part.column("begin").to_numpy()[row] + nth), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "mark", "copies", "begin", "a", "b"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, begin, end: stretches of bytes to remove; they may overlap. mark: see _marks."""
    id_type = docs.select("doc_id").dtypes[0][1]
    keys, windows = _window_table(docs, id_type)
    twice = keys.groupBy("key").agg(F.sum("n").alias("n"), F.min("leader").alias("leader")).filter("n > 1")
    found = windows.join(twice.hint("merge"), "key")
    # the next exchange is by document, so AQE can split a key of very many windows in this join
    bucket = F.when(F.col("n") <= MERGED, F.col("leader")).otherwise(F.col("key")).alias("bucket")
    wanted = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("place", "mark", bucket, (F.col("n") > HOT).alias("hot"))).alias("wanted"))
    wanted = materialised(wanted)
    base = docs.select("doc_id", "text")

    def with_texts(wanted: DataFrame) -> DataFrame:
        return base.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "wanted")

    segments = materialised(with_texts(wanted).mapInArrow(*_segments(id_type)))
    dropped(wanted)
    group = ["bucket", "a", "b"]
    classes = materialised(segments.groupBy(*group).agg(F.count(F.lit(1)).alias("copies"), F.first("hot").alias("hot"), F.min(F.struct("doc_id", "mark", "begin", "starts")).alias("one")))
    # segments of two or more copies repeat as a whole
    whole = segments.select(*group, "doc_id", "mark", "begin", "starts").join(classes.filter("copies > 1").select(*group).hint("merge"), group)
    whole = whole.select("doc_id", "mark", "begin", (F.col("begin") + F.col("starts") + F.lit(LENGTH - 1)).alias("end"))
    # one text of each class, where a bucket holds a single segment too
    open_ = classes.groupBy("bucket").agg(F.min("copies").alias("least")).filter("least = 1").select("bucket")
    asked = classes.join(open_.hint("merge"), "bucket").select(F.col("one.doc_id").alias("id"), "hot", F.struct("bucket", "one.mark", "one.begin", "one.starts", "copies").alias("x"))

    def texts(hot: bool) -> DataFrame:
        return with_texts(asked.filter(F.col("hot") == hot).groupBy("id").agg(F.collect_list("x").alias("wanted"))).mapInArrow(*_cut(id_type))

    spans = texts(False).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_solve, f"doc_id {id_type}, mark bigint, begin bigint, end bigint")
    out = materialised(whole.unionAll(spans))
    dropped(segments)
    if classes.filter("hot").isEmpty():
        dropped(classes)
        return out
    single = texts(True).select("doc_id", "mark", "begin", "starts", "copies", "text").mapInArrow(_single_strings, f"doc_id {id_type}, mark bigint, copies bigint, begin bigint, a bigint, b bigint")
    single = materialised(single)
    dropped(classes)
    often = single.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n > 1").select("a", "b")
    return out.unionAll(single.filter("copies = 1").join(often.hint("merge"), ["a", "b"]).select("doc_id", "mark", "begin", (F.col("begin") + F.lit(LENGTH)).alias("end")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    id_type = docs.select("doc_id").dtypes[0][1]
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("mark", "begin", "end")).alias("spans"))
    base = docs.select("doc_id", "text")
    both = base.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "spans")
    ddl = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, "text"):
                buf, off = text_bytes(batch.column(1))
                marks = _marks(buf, off)
                out = []
                spans = batch.column(2)
                flat, edges = spans.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())])
                mark, begin, end = (flat.field(k).to_numpy() for k in ("mark", "begin", "end"))
                for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
                    data = buf[a:b]
                    own = slice(edges[i], edges[i + 1])
                    mine = mark[own] == marks[i]
                    first, last = merged(begin[own][mine], end[own][mine])
                    edges_of = [0, *np.column_stack([first, last]).ravel().tolist(), len(data)]
                    left = b"".join(data[x:y].tobytes() for x, y in zip(edges_of[::2], edges_of[1::2], strict=True))
                    out.append((len(data), len(data) - len(left), len(first), hashlib.sha256(left).hexdigest(), left))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, ddl)
