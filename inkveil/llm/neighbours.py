"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Vectors that are equal make one node. The graph is built by the inner product itself, on codes: one byte per
coordinate and a scale for each vector, so that one vector of a very large norm leaves the others' codes alone.
Scores are computed on the original vectors, in double precision.

NN-descent: the graph starts from random projection trees (a bounded sample of ``SAMPLE`` vectors shapes
each of ``TREES`` trees of at most ``LEAVES`` leaves; every vector goes into a leaf of each, leaves are
dealt into blocks of ``BLOCK``, and a block's vectors are compared). Then, round by round, each node's neighbours and
reverse neighbours (as many at most as it has places) meet at the node by Spark joins and are
compared among each other, pairs of old ones aside; a pair counts only if it beats the worst neighbour of one
side. Each node keeps its ``K`` best. It ends when under ``SETTLED`` of the places change, or after ``ROUNDS``.

Search: a query, which is a row of the table, starts at its own node and in each step
opens the best ``WIDTH`` nodes not opened yet, by a join with the graph; it keeps the ``BEAM`` best seen. It
ends when no query opens a node, or after ``STEPS`` steps.

Defined results: vectors that are null, zero, empty or hold null or non-finite numbers, or differ in length from
most, take no part, as query or candidate; equal vectors are all candidates, in order of vec_id; rows that
repeat a vec_id count once; fewer candidates than k: all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.sampling import least_hashed
from inkveil.sources.scratch import dropped, materialised

K = 28
SAMPLE = 20_000
TREES = 3
LEAVES = 1024
BLOCK = 256
ROUNDS = 6
SETTLED = 0.01
BEAM = 96
WIDTH = 32
STEPS = 6
_EDGE = "u bigint, v bigint, s double, fresh boolean"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vec") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def best(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes and scales of vectors."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return data[:, 8:].view(np.int8).astype(np.float32), data[:, :8].copy().view(np.float64).ravel()


def _products(x: np.ndarray, scale: np.ndarray, part: slice = slice(None)) -> np.ndarray:
    """Inner products of some rows with all."""
    return (x[part] @ x.T) * scale[part, None] * scale


def _groups(batches: Iterator[pa.RecordBatch], keys: int, handle: Callable[[pa.RecordBatch], None]) -> Iterator[None]:
    """Calls ``handle`` with all rows of each run of equal values in the first ``keys`` columns; rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(i).to_numpy() for i in range(keys)])
        edges = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
        if held:
            before = [held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in range(keys)]
            if list(ids[0]) != before:
                handle(_one(held))
                held = []
        parts = np.concatenate([[0], edges, [batch.num_rows]])
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            if b < batch.num_rows:
                handle(_one([*held, batch.slice(a, b - a)]))
                held = []
            else:
                held.append(batch.slice(a, b - a))
        yield
    if held:
        handle(_one(held))
    yield


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Pairs:
    """Found pairs (a, b, s) of one task; only the K best of each a go on."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((a, b, s))
        self.size += len(a)

    def out(self, least: int) -> pa.RecordBatch | None:
        if self.size < max(1, least):
            return None
        a, b, s = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, s = a[once], b[once], s[once]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = nth < self.k
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep].astype(np.float64)), pa.array(np.ones(keep.sum(), bool))], names=["u", "v", "s", "fresh"])


def nodes_of(rows: DataFrame) -> DataFrame:
    """node (the least vec_id of a vector), vec and code."""
    rows = materialised(rows.groupBy("vec").agg(F.min("vec_id").alias("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(1))
            most = np.abs(x).max(1, keepdims=True, initial=1e-300)
            codes = np.rint(x / most * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() + c.tobytes() for m, c in zip(most / 127, codes, strict=True)], pa.binary())], names=["node", "vec", "code"])

    return materialised(rows.select("node", "vec").mapInArrow(run, "node bigint, vec array<double>, code binary"))


def _tree(codes: np.ndarray, rng: np.random.Generator, leaves: int) -> list[tuple]:
    """Nodes of a random projection tree: (direction, cut, left, right) or a leaf (None, leaf, 0, 0)."""
    out: list = []
    leaf = 0

    def grow(index: np.ndarray, room: int) -> int:
        nonlocal leaf
        at = len(out)
        out.append(None)
        if room < 2 or len(index) < 32:
            out[at] = (None, leaf, 0, 0)
            leaf += 1
            return at
        a, b = codes[rng.choice(index, 2, replace=False)].astype(np.float32)
        direction = a - b if (a != b).any() else rng.normal(size=codes.shape[1]).astype(np.float32)
        side = codes[index] @ direction
        cut = float(np.median(side))
        left = side < cut
        if left.all() or not left.any():
            left = rng.random(len(index)) < 0.5
        out[at] = (direction, cut, grow(index[left], room // 2), grow(index[~left], room - room // 2))
        return at

    grow(np.arange(len(codes)), leaves)
    return out


def _leaf_of(tree: list[tuple], codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    stack = [(0, np.arange(len(codes)))]
    while stack:
        at, index = stack.pop()
        direction, cut, left, right = tree[at]
        if direction is None:
            out[index] = cut
        elif len(index):
            low = codes[index] @ direction < cut
            stack += [(left, index[low]), (right, index[~low])]
    return out


def _first_graph(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    sample = least_hashed(nodes.select(F.lit(0).alias("all"), "code", F.xxhash64("node", F.lit(seed)).alias("h")), "all", SAMPLE, "code")
    codes = _codes(pa.array([bytes(r["code"]) for r in sample], pa.binary()))[0] if sample else np.zeros((0, 1), np.float32)
    rng = np.random.default_rng(seed)
    trees = nodes.sparkSession.sparkContext.broadcast([_tree(codes, rng, LEAVES) for _ in range(TREES)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _codes(batch.column(1))[0] if batch.num_rows else np.zeros((0, 1), np.float32)
            for t, tree in enumerate(trees.value):
                yield pa.RecordBatch.from_arrays([pa.array(_leaf_of(tree, x) * TREES + t), *batch.columns], names=["leaf", "node", "code"])

    rows = nodes.select("node", "code").mapInArrow(leaves, "leaf bigint, node bigint, code binary")
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = rows.join(blocks.hint("merge"), "leaf").select("leaf", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node", "code")
    rows = rows.repartition("leaf", "block").sortWithinPartitions("leaf", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs(k)

        def compare(group: pa.RecordBatch) -> None:
            ids, (x, scale) = group.column(2).to_numpy(), _codes(group.column(3))
            for a in range(0, len(ids), BLOCK):
                s = _products(x, scale, slice(a, a + BLOCK))
                s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
                few = min(k, len(ids) - 1)
                if few > 0:
                    top = np.argpartition(-s, few - 1, axis=1)[:, :few]
                    pairs.add(np.repeat(ids[a : a + BLOCK], few), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel())

        for _ in _groups(batches, 2, compare):
            if (out := pairs.out(2_000_000)) is not None:
                yield out
        if (out := pairs.out(1)) is not None:
            yield out

    return rows.mapInArrow(run, _EDGE)


def _kept(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return best(once, "u", [F.desc("s"), F.asc("v")], k)


def neighbour_graph(nodes: DataFrame, k: int = K, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 3) -> DataFrame:
    """Edges u, v, s: for each node its k nearest, as found."""
    edges = materialised(_kept(_first_graph(nodes, k, seed), k))
    places = None
    for i in range(rounds):
        worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(float("-inf"))).alias("worst"))
        known = nodes.select("node", "code").join(worst.select(F.col("u").alias("node"), "worst").hint("merge"), "node", "left").select("node", "code", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        back = best(edges.select(F.col("v").alias("at"), F.col("u").alias("node"), "fresh", F.xxhash64("u", "v", F.lit(i)).alias("h")), "at", [F.desc("fresh"), F.asc("h")], k).drop("h")
        meet = edges.select(F.col("u").alias("at"), F.col("v").alias("node"), "fresh").unionAll(back)
        meet = meet.groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
        meet = meet.join(known.hint("merge"), "node").select("at", "node", "fresh", "worst", "code").repartition("at").sortWithinPartitions("at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = _Pairs(k)

            def compare(group: pa.RecordBatch) -> None:
                ids, fresh, worst = (group.column(j).to_numpy(zero_copy_only=False) for j in (1, 2, 3))
                if not fresh.any():
                    return
                s = _products(*_codes(group.column(4)))
                good = (s > worst[:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(good, False)
                a, b = np.nonzero(good)
                pairs.add(ids[a], ids[b], s[a, b])

            for _ in _groups(batches, 1, compare):
                if (out := pairs.out(2_000_000)) is not None:
                    yield out
            if (out := pairs.out(1)) is not None:
                yield out

        found = meet.mapInArrow(run, _EDGE)
        edges, old = materialised(_kept(edges.withColumn("fresh", F.lit(False)).unionAll(found), k)), edges
        dropped(old)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
        if state["fresh"] <= settled * state["n"]:
            break
    return edges.select("u", "v", "s")


def greedy_search(queries: DataFrame, entries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """queries (q, vec), entries (q, node): q, node and score of the ``beam`` best nodes that each query met."""
    back = best(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), "u", [F.desc("s"), F.asc("v")], K)
    links = graph.select("u", "v").unionAll(back.select("u", "v")).distinct().groupBy("u").agg(F.collect_list("v").alias("vs"))  # 2 * K at most
    links = materialised(links)
    vectors = nodes.select("node", "vec")
    state = None
    new = entries.distinct()
    for step in range(steps + 1):
        heads = queries.join(new.select("q").distinct().hint("merge"), "q").select("q", F.lit(None).cast("long").alias("node"), "vec")
        rows = new.join(vectors.hint("merge"), "node").select("q", "node", "vec").unionAll(heads)
        rows = rows.repartition("q").sortWithinPartitions("q", F.col("node").asc_nulls_first())
        scored = rows.mapInArrow(_scores, "q bigint, node bigint, score double").withColumn("opened", F.lit(False))
        state = scored if state is None else state.unionAll(scored)
        state = best(state, "q", [F.desc("score"), F.asc("node")], beam)
        if step == steps:
            break
        rank = F.row_number().over(Window.partitionBy("q").orderBy("opened", F.desc("score"), F.asc("node")))
        state = materialised(state.withColumn("opens", ~F.col("opened") & (rank <= width)))
        opened = state.filter("opens").select("q", F.col("node").alias("u"))
        if opened.isEmpty():
            break
        found = opened.join(links.hint("merge"), "u").select("q", F.explode("vs").alias("node")).distinct()
        new = found.join(state.select("q", "node").hint("merge"), ["q", "node"], "left_anti")
        state = state.select("q", "node", "score", (F.col("opened") | F.col("opens")).alias("opened"))
    return state.select("q", "node", "score")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by q, the query's own first: the inner products."""
    vec, q = None, None
    for batch in batches:
        ids, nodes = batch.column(0).to_numpy(), batch.column(1)
        own = nodes.is_null().to_numpy(zero_copy_only=False)
        x = _floats(batch.column(2))
        edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, int)
        scores = np.zeros(len(ids))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if own[a]:
                vec, q = x[a], ids[a]
            if q == ids[a]:
                scores[a:b] = (x[a:b] * vec).sum(1)
        keep = pa.array(~own)
        yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(scores)], names=["q", "node", "score"]).filter(keep)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """queries: vec_id of rows that ask. query_id, rank, vec_id, score of each one's k nearest other rows, as found."""
    rows = materialised(valid(vectors))
    nodes = nodes_of(rows)
    graph = neighbour_graph(nodes)
    member = rows.join(nodes.select("vec", "node").hint("merge"), "vec").select("vec_id", "node")
    member = materialised(member)
    asked = queries.select(F.col("vec_id").cast("long").alias("q")).distinct()
    entries = asked.join(member.select(F.col("vec_id").alias("q"), "node").hint("merge"), "q")
    ask = asked.join(rows.select(F.col("vec_id").alias("q"), "vec").hint("merge"), "q")
    met = best(greedy_search(ask, entries, nodes, graph), "q", [F.desc("score"), F.asc("node")], k + 1)
    # of equal vectors, only the k + 1 with the least vec_id can be among the k nearest others
    few = best(member, "node", [F.asc("vec_id")], k + 1)
    out = met.join(few.hint("merge"), "node").filter("vec_id <> q")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
