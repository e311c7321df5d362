"""N-gram Jaccard join through a count-vector R-tree.

Two documents link when den * |A and B| >= num * |A or B| for their sets of distinct n-word shingles; the
result is each document's component. Sets that are equal make one class first, so copies cost one row.

Which classes can meet. Linked sets of sizes a and b differ in at most t = (den - num)(a + b) / (den + num)
shingles. Shingles are hashed into m > t groups, by a size class that both sizes share; a difference
spoils one group at most, so linked sets have m - t equal groups. Groups are ranked by their number of shingles,
the largest first, then by hash, alike for equal groups; the first t + 1 of a set are its keys. Of the m - t
equal groups one must be among the first t + 1 of both, so linked sets share a key. Nothing is lost by this, at any
frequency, and groups of one or two common shingles are left out. A bucket is all classes with one key.

Deciding within buckets, without all pairs. The counts of a class's shingles in hash groups (a power of two of them,
``GROUPS`` or more, with two shingles each at most on average) are a point; the sum of the minima of two points' coordinates
bounds the overlap. Points of more groups are folded to the other's number before that. Each class is first compared with the
least class of all of its buckets, by points, then by sets, then with the least classes of its single buckets where those
are in other components; in a group of near copies this links nearly all. Then only buckets that still
hold several components are searched: points, folded to ``GROUPS``, go into an R-tree, in which the largest coordinates below a
node bound the overlap with all of it, leaves are bounded by the whole points, and classes with a near point in another
component are searched again with their sets, which are exact. Buckets of more than ``BLOCK`` classes are searched as pairs
of blocks, so no task holds more than two blocks.

Defined results: null texts and texts without words: n_shingles 0, a component alone; fewer than n
words: the sequence is the one shingle; repeated rows are in one component (rows with a null doc_id get
the least doc_id of theirs, or null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.graph import components
from inkveil.llm.texts import U64, mix, row_blocks, shingles, text_bytes, word_hashes
from inkveil.sources.scratch import dropped, materialised

GROUPS = 64
BLOCK = 1000
LEAF = 16
#: Trees of so few points are bounded as a whole.
FEW = 128
#: Pairs of one least class that are compared in one task.
STAR = 2000
#: Classes that a task remembers having sent.
REMEMBERED = 1_000_000
_SIZES = [1]
while _SIZES[-1] < 1 << 40:
    _SIZES.append(max(_SIZES[-1] + 1, _SIZES[-1] * 3 // 2))


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all rows, each sorted, in one array, and their offsets."""
    words, at = word_hashes(*text_bytes(column))
    found = [shingles(words[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(found) if found else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[at[1:]] - total[at[:-1]]


def set_hashes(elements: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: sums over its elements."""
    return _sums(mix(elements ^ U64(0xA24BAED4963EE407 + seed)), at), _sums(mix(elements * U64(0x9FB21C651E98DF25) + U64(seed)), at)


def keys_of(elements: np.ndarray, at: np.ndarray, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the sets of ``rows``, for their own size classes and those of larger sets that they may link with."""
    size = np.diff(at)[rows]
    own = np.searchsorted(_SIZES, size, "right") - 1
    last = np.searchsorted(_SIZES, size * den // num, "right") - 1
    out_rows, out_keys = [], []
    for j in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in {*zip(own.tolist(), last.tolist(), strict=True)}])) if len(rows) else ():
        differ = (den - num) * 2 * (_SIZES[j + 1] - 1) // (den + num)
        mine = rows[(own <= j) & (j <= last) & (size > 0)]
        if not differ or not len(mine):
            continue  # without a difference only equal sets link, and those are one class
        m = differ + 1 + differ // 3
        counts = np.diff(at)[mine]
        index = np.repeat(at[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        values = elements[index]
        place = np.repeat(np.arange(len(mine)) * m, counts) + (mix(values ^ U64(0x5851F42D4C957F2D + int(j))) % U64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums, there, many = np.add.reduceat(mix(values[order] + U64(0x1B873593)), edge), place[edge], np.diff(np.append(edge, len(place)))
        row, group = there // m, there % m
        key = mix(sums ^ mix(group.astype(U64) + (U64(int(j)) << U64(40))))
        rank = np.lexsort((key, -many, row))
        row, key = row[rank], key[rank]
        begin = np.searchsorted(row, np.arange(len(mine)))
        kept = np.arange(len(row)) - begin[row] <= differ
        out_rows.append(mine[row[kept]])
        out_keys.append(key[kept])
        # sets of fewer groups than keys: empty groups follow, ranked by hash
        full = np.bincount(row, minlength=len(mine))
        for k in np.flatnonzero(full <= differ):
            gone = np.setdiff1d(np.arange(m), group[there // m == k])
            empty = np.sort(mix(mix(gone.astype(U64) + (U64(int(j)) << U64(40)))))[: differ + 1 - full[k]]
            out_rows.append(np.full(len(empty), mine[k]))
            out_keys.append(empty)
    return (np.concatenate(out_rows), np.concatenate(out_keys)) if out_rows else (np.zeros(0, np.int64), np.zeros(0, U64))


def groups_for(size: np.ndarray) -> np.ndarray:
    """The number of groups of a set: the least power of two that leaves two elements a group, GROUPS at least."""
    return np.maximum(GROUPS, 2 ** np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64))


def points_of(elements: np.ndarray, at: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all sets, 255 at most, in one array, and their offsets."""
    sizes = np.diff(at)
    groups = groups_for(sizes) if groups is None else groups
    begin = np.concatenate([[0], np.cumsum(groups)]).astype(np.int64)
    place = np.repeat(begin[:-1], sizes) + ((elements >> U64(24)).astype(np.int64) & np.repeat(groups - 1, sizes))
    return np.minimum(np.bincount(place, minlength=begin[-1]), 255).astype(np.uint8), begin


def packed(counts: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.array([counts[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point (or rows of points) with fewer groups. 255 means no bound and stays so."""
    parts = counts.reshape(*counts.shape[:-1], -1, groups)
    return np.where((parts == 255).any(-2), 255, np.minimum(parts.sum(-2, dtype=np.int64), 255)).astype(np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima; without a bound where both have reached the largest count."""
    least = np.minimum(a, b)
    return np.where((least == 255).any(-1), np.iinfo(np.int64).max, least.sum(-1, dtype=np.int64))


def needed(a, b, num: int, den: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-num * (a + b) // (num + den))


class Tree:
    """An R-tree over count vectors, packed bottom-up from points sorted by size and largest coordinates."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray) -> None:
        groups = min(map(len, points))
        self.whole = np.array([p if len(p) == groups else folded(p, groups) for p in points])
        points = folded(self.whole, GROUPS)
        self.order = np.lexsort((points.argmax(1), sizes // np.maximum(1, sizes // 16 + 1)))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            most, low, high = self.levels[-1]
            edges = np.arange(0, len(most), LEAF)
            self.levels.append((np.maximum.reduceat(most, edges), np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)))
        self.points, self.sizes = points, sizes

    def all_near(self, num: int, den: int) -> Iterator[np.ndarray]:
        """near() of each point in turn. A tree of few leaves is bounded at once."""
        few = max(1, (1 << 22) // self.whole.size)
        if len(self.sizes) > FEW:
            yield from (self.near(i, num, den) for i in range(len(self.sizes)))
            return
        for at in range(0, len(self.sizes), few):
            size = self.sizes[at : at + few, None]
            least = needed(size, self.sizes[None], num, den)
            good = (np.minimum(size, self.sizes) * den >= np.maximum(size, self.sizes) * num) & (overlap_bound(self.points[at : at + few, None], self.points[None]) >= least)
            i, k = np.nonzero(good)
            good[i, k] = overlap_bound(self.whole[at + i], self.whole[k]) >= least[i, k]
            yield from (np.flatnonzero(row) for row in good)

    def near(self, i: int, num: int, den: int) -> np.ndarray:
        """The points that may link with the ``i``-th."""
        point, size = self.points[i], int(self.sizes[i])
        at = np.arange(len(self.levels[-1][0]))
        for k, (most, low, high) in enumerate(reversed(self.levels)):
            if k:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(most)]
            at = at[(high[at] * den >= size * num) & (low[at] * num <= size * den)]
            bound = overlap_bound(most[at], point)
            at = at[bound >= needed(size, np.maximum(low[at], -(-size * num // den)), num, den)]
        found = self.order[at]
        return found[overlap_bound(self.whole[found], self.whole[i]) >= needed(size, self.sizes[found], num, den)]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both) and both > 0


def profiles(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, class, check, point and hash (of the text) of every document."""
    id_type = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole, "text"):
                elements, at = sets_of(batch.column(1), n)
                hashes = [pa.array(x.view(np.int64)) for x in set_hashes(elements, at, seed)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), *hashes, packed(*points_of(elements, at)), batch.column(2)], names=["doc_id", "n_shingles", "class", "check", "point", "hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, class bigint, check bigint, point binary, hash bigint")


def bucket_rows(docs: DataFrame, n: int, num: int, den: int, seed: int) -> DataFrame:
    """bucket, class, least: every class of each bucket that has several. One exchange of narrow rows, read as a stream."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for whole in batches:
            for batch in row_blocks(whole, "text"):
                elements, at = sets_of(batch.column(0), n)
                classes = set_hashes(elements, at, seed)[0].view(np.int64)
                _, first = np.unique(classes, return_index=True)
                rows = np.sort(first[np.diff(at)[first] > 0])
                # copies that this task has seen are not sent again
                rows = rows[[c not in sent for c in classes[rows].tolist()]] if sent else rows
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.update(classes[rows].tolist())
                owner, key = keys_of(elements, at, rows, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(classes[owner])], names=["bucket", "class"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, previous, told = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[bucket[0] != last], bucket[1:] != bucket[:-1]])
            head = np.where(new, name, 0)
            head[0] = head[0] if new[0] else least
            head = head[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            again = np.concatenate([[not new[0] and name[0] == previous], (name[1:] == name[:-1]) & ~new[1:]])
            other = ~again & (name != head)
            out = [(bucket[other], name[other], head[other])]
            # the least class itself goes on with the first other one
            starts = np.flatnonzero(other)
            key = bucket[starts]
            lead = starts[np.concatenate([[True], key[1:] != key[:-1]])] if len(starts) else starts
            if told and len(lead) and bucket[lead[0]] == last:
                lead = lead[1:]
            out.append((bucket[lead], head[lead], head[lead]))
            told = bool(len(starts) and bucket[starts[-1]] == bucket[-1]) or (told and bucket[-1] == last)
            last, least, previous = bucket[-1], head[-1], name[-1]
            columns = [pa.array(np.concatenate([x[k] for x in out])) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "class", "least"])

    sent = docs.select("text").mapInArrow(send, "bucket bigint, class bigint")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "class").mapInArrow(gather, "bucket bigint, class bigint, least bigint")


def _near_points(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose points allow a link."""
    one = classes.select(F.col("class").alias("a"), F.col("n0").alias("na"), F.col("point").alias("pa"))
    two = classes.select(F.col("class").alias("b"), F.col("n0").alias("nb"), F.col("point").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = needed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), num, den)
            good = np.zeros(batch.num_rows, bool)
            for i, two in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                few, more = sorted((np.frombuffer(p, np.uint8) for p in two), key=len)
                good[i] = overlap_bound(few, more if len(more) == len(few) else folded(more, len(few))) >= least[i]
            yield batch.select([0, 1]).filter(pa.array(good))

    both = pairs.join(one.hint("merge"), "a").filter(F.col("na").isNotNull()).join(two.hint("merge"), "b")
    return both.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """pairs (a, b) of classes: those that link. Few b's may stand in very many pairs: they are sent to a task for each STAR pairs."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("shares"))
    members = pairs.join(shares.hint("merge"), "b").select("b", F.pmod(F.xxhash64("a"), F.col("shares")).alias("share"), "a")
    members = members.join(texts.select(F.col("class").alias("a"), "text").hint("merge"), "a").select("b", "share", "a", "text")
    heads = shares.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")).join(texts.select(F.col("class").alias("b"), "text").hint("merge"), "b")
    rows = heads.select("b", "share", F.lit(None).cast("long").alias("a"), "text").unionAll(members)
    rows = rows.repartition("b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for whole in batches:
            for batch in row_blocks(whole, "text"):
                out = []
                elements, at = sets_of(batch.column(3), n)
                for k, (b, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found = elements[at[k] : at[k + 1]]
                    if a is None:
                        head, own = b, found
                    elif head == b and linked(own, found, num, den):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _blocks(buckets: DataFrame) -> DataFrame:
    """Each row once for each search: searches are pairs (x, y) of blocks of a bucket."""
    sizes = buckets.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = buckets.join(sizes.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    return rows.select("bucket", "class", "component", "own", F.explode(pairs).alias("p")).select("bucket", "p.x", "p.y", "class", "component", "own")


def _open_rows(buckets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """buckets (bucket, class, component): the rows with a near point of another component, by R-tree; no pairs are made."""
    rows = _blocks(buckets).join(classes.select("class", F.col("n0").alias("n"), "point").hint("merge"), "class")
    rows = rows.select("bucket", "x", "y", "class", "component", "n", "point").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            component, size = table.column(4).to_numpy(), table.column(5).to_numpy()
            tree, good = Tree([np.frombuffer(p, np.uint8) for p in table.column(6).to_pylist()], size), np.zeros(len(size), bool)
            for i, near in enumerate(tree.all_near(num, den)):
                other = near[component[near] != component[i]]
                good[other] = True
                good[i] |= bool(len(other))
            return table.select([0, 3, 4]).filter(pa.array(good))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(keys[a]) != last:
                    yield done()
                    held = []
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return rows.mapInArrow(run, "bucket bigint, class bigint, component bigint").distinct()


def _searched(buckets: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """buckets (bucket, class, component): links between different components of a bucket that the R-tree and the sets show."""
    rows = _blocks(buckets)
    rows = rows.join(texts.hint("merge"), "class").select("bucket", "x", "y", "class", "component", "own", "text")
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def search(held: list[tuple], one_block: bool) -> list[tuple[int, int]]:
        label = {x[1]: x[1] for x in held}

        def root(c: int) -> int:
            while label[c] != c:
                label[c] = label[label[c]]
                c = label[c]
            return c

        sets, comps = [x[3] for x in held], [x[1] for x in held]
        lengths = np.array([len(x) for x in sets])
        counts, begin = points_of(np.concatenate(sets), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        tree, out = Tree([counts[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)], lengths), []
        for i, (own, near) in enumerate(zip(sets, tree.all_near(num, den), strict=True)):
            for k in near:
                if k > i and (one_block or held[i][2] != held[k][2]) and root(comps[i]) != root(comps[k]) and linked(own, sets[k], num, den):
                    label[root(comps[i])] = root(comps[k])
                    out.append((held[i][0], held[k][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def done() -> pa.RecordBatch:
            out = search(held, last[1] == last[2])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for whole in batches:
            for batch in row_blocks(whole, "text"):
                elements, at = sets_of(batch.column(6), n)
                for k, (bucket, x, y, name, component, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                    found = elements[at[k] : at[k + 1]]
                    if held and (bucket, x, y) != last:
                        yield done()
                        held = []
                    last = (bucket, x, y)
                    held.append((name, component, own, found))
        if held:
            yield done()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and one text of each wanted class: that of the class's least doc_id, told from other rows of that doc_id by its hash."""
    ids = wanted.join(classes.select("class", F.col("one.doc_id").alias("id"), F.col("one.hash").alias("hash")).hint("merge"), "class")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    found = rows.join(ids.hint("merge"), (F.col("own") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return materialised(found.select("class", "text"))


def _several(buckets: DataFrame, least: int) -> DataFrame:
    """The rows of buckets of ``least`` or more classes in several components; buckets of the same classes are kept once."""
    found = buckets.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"))
    found = found.filter((F.col("c0") != F.col("c1")) & (F.col("size") >= least)).groupBy("size", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
    return buckets.join(found.hint("merge"), "bucket")


def join_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, the document's own included).

    Two columns follow for callers that must tell rows of one doc_id apart: component, a number of the component itself (null
    without shingles), and text_hash, xxhash64 of the text.
    """
    for seed in range(100):
        members = materialised(profiles(docs, n, seed))
        classes = members.filter("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("one"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n_shingles").alias("n0"), F.max("n_shingles").alias("n1"), F.max("point").alias("point"))
        classes = materialised(classes)
        # different sets with one 64-bit hash: begin again with another one
        if classes.filter("c0 <> c1 or n0 <> n1").isEmpty():
            break
        dropped(members, classes)
    buckets = materialised(bucket_rows(docs, n, num, den, seed))

    def compared(pairs: DataFrame) -> DataFrame:
        near = materialised(_near_points(pairs, classes, num, den))
        texts = _texts(docs, classes, near.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        found = materialised(_verified(near, texts, n, num, den))
        dropped(near, texts)
        return found

    pairs = materialised(buckets.filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct())
    links = compared(pairs.groupBy("a").agg(F.min("b").alias("b")))
    labels = materialised(components(links))
    for side in ("a", "b"):
        label = labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(label.hint("merge"), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    links = materialised(links.unionAll(compared(pairs.filter("of_a <> of_b").select("a", "b"))))
    labels = materialised(components(links))
    left = buckets.join(labels.select(F.col("node").alias("class"), "component").hint("merge"), "class", "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    # a bucket of two was compared
    rows = materialised(_open_rows(_several(left, 3), classes, num, den))
    if not rows.isEmpty():
        rows = _several(rows, 2)
        texts = _texts(docs, classes, rows.select("class").distinct())
        more = materialised(_searched(rows, texts, n, num, den))
        dropped(texts)
        labels = materialised(components(links.unionAll(more)))
    named = members.select("doc_id", "n_shingles", "class", "hash").join(labels.select(F.col("node").alias("class"), "component").hint("merge"), "class", "left")
    named = materialised(named.select("doc_id", "n_shingles", F.col("hash").alias("text_hash"), F.when(F.col("n_shingles") > 0, F.coalesce("component", "class")).alias("component")))
    dropped(buckets, classes, members)
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least.hint("merge"), "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component", "text_hash")
