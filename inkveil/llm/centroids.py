"""Centroid clustering with a progressive search in Walsh-Hadamard space.

Vectors of ``SIZE`` components become integers floor(64 * x). Vectors and centroids are transformed by the exact
integer Walsh-Hadamard transform, which keeps distances: the sum of squared differences of all coefficients is SIZE times the
squared distance. Coefficients are taken coarse to fine (in order of sign changes), and their squared differences added up
for each centroid. The centroid that is ahead after the first ones is finished at once; another one goes as soon as its sum so far
is strictly larger than the least finished one, and those that stay are finished over all coefficients, so ties are seen and go
to the smaller number. Nothing is approximated.

The centroids start as the vectors with the least sha256 of ``1:<vec_id>``. In each round the tasks assign vectors and send
on, for each centroid, a count and sums of components; the driver gets one row for each centroid. The integer vectors are
written once.

Numbers: components up to 2**20 are handled as 64-bit integers, up to ``MOST`` as Python's.

Defined results: rows whose vector is null, of another length, or holds null, non-finite numbers, or components beyond
``MOST`` (for which a distance may not fit a long) take no part; repeated rows are vectors of their own, so
rows that share a vec_id may both be centroids, the smaller vector first; a null vec_id counts as an empty text in the hash; with fewer vectors than centroids each vector
starts one; an empty centroid stays where it is; sums that don't fit a long are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.sources.scratch import materialised

SIZE = 64
CENTROIDS, ROUNDS = 16, 3
SCALE = 64
#: The largest component of an integer vector.
MOST = 2**27
#: Coefficients that are added up before centroids are looked at again.
STEPS = (1, 3, 4, 8, 16, 32)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and whole (array<bigint>) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda x: x.cast("double") * SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_x")).filter(F.size("_x") == SIZE)
    # comparisons with nan are true in Spark: it is larger than any number
    rows = rows.filter(F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -MOST) & (x < MOST + 1)))
    return rows.select("vec_id", F.transform("_x", lambda x: F.floor(x)).alias("whole"))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row, coefficients in order of sign changes. Exact for integers, of the same kind as ``x``."""
    out = x.copy()
    half = 1
    while half < SIZE:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), SIZE)
        half *= 2
    return out[:, _ORDER]


def _by_changes() -> np.ndarray:
    rows = np.array([[bin(i & j).count("1") % 2 for j in range(SIZE)] for i in range(SIZE)])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


_ORDER = _by_changes()


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the number of the nearest centroid and the squared distance; both arrays hold integers of one kind."""
    a, c = walsh_hadamard(x), walsh_hadamard(centroids)
    rows, n = np.arange(len(a)), len(c)
    row, of = np.repeat(rows, n), np.tile(np.arange(n), len(a))
    total = np.zeros(len(row), a.dtype)
    done, at = None, 0
    for step in STEPS:
        difference = a[row, at : at + step] - c[of, at : at + step]
        total = total + (difference * difference).sum(1)
        at += step
        if at < SIZE:
            # one row's candidates stand together, smaller numbers first
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            if done is None:
                ahead = of[_firsts(total, begin)]
                rest = a[:, at:] - c[ahead, at:]
                done = total[_firsts(total, begin)] + (rest * rest).sum(1)
            stay = total <= done[row]
            row, of, total = row[stay], of[stay], total[stay]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    first = _firsts(total, begin)
    return of[first], total[first] // SIZE


def _firsts(total: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The place of the first least value of each run."""
    least = np.minimum.reduceat(total, begin)
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(total))))
    at = np.flatnonzero(total == least[run])
    return at[np.unique(run[at], return_index=True)[1]]


def _arrays(column: pa.Array, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    x, c = column.flatten().to_numpy().reshape(len(column), SIZE), np.array(centroids, np.int64).reshape(-1, SIZE)
    small = max(np.abs(x).max(), np.abs(c).max()) <= 2**20
    return (x, c) if small else (x.astype(object), c.astype(object))


def _sums(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster, count, and sums of components of what each task assigns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = _arrays(batch.column(0), centroids)
                of = nearest(x, c)[0]
                found = np.unique(of)
                sums = [x[of == k].sum(0).astype(np.int64).tolist() for k in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([int((of == k).sum()) for k in found], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return rows.select("whole").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")


def _moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(SIZE)]
    out = [*centroids]
    for r in _sums(rows, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # a row for each centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(SIZE)]
    return out


def _assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, distance = nearest(*_arrays(batch.column(1), centroids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32()), pa.array(distance.astype(np.int64), pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "whole").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")



def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vectors: vec_id, embedding. vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = materialised(whole_vectors(vectors))
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    now = [list(r["whole"]) for r in rows.orderBy(order, "vec_id", "whole").limit(centroids).select("whole").collect()]
    for _ in range(rounds if now else 0):
        now = _moved(rows, now)
    found = materialised(_assigned(rows, now))
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    whole = sum(int(r["d"]) for r in each)
    most = 2**63
    table = [(r["cluster"], int(r["d"]) if r["d"] < most else None, whole if whole < most else None, ",".join(map(str, now[r["cluster"]]))) for r in each]
    facts = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, _centroid string").withColumn("centroid_sha256", F.sha2(F.col("_centroid").cast("binary"), 256)).drop("_centroid")
    return found.join(facts.hint("broadcast"), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, by all distances."""
    near = "select {out} from (select v.row, d.k, sum((v.x - d.x) * (v.x - d.x)) as distance from parts v join c{r} d using (i) group by all) qualify row_number() over (partition by row order by distance, k) = 1"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({near.format(out='row, k', r=r)})")
        steps.append(f"s{r} as (select k, i, sum(x)::hugeint s, count(*)::hugeint n from a{r} join parts using (row) group by all)")
        steps.append(f"c{r + 1} as materialized (select c.k, c.i, case when n is null then c.x else (s - ((s % n) + n) % n) // n end as x from c{r} c left join s{r} using (k, i))")
    return f"""
with kept as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), vec_id, embedding) as row, vec_id, embedding from embeddings
  where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (select row, unnest(generate_series(1, {SIZE})) as i, floor({SCALE} * unnest(embedding)::double)::hugeint as x from kept),
c0 as materialized (select row - 1 as k, i, x from parts where row <= {centroids}),
{", ".join(steps)},
last as materialized ({near.format(out="row, k, distance", r=rounds)}),
texts as (select k, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by k)
select vec_id, k::int as cluster, distance::bigint as distance, (sum(distance) over (partition by k))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
from last join kept using (row) join texts using (k)"""


ORACLE = _sql()
