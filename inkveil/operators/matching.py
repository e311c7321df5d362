"""Many names in many texts: an automaton over Arrow batches.

The names of a dictionary form one automaton that reads each text once, whatever their number. Dictionaries are
dealt into shards by hash, so that a task never holds more than a bounded one; each shard is one pass over the texts, and
what the shards find is put together by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.sources.scratch import materialised

#: A shard holds about so many names, and so many characters, at most.
SHARD_NAMES, SHARD_CHARS = 200_000, 8_000_000
#: Facts of names are broadcast up to so many.
BROADCAST_NAMES = 50_000
HIT = "struct<start:int,end:int,name:string>"
Hits = list[tuple[int, int, str]]


def leftmost_longest(hits: Hits) -> Hits:
    """Of overlapping hits the one that begins first, of these the longest; none of those kept overlap."""
    out, at = [], 0
    for start, end, name in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= at:
            out.append((start, end, name))
            at = end
    return out


def first_of_each(hits: Hits) -> Hits:
    """For each name its first hit, overlaps or not."""
    first: dict[str, tuple[int, int, str]] = {}
    for h in hits:
        if h[2] not in first or h < first[h[2]]:
            first[h[2]] = h
    return sorted(first.values())


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name, name)
    out.make_automaton()
    return out


def _hits(machine: ahocorasick.Automaton, text: str) -> Hits:
    return [(end + 1 - len(name), end + 1, name) for end, name in machine.iter(text)] if len(machine) else []


def _number_of_shards(names: DataFrame) -> int:
    size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return max(1, -(-size["n"] // SHARD_NAMES), -(-size["chars"] // SHARD_CHARS))


def _shard(names: DataFrame, k: int, of: int) -> list[str]:
    return [r["text"] for r in names.filter(F.pmod(F.xxhash64("text"), F.lit(of)) == k).collect()]


def _found(docs: DataFrame, names: list[str], settle: Callable[[Hits], Hits]) -> DataFrame:
    """The columns of docs but text, _id and _hits, of the documents that hold a name."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("_id", T.LongType()), T.StructField("_hits", T.ArrayType(T._parse_datatype_string(HIT)))])
    shared = docs.sparkSession.sparkContext.broadcast(names)  # a shard
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = _automaton(shared.value) if machine is None else machine
            found = [settle(_hits(machine, text)) if text else [] for text in batch.column(batch.num_columns - 1).to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            some = [[{"start": s, "end": e, "name": n} for s, e, n in x] for x in found if x]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), pa.array(some, hit)], names=[f.name for f in schema.fields])

    return docs.select(*kept, F.xxhash64(*docs.columns).alias("_id"), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def _settled(rows: DataFrame, settle: Callable[[Hits], Hits]) -> DataFrame:
    """rows: _hits with all that the shards found in a document, as often as the document stands in the table."""
    schema = rows.schema
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column(batch.num_columns - 1).to_pylist():
                times = Counter((h["start"], h["end"], h["name"]) for h in hits)
                kept = settle([*times])
                copies = times[kept[0]] if kept else 0
                out.append([{"start": s, "end": e, "name": n} for s, e, n in kept] * copies)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, hit)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def _matches(docs: DataFrame, names: DataFrame, settle: Callable[[Hits], Hits]) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    known = names.withColumnsRenamed({c: f"phrase_{c}" for c in names.columns}).filter(F.length("phrase_text") > 0)
    texts = materialised(known.select(F.col("phrase_text").alias("text")).distinct())
    shards = _number_of_shards(texts)
    if shards == 1:
        found = _found(docs, _shard(texts, 0, 1), settle)
    else:
        # a shorter name may win where another shard's longer one is cut off by an earlier one, so shards send one for each place
        each = _longest_at_each_start if settle is leftmost_longest else settle
        found = materialised(_found(docs, _shard(texts, 0, shards), each))
        for k in range(1, shards):
            found = found.unionAll(materialised(_found(docs, _shard(texts, k, shards), each)))
        found = _settled(found.groupBy(*kept, "_id").agg(F.flatten(F.collect_list("_hits")).alias("_hits")), settle)
    rows = found.select(*kept, F.explode("_hits").alias("_h")).select(*kept, F.col("_h.name").alias("_name"), F.col("_h.start").alias("start"), F.col("_h.end").alias("end"))
    way = "broadcast" if texts.count() <= BROADCAST_NAMES else "merge"
    return rows.join(known.hint(way), F.col("_name") == F.col("phrase_text")).drop("_name")


def _longest_at_each_start(hits: Hits) -> Hits:
    ordered = sorted(hits, key=lambda h: (h[0], -h[1]))
    return [next(run) for _, run in groupby(ordered, key=lambda h: h[0])]


def longest_matches(docs: DataFrame, names: DataFrame) -> DataFrame:
    """J4 with D16. docs: any columns and text; names: text and any columns. One row per match and row of names with its text: the columns
    of docs but text, those of names as phrase_*, start (from 0, in characters) and end.

    Of overlapping names the one that begins first counts, of these the longest, and the search goes on behind it: a name within a longer
    one is not found, but is found where it stands alone. Every occurrence is returned.

    Defined results: null and empty texts hold no names; empty and null names are in no text; names of one text are found together; equal rows of docs
    are matched each; without names or documents there are no rows.
    """
    return _matches(docs, names, leftmost_longest)


def contained_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """J4. As longest_matches, but each phrase for itself: one row per document and phrase in it, at its first place, whatever else stands there."""
    return _matches(docs, phrases, first_of_each)


#: Lengths of the beginnings by which short texts are looked up in each other.
GRAMS = (0, 1, 2, 4, 8, 16)


def containing_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, left, right: pairs of the texts of two tables (keys, text), equal in the keys, of which one contains the other. Each pair once.

    For short texts, as names and headings are: all stretches of one side meet the beginnings of the other, by hash and as long as these are,
    so texts that have nothing in common never meet; what meets is compared. Empty texts are in all, nulls in none.
    """

    def told(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.col("text").cast("string").alias(name)).filter(F.col(name).isNotNull()).distinct()

    def begun(rows: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        size = F.greatest(*[F.when(n >= g, F.lit(g)) for g in GRAMS])
        return rows.withColumn("_g", F.xxhash64(size, F.substring(F.col(name), F.lit(1), size)))

    def stretches(rows: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        none = F.array().cast("array<bigint>")

        def of(g: int) -> Column:
            return F.array_distinct(F.transform(F.sequence(F.lit(1), n - g + 1), lambda i: F.xxhash64(F.lit(g), F.substring(F.col(name), i, F.lit(g)))))

        every = [F.when(n >= g, of(g)).otherwise(none) for g in GRAMS]
        return rows.withColumn("_g", F.explode(F.concat(*every)))

    a, b = told(left, "left"), told(right, "right")
    by = [*keys, "_g"]
    inner = stretches(a, "left").join(begun(b, "right").hint("merge"), by).filter(F.contains("left", F.col("right")))
    outer = begun(a, "left").join(stretches(b, "right").hint("merge"), by).filter(F.contains("right", F.col("left")))
    return inner.select(*keys, "left", "right").unionByName(outer.select(*keys, "left", "right")).distinct()


def quoted(text: Column) -> Column:
    """A text as a regular expression that matches it and nothing else."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
