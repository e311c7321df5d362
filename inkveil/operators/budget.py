"""Token budgets of review sets, batches, and order and duplicates of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.ranking import ranked
from inkveil.sources.scratch import materialised

CALLS, TOKENS = 6, 25_000
#: Documents, or maps, that are looked at together; more than a batch has documents.
BLOCK = 256


def budget_status(calls: Column, max_call: Column, total: Column, external: Column) -> Column:
    """F18."""
    split = (max_call > 12_000) | (total > 50_000) | (calls >= 8)
    caution = (max_call > 8_000) | (total > 25_000) | (calls >= 4)
    return F.when(~external, "mock").when(split, "split_recommended").when(caution, "caution").otherwise("safe")


def token_budget(docs: DataFrame, overhead: int = 0, chunked: bool = True, output_cap: int = 8192, interval: float = 0.0, external: bool = True) -> DataFrame:
    """A11. docs: review_id, estimated_input_tokens. One call per document if chunked, else one per set."""
    sets = docs.groupBy("review_id").agg(F.sum("estimated_input_tokens").alias("body_tokens"), F.max("estimated_input_tokens").alias("_max"), F.count(F.lit(1)).alias("_n"))
    calls = F.when(F.lit(chunked) & (F.col("_n") > 1), F.col("_n")).otherwise(F.lit(1))
    sets = sets.withColumn("call_count", calls.cast("long")).withColumn("total_input_tokens", F.col("body_tokens") + F.col("call_count") * overhead)
    sets = sets.withColumn("max_call_input_tokens", F.when(F.col("call_count") > 1, F.col("_max") + overhead).otherwise(F.col("total_input_tokens")))
    return sets.select(
        "review_id", "call_count", "body_tokens", "total_input_tokens", "max_call_input_tokens", (F.col("call_count") * output_cap).alias("estimated_output_token_cap"), F.ceil((F.col("call_count") - 1) * F.lit(interval)).alias("minimum_wait_seconds"),
        budget_status(F.col("call_count"), F.col("max_call_input_tokens"), F.col("total_input_tokens"), F.lit(external)).alias("status"),
    )


def _through(first: Column, maps: Column) -> Column:
    """Where one goes through a list of maps, and how many batches begin on the way. first: struct(at, begun); a map: for each entry struct(at, begun)."""
    return F.aggregate(maps, first, lambda s, m: F.struct(m["map"][s["at"]]["at"].alias("at"), (s["begun"] + m["map"][s["at"]]["begun"]).alias("begun")))


def _batches_of_block(entry: Column, before: Column, calls: int, tokens: int) -> Column:
    """The greedy rule over ``own`` (o, t), a block's documents and those behind it that a batch may reach, from the place ``entry`` on.

    struct(n, t, at, begun, out): at is the place in the next block at which a batch begins, -1 if none does, as the set ends; out has (o, batch) of the documents of batches that begin in the block.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.lit(-1).alias("at"), before.cast("long").alias("begun"), F.array().cast("array<struct<o:int,batch:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        skip = (x["o"] < entry) | (s["at"] >= 0)
        begins = (s["n"] == 0) | (s["n"] >= calls) | (s["t"] + x["t"] > tokens)
        beyond = x["o"] >= BLOCK
        own = ~skip & ~(begins & beyond)
        begun = F.when(own & begins, s["begun"] + 1).otherwise(s["begun"])
        return F.struct(
            F.when(~own, s["n"]).when(begins, 1).otherwise(s["n"] + 1).alias("n"), F.when(~own, s["t"]).when(begins, x["t"]).otherwise(s["t"] + x["t"]).alias("t"),
            F.when(~skip & begins & beyond, x["o"] - BLOCK).otherwise(s["at"]).alias("at"), begun.alias("begun"),
            F.when(own, F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), begun.alias("batch"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate("own", start, step)


def pack_batches(docs: DataFrame, calls: int = CALLS, tokens: int = TOKENS) -> DataFrame:
    """W12. docs: review_id, doc_ord, name, call_input_tokens. Greedy batches in order: review_id, batch, document_names, call_count, total_input_tokens.

    Where a batch ends hangs on all before it, but it reaches no further than ``calls`` documents: a block of documents is a map from the ``calls`` + 1 places (the last: nowhere) at
    which its first batch may begin to those of the next block. Maps of blocks are put together ``BLOCK`` at a time, level
    by level, until a set is one map; then the places at which batches do begin are handed down. So a set of any size is packed in
    many tasks, exactly as one document after the other would be. A set of a single batch has none; rows without a set are in none.
    """
    keys = ["review_id", "_b"]
    rows = docs.filter(F.col("review_id").isNotNull()).select("review_id", "doc_ord", "name", F.coalesce(F.col("call_input_tokens").cast("long"), F.lit(0)).alias("t"))
    placed = materialised(ranked(rows, ["review_id"], ["doc_ord", "name"], "_i").withColumn("_i", F.col("_i") - 1))
    block, o = F.floor(F.col("_i") / BLOCK), (F.col("_i") % BLOCK).cast("int")
    reach = F.array(F.struct(block.alias("b"), o.alias("o")), F.struct(F.when(o < calls, block - 1).alias("b"), (o + BLOCK).alias("o")))
    parts = placed.select("review_id", "t", F.explode(reach).alias("p")).filter("p.b >= 0").groupBy("review_id", F.col("p.b").alias("_b"))
    blocks = materialised(parts.agg(F.array_sort(F.collect_list(F.struct(F.col("p.o").alias("o"), "t"))).alias("own")))
    entry = F.transform(F.sequence(F.lit(0), F.lit(calls)), lambda e: _batches_of_block(e, F.lit(0), calls, tokens))
    maps = blocks.select(*keys, F.transform(entry, lambda s: F.struct(F.when(s["at"] < 0, calls).otherwise(s["at"]).alias("at"), s["begun"].alias("begun"))).alias("map"))
    levels: list[DataFrame] = []
    while True:
        up = maps.groupBy("review_id", F.floor(F.col("_b") / BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), "map"))).alias("maps"))
        level = materialised(up)
        levels.append(level)
        whole = F.transform(F.sequence(F.lit(0), F.lit(calls)), lambda e: _through(F.struct(e.alias("at"), F.lit(0).cast("long").alias("begun")), F.col("maps")))
        maps = level.select(*keys, whole.alias("map"))
        if (level.agg(F.max("_b")).first()[0] or 0) == 0:
            break
    # from the top: where the first batch of each block begins, and how many began before
    several = maps.filter(F.col("map")[0]["begun"] > 1).select("review_id", "_b", F.lit(0).alias("at"), F.lit(0).cast("long").alias("begun"))
    for level in reversed(levels):
        first = F.array(F.struct(F.lit(-1).cast("long").alias("b"), F.col("at"), F.col("begun")))
        walk = F.aggregate(
            "maps", F.struct(F.col("at"), F.col("begun"), F.slice(first, 1, 0).alias("out")),
            lambda s, m: F.struct(m["map"][s["at"]]["at"].alias("at"), (s["begun"] + m["map"][s["at"]]["begun"]).alias("begun"), F.concat(s["out"], F.array(F.struct(m["b"].alias("b"), s["at"].alias("at"), s["begun"].alias("begun")))).alias("out")),
        )
        several = level.join(several.hint("merge"), keys).select("review_id", F.explode(walk["out"]).alias("e")).select("review_id", F.col("e.b").alias("_b"), "e.at", "e.begun")
    told = blocks.join(several.hint("merge"), keys).select(*keys, F.explode(_batches_of_block(F.col("at"), F.col("begun"), calls, tokens)["out"]).alias("d"))
    told = told.select("review_id", (F.col("_b") * BLOCK + F.col("d.o")).alias("_i"), F.col("d.batch").cast("int").alias("batch"))
    own = placed.join(told.hint("merge"), ["review_id", "_i"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("_i", "name"))), lambda x: x["name"])
    return own.groupBy("review_id", "batch").agg(names.alias("document_names"), F.count(F.lit(1)).alias("call_count"), F.sum("t").alias("total_input_tokens"))


def natural_key(name: Column) -> Column:
    """A sort key in which 2 comes before 10."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def duplicate_documents(docs: DataFrame, content: str = "content", order: str = "doc_ord") -> DataFrame:
    """Later copies (equal SHA-256) and the first document they are copies of.

    The first copy comes from an aggregate with map-side sums, so a content with very many copies is not one sort.
    """
    hashed = docs.select("name", order, F.sha2(F.col(content).cast("binary"), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min_by("name", order).alias("first_name"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(first.select("hash", "first_name", "first").hint("merge"), "hash").filter(F.col(order) > F.col("first")).select("name", order, "first_name", "hash")
