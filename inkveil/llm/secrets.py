r"""Secret scans with DataFrame functions alone.

Base findings, leftmost and non-overlapping per kind:

* ``assign`` - keyword, separator and value, kept if the value has 6 or more characters;
* ``access`` - ``AKIA`` and capitals or digits, kept from 20 characters;
* ``hex`` - runs of ``[0-9a-f]``, kept from 24 characters.

``entropy`` findings are added: candidate strings are maximal runs of 24 or more characters of the
base64 alphabets that hold at least two of lower case, upper case and digits. A window of 24 characters
slides over each candidate; the counts of its characters are kept incrementally (one in, one out) and
with them the sum of c * log2(c), which gives the Shannon entropy of every window. The highest must
reach the threshold of the candidate's character class (hexadecimal or base64). Candidates of the allow
list (UUIDs, paths and identifiers of words, placeholders, runs of one sequence) or those that a base
finding covers in part are suppressed; base findings always stay.

Positions are code points. Spark's expressions count code points in ``length``, so the offset of a match
is the length of all pieces before it. Null texts count as empty and give no findings; repeated rows
give repeated results; other columns of the input are ignored. Rows are independent, so nothing is
shuffled and one long text only costs its own task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Any match of these is one of the base patterns that is long enough, and the other way round: a shorter
# run of the same characters holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
#: Quick tests that a text must pass before a pattern is run for positions.
ASSIGN_GATE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 24
#: Bits per character that a window must reach; a window of 24 characters can have at most log2(24) = 4.58, of 16 symbols 4.
HEX_BITS, BASE64_BITS = 3.2, 3.9
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What is well known not to be a secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:example|placeholder|changeme|dummy|sample|xxxx|0000)",
    r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+[/_=+-]*$",
    r"^[A-Za-z]+[0-9]{0,4}$",
    r"(?i:abcdefghijkl|0123456789|qwertyuiop)",
)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, rank, text>> of all matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    pairs = F.zip_with(gaps, matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,rank:int,match:string>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def add(state: Column, x: Column) -> Column:
        begins = state["at"] + x["gap"]
        ends = begins + F.length(x["match"])
        one = F.struct(begins.alias("start"), ends.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), x["match"].alias("match"))
        return F.struct(F.coalesce(ends, begins).alias("at"), F.when(x["match"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out"))

    return F.aggregate(pairs, start, add, lambda state: state["out"])


def highest_entropy(value: Column, window: int = WINDOW, alphabet: str = ALPHABET) -> Column:
    """The largest Shannon entropy in bits of any window of ``value``; shorter values make one window."""
    size = F.least(F.length(value), F.lit(window))
    #: c * log2(c) for c from 0
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 1)])
    zeros = F.array_repeat(F.lit(0), len(alphabet) + 1)
    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(alphabet)))
    start = F.struct(zeros.alias("counts"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"), F.lit(0).alias("i"))

    def step(state: Column, code: Column, all_codes: Column) -> Column:
        i = state["i"] + 1
        old = F.when(i > window, F.element_at(all_codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        same = old == code
        n_in = F.element_at(state["counts"], code + 1)
        n_out = F.when(old >= 0, F.element_at(state["counts"], F.greatest(old, F.lit(0)) + 1)).otherwise(F.lit(0))
        gain = F.element_at(table, F.least(n_in + 2, F.lit(window + 1))) - F.element_at(table, n_in + 1)
        loss = F.when(n_out > 0, F.element_at(table, n_out + 1) - F.element_at(table, F.greatest(n_out, F.lit(1)))).otherwise(F.lit(0.0))
        s = F.when(same, state["s"]).otherwise(state["s"] + gain - loss)
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda v, k: v + F.when(k == code, 1).otherwise(0) - F.when(k == old, 1).otherwise(0)))
        least = F.when(i >= size, F.least(state["least"], s)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), s.alias("s"), least.alias("least"), i.alias("i"))

    total = F.aggregate(codes, start, lambda state, code: step(state, code, codes), lambda state: state["least"])
    return F.when(size > 0, F.log2(size.cast("double")) - total / size)


def _suspicious(match: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    classes = match.rlike("[a-z]").cast("int") + match.rlike("[A-Z]").cast("int") + match.rlike("[0-9]").cast("int")
    bits = F.when(match.rlike("^[0-9a-fA-F-]+$"), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    return F.when((classes >= 2) & ~allowed, highest_entropy(match) >= bits).otherwise(F.lit(False))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``findings``: array<struct<start, end, rank, match>> sorted by start, then kind."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,rank:int,match:string>>)")
    body = F.coalesce(F.col(text), F.lit(""))
    value = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(_found(body, ASSIGN, "assign"), value, lambda x, v: F.when(F.length(v) >= 6, x))
    assign = F.filter(assign, lambda x: x.isNotNull())

    def gated(pattern: str, gate: str, found: Column) -> Column:
        return F.when(body.rlike(gate), found).otherwise(none)

    base = docs.withColumn("_base", F.concat(
        gated(ASSIGN, ASSIGN_GATE, assign),
        F.when(F.contains(body, F.lit("AKIA")), _found(body, ACCESS, "access")).otherwise(none),
        gated(HEX, HEX, _found(body, HEX, "hex")),
    ))
    more = gated(CANDIDATE, CANDIDATE, F.filter(_found(body, CANDIDATE, "entropy"), lambda x: _suspicious(x["match"])))
    return (
        base.withColumn("_more", more)
        .withColumn("_more", F.filter("_more", lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
        .withColumn("findings", F.array_sort(F.concat("_base", "_more")))
        .drop("_base", "_more")
    )


def spans(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every finding of ``text`` by ``mark``; overlapping findings make one.

    All columns stay, whatever their names; ``n_chars``, if there, follows a text that changed.
    Documents without findings stay as they are, null texts included.
    """
    found = scan(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def cut(state: Column, x: Column) -> Column:
        kept = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        piece = F.when(x["start"] >= state["at"], F.concat(state["out"], kept, F.lit(mark)))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.coalesce(piece, state["out"]).alias("out"))

    new = F.aggregate("findings", start, cut, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))
    hit = F.size("findings") > 0
    done = found.select("row", hit.alias("hit"), F.when(hit, new).otherwise(text).alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("hit"), F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
