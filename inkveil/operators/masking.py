"""Ordered masking with numbered placeholders, without Python.

Each rule is one stage on the text that the stages before it left: find all matches, give each distinct value
of a category the next number, and put the text together again from the pieces between the matches. Numbers
are first local to the document; ``number_sets`` makes them run through a review set by first appearance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.detectors import DETECTORS, IDENTIFYING, PLACEHOLDER, SECRET, Detector, has_legal_entity, has_marker, public_term
from inkveil.functions.text import estimate_tokens, folded, has_any
from inkveil.operators.ranking import ranked
from inkveil.sources.scratch import materialised

OUTBOUND_CHARS, PREVIEW_CHARS, MANY = 16000, 1200, 25
RISKS = ("low", "medium", "high")
SEEN = "array<struct<category:string,value:string,token:string,rule_ord:int>>"
FINDINGS = {
    "secret": "Credentials-like values were detected and masked.",
    "marker": "Explicit confidentiality markers were detected locally. External transfer should use only the sanitized text.",
    "identifier": "Customer, project, ticket, or contact identifiers were detected and masked where possible.",
    "legal": "Corporate-name markers were detected. Please confirm that no identifying context remains.",
    "many": "A large number of sensitive values were detected. Consider splitting the review into smaller sanitized batches.",
    "truncated": f"Outbound text was truncated to {OUTBOUND_CHARS} characters to stay within a conservative review budget.",
}


def token(category: Column, number: Column) -> Column:
    return F.concat(F.lit("["), F.upper(category), F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), F.lit("]"))


def _stage(docs: DataFrame, rule_ord: int, d: Detector) -> DataFrame:
    none = F.array().cast("array<string>")
    out = docs.withColumn("_m", F.when(d.found_in(F.col("masked")), F.regexp_extract_all("masked", F.lit(d.pattern), F.lit(0))).otherwise(none))
    out = out.withColumn("_v", F.when(F.size("_m") > 0, F.regexp_extract_all("masked", F.lit(d.pattern), F.lit(d.value))).otherwise(none))

    def free(v: Column) -> Column:
        """A value that is a placeholder already, or a public term under a guarded rule, stays."""
        if not d.value:
            return F.lit(True)
        open_ = ~F.btrim(v).rlike(f"^{PLACEHOLDER}$")
        return open_ & ~public_term(v) if d.guarded else open_

    def of_category(s: Column) -> Column:
        return s["category"] == d.category

    own = F.filter("seen", of_category)
    fresh = F.array_except(F.array_distinct(F.filter("_v", free)), F.transform(own, lambda s: s["value"]))
    added = F.transform(fresh, lambda v, k: F.struct(F.lit(d.category).alias("category"), v.alias("value"), token(F.lit(d.category), F.size(own) + k + 1).alias("token"), F.lit(rule_ord).alias("rule_ord")))
    out = out.withColumn("seen", F.when(F.size("_v") > 0, F.concat("seen", added)).otherwise(F.col("seen")))
    named = F.map_from_entries(F.transform(F.filter("seen", of_category), lambda s: F.struct(s["value"], s["token"])))
    out = out.withColumn("_map", F.when(F.size("_v") > 0, named))
    changed = F.zip_with("_m", "_v", lambda m, v: F.when(free(v), F.replace(m, v, F.element_at("_map", v))).otherwise(m))
    pieces = F.zip_with(F.split("masked", d.pattern, -1), changed, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return out.withColumn("masked", F.when(F.size("_v") > 0, F.array_join(pieces, "")).otherwise(F.col("masked")))


def masked_text(docs: DataFrame, detectors: Sequence[Detector] = DETECTORS, text: str = "text") -> DataFrame:
    """Adds ``masked`` and ``seen``: the document's distinct values in order of appearance, with local tokens."""
    out = docs.withColumn("masked", F.coalesce(F.col(text), F.lit(""))).withColumn("seen", F.array().cast(SEEN))
    for i, d in enumerate(detectors):
        out = _stage(out, i, d)
    return out.drop("_m", "_v", "_map")


def number_sets(masked: DataFrame, keys: Sequence[str] = ("review_id", "doc_ord")) -> tuple[DataFrame, DataFrame]:
    """(documents with set-wide tokens, ledger of review_id, placeholder, original, category, n).

    A value's number is its place by first appearance: documents in order, then rules, then positions. Numbers go by ranges
    of distinct values, so a set of any size is numbered in many tasks. A value that holds an earlier token is told apart
    by what the token stands for.
    """
    out, ledger = continue_sets(masked, None, keys)
    return out, ledger.drop("name")


def continue_sets(masked: DataFrame, known: DataFrame | None, keys: Sequence[str] = ("review_id", "doc_ord")) -> tuple[DataFrame, DataFrame]:
    """W1 going on from an earlier ledger of the same sets: (documents, rows that the ledger gains, with name, by which values are told apart).

    known: what this function returned before; its values keep their placeholders, new ones are numbered behind them.
    """
    review, order = keys
    spell = lambda v: F.aggregate("seen", v, lambda acc, s: F.replace(acc, s["token"], F.concat(F.lit("\u0001"), s["category"], F.lit("\u0002"), s["value"], F.lit("\u0003"))))
    named = F.transform(
        "seen",
        lambda s: F.struct(
            s["category"].alias("category"), s["token"].alias("token"), s["value"].alias("value"), s["rule_ord"].alias("rule_ord"),
            F.when(F.contains(s["value"], F.lit("[")), spell(s["value"])).otherwise(s["value"]).alias("name"),
        ),
    )
    values = masked.select(review, order, F.posexplode(named).alias("pos", "s")).select(review, order, "pos", "s.*")
    first = values.groupBy(review, "category", "name").agg(F.min(F.struct(order, "rule_ord", "pos", "value")).alias("first"))
    if known is not None:
        first = first.join(known.select(review, "category", "name").hint("merge"), [review, "category", "name"], "left_anti")
    numbered = ranked(first, [review, "category"], ["first"])
    if known is not None:
        last = known.groupBy(review, "category").agg(F.max("n").alias("_last"))
        numbered = numbered.join(last.hint("merge"), [review, "category"], "left").withColumn("n", F.col("n") + F.coalesce("_last", F.lit(0))).drop("_last")
    numbered = numbered.withColumn("placeholder", token(F.col("category"), F.col("n")))
    names = numbered.select(review, "category", "name", "placeholder")
    if known is not None:
        names = names.unionByName(known.select(review, "category", "name", "placeholder"))
    local = values.join(names.hint("merge"), [review, "category", "name"]).groupBy(review, order).agg(F.map_from_entries(F.collect_list(F.struct("token", "placeholder"))).alias("_names"))
    out = masked.join(local.hint("merge"), [review, order], "left")
    global_ = F.transform("seen", lambda s: F.struct(s["category"].alias("category"), renamed(s["value"], F.col("_names")).alias("value"), F.coalesce(F.element_at("_names", s["token"]), s["token"]).alias("token"), s["rule_ord"].alias("rule_ord")))
    out = out.withColumn("masked", renamed(F.col("masked"), F.col("_names"))).withColumn("seen", global_)
    at_first = numbered.select(F.col(review), F.col(f"first.{order}").alias(order), "category", "name", "placeholder", "n", F.col("first.value").alias("value"))
    ledger = at_first.join(local.hint("merge"), [review, order], "left").select(review, "placeholder", renamed(F.col("value"), F.col("_names")).alias("original"), "category", "n", "name")
    return out.drop("_names"), ledger


def renamed(text: Column, names: Column) -> Column:
    """Every token of the text replaced by its name in one pass, so that no two renamings meet."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    pieces = F.zip_with(F.split(text, PLACEHOLDER, -1), found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(F.element_at(names, b), b, F.lit(""))))
    return F.when(names.isNotNull() & F.contains(text, F.lit("[")), F.array_join(pieces, "")).otherwise(text)


def risk_level(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score >= 2, "medium").otherwise("low")


def mask_documents(docs: DataFrame, detectors: Sequence[Detector] = DETECTORS, outbound: int = OUTBOUND_CHARS, preview: int = PREVIEW_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P0. docs: review_id, doc_ord, name, text. (documents, ledger, mentions).

    Documents get outbound_text, excerpts, replacements, findings, estimated_input_tokens and outbound_risk. The
    number of replacements counts all values, not the first hundred.
    """
    rows = masked_text(docs, detectors)
    # the twelve stages run once, whatever reads their result
    masked, ledger = number_sets(rows if docs.isStreaming else materialised(rows))
    text = F.coalesce(F.col("text"), F.lit(""))
    records = F.transform("seen", lambda s: F.struct(s["token"].alias("placeholder"), s["value"].alias("original"), s["category"].alias("category")))
    identifying = F.exists("seen", lambda s: s["category"].isin(*IDENTIFYING))
    # tests on the texts are columns of their own, so that each runs once whatever asks for it
    low = F.col("_low")
    secret = has_any(low, ("password", "secret", "community", "token", "key")) & text.rlike(SECRET)
    masked = masked.withColumn("_low", folded(text)).withColumns({"_secret": secret, "_marker": has_marker(text, low), "_legal": has_legal_entity(text)})
    tests = {"secret": (F.col("_secret"), 1), "marker": (F.col("_marker"), 3), "identifier": (identifying, 2), "legal": (F.col("_legal"), 2), "many": (F.size("seen") >= MANY, 2)}
    score = F.greatest(F.lit(0), *[F.when(test, weight).otherwise(0) for test, weight in tests.values()])
    cut = F.length("masked") > outbound
    findings = F.array(*[F.when(test, FINDINGS[k]) for k, (test, _) in tests.items()], F.when(cut, FINDINGS["truncated"]))
    documents = masked.select(
        "review_id", "doc_ord", "name", "text", F.substring("text", 1, preview).alias("original_excerpt"), F.substring("masked", 1, preview).alias("sanitized_excerpt"), F.substring("masked", 1, outbound).alias("outbound_text"),
        records.alias("replacements"), F.filter(findings, lambda x: x.isNotNull()).alias("findings"), estimate_tokens(F.substring("masked", 1, outbound)).alias("estimated_input_tokens"), risk_level(score).alias("outbound_risk"),
    )
    found = masked.select("review_id", "doc_ord", "name", F.explode("seen").alias("s")).select("review_id", "doc_ord", "name", F.col("s.category").alias("category"), F.col("s.value").alias("value"), F.col("s.token").alias("placeholder"))
    return documents, ledger, found


def continue_placeholders(ledger: DataFrame, values: DataFrame) -> DataFrame:
    """W2. values: review_id, category, value, first. New values are numbered after the ledger's; known ones keep theirs."""
    last = ledger.groupBy("review_id", "category").agg(F.max("n").alias("last"))
    new = values.groupBy("review_id", "category", "value").agg(F.min("first").alias("first")).join(ledger.select("review_id", "category", F.col("original").alias("value")).hint("merge"), ["review_id", "category", "value"], "left_anti")
    new = new.join(last.hint("merge"), ["review_id", "category"], "left")
    n = F.row_number().over(Window.partitionBy("review_id", "category").orderBy("first", "value")) + F.coalesce("last", F.lit(0))
    new = new.withColumn("n", n).select("review_id", token(F.col("category"), F.col("n")).alias("placeholder"), F.col("value").alias("original"), "category", "n")
    return ledger.unionByName(new)


def replacements_per_category(ledger: DataFrame) -> DataFrame:
    """Counts per set and category, with totals (nulls) by rollup."""
    return ledger.rollup("review_id", "category").agg(F.count(F.lit(1)).alias("n_values"))


def merge_ledgers(*ledgers: DataFrame) -> DataFrame:
    """One row per (placeholder, original, category) of a set; the first list counts."""
    rows = [x.withColumn("_k", F.lit(k)) for k, x in enumerate(ledgers)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("review_id", "placeholder", "original", "category").orderBy("_k"))
    return out.withColumn("_r", rank).filter("_r = 1").drop("_r", "_k")
