"""What callers bring: rules as rows, functions that answer for a text, and expressions that judge a document.

None of it can stop a job: a rule that is no pattern is reported before anything runs, a function that fails on a text fails for
that text alone, and a judgement that gives nothing leaves the library's own.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detectors import DETECTORS, Detector

#: Rules of a table at most: each is a stage of the plan.
MOST_RULES = 200
Answer = Callable[[Sequence[str]], Sequence[str | None]]


def detectors_of(rules: DataFrame, behind: tuple[Detector, ...] = DETECTORS) -> tuple[tuple[Detector, ...], list[tuple[str, str]]]:
    """(detectors, rules that are left out and why). rules: rule_ord, rule, category, pattern, value_group, guarded.

    The rules run behind those of ``behind``, by rule_ord, then by name. Left out are rules without a category of letters, digits and low lines, whose pattern is
    no regular expression, matches an empty text, or has no group of the number that is to be the value. The first of two rules of one name counts.
    """
    rows = rules.select("rule_ord", F.trim("rule").alias("rule"), F.lower(F.trim("category")).alias("category"), "pattern", F.coalesce(F.col("value_group").cast("int"), F.lit(0)).alias("value"), F.coalesce("guarded", F.lit(False)).alias("guarded"))
    found = rows.orderBy("rule_ord", "rule", "pattern").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: names belong in a dictionary, which is read by one automaton")
    compile_ = rules.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    good, bad, names = [], [], {d.rule for d in behind}
    for r in found:
        try:
            matcher = compile_(r["pattern"] or "").matcher("")
            why = (
                "no category" if not r["category"] or not r["category"].replace("_", "").isascii() or not r["category"].replace("_", "").isalnum() or not r["category"][0].isalpha()
                else "matches an empty text" if matcher.find()
                else f"no group {r['value']}" if not 0 <= r["value"] <= matcher.groupCount()
                else "a rule of this name exists" if r["rule"] in names else ""
            )
        except IllegalArgumentException as error:
            why = str(error).splitlines()[0]
        if why:
            bad.append((r["rule"], why))
        else:
            names.add(r["rule"])
            good.append(Detector(r["rule"], r["category"], r["pattern"], r["value"], r["guarded"]))
    return (*behind, *good), bad


def answered(docs: DataFrame, function: Answer, keys: Sequence[str] = ("review_id", "doc_ord"), text: str = "text", batch: int = 64) -> DataFrame:
    """The keys, reply, failed and error: what a caller's function answers to each text.

    The function gets up to ``batch`` texts at once and gives as many replies, strings or None. If it raises or gives another number, each of these texts is asked for
    alone, and only those that fail again have no reply. Null texts are asked for as empty ones. The replies go to parse_masker_response and
    merge_masker_output (X3) or to the parsers of reviews (X5), where a text without a reply keeps what the rules say.
    """
    schema = docs.select(*keys).schema.add("reply", "string").add("failed", "boolean").add("error", "string")
    names = [f.name for f in schema.fields]

    def ask(texts: list[str]) -> list[str | None]:
        replies = list(function(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
        return [None if r is None else str(r) for r in replies]

    def one(said: str) -> tuple[str | None, str | None]:
        try:
            return ask([said])[0], None
        except Exception as error:  # noqa: BLE001  whatever a caller's function raises is that text's own
            return None, traceback.format_exception_only(error)[-1].strip()[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]
            out: list[tuple[str | None, str | None]] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    out += [(r, None) for r in ask(part)]
                except Exception:  # noqa: BLE001  asked for one by one instead
                    out += [one(said) for said in part]
            replies, errors = [r for r, _ in out], [e for _, e in out]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(replies, pa.string()), pa.array([e is not None for e in errors]), pa.array(errors, pa.string())], names=names)

    return docs.select(*keys, F.col(text).alias("_asked")).mapInArrow(run, schema)


DECISIONS = ("safe", "mask_and_continue", "block")
JUDGED = {"decision": "string", "reasons": "array<string>", "actions": "array<string>"}


def judged(assessed: DataFrame, told: Mapping[str, Column]) -> DataFrame:
    """What a caller's expressions say of documents that assess_sensitivity has judged.

    told: expressions for decision, and for reasons and actions if wanted, over the columns of ``assessed``. They are checked
    before anything runs: an unknown name, column or type is a ValueError. Where the decision is null or none of the three, all of the
    rules' judgement stays; where only reasons or actions are null, the rules' ones do. A document that the rules block stays blocked: a caller can be stricter, not laxer.
    """
    if unknown := set(told) - set(JUDGED) or {"decision"} - set(told):
        raise ValueError(f"decision is needed, reasons and actions may be given: {sorted(unknown)}")
    try:
        types = {f.name: f.dataType.simpleString() for f in assessed.select(*[c.alias(k) for k, c in told.items()]).schema.fields}
    except AnalysisException as error:
        raise ValueError(f"an expression does not fit the documents: {error.getMessage()}") from error
    if wrong := {k: t for k, t in types.items() if t not in (JUDGED[k], "void")}:
        raise ValueError(f"types {wrong} where {JUDGED} are wanted")
    rows = assessed.withColumns({f"_{k}": c.cast(JUDGED[k]) for k, c in told.items()})
    known = F.coalesce(F.col("_decision").isin(*DECISIONS), F.lit(False)) & ~((F.col("decision") == "block") & (F.col("_decision") != "block"))
    rows = rows.withColumns({k: F.when(known, F.coalesce(F.col(f"_{k}"), F.col(k))).otherwise(F.col(k)) for k in told if k != "decision"})
    return rows.withColumn("judged_by", F.when(known, "caller").otherwise("rules")).withColumn("decision", F.when(known, F.col("_decision")).otherwise(F.col("decision"))).drop(*[f"_{k}" for k in told])
