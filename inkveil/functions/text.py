"""Scalar text functions, all inside the JVM but for Unicode normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkveil.functions.detectors import APPROVED, UNAPPROVED


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def count_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests], F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """a quarter of the characters, rounded up; 0 for empty texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int")))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Any word as a part of the text; one small expression for any number of words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def contains_any_lower(text: Column, words: Sequence[str]) -> Column:
    """any word as a substring of the lower-cased text."""
    return has_any(F.lower(text), [w.lower() for w in words])


def squeezed(text: Column) -> Column:
    """Lower case, full-width digits as ASCII, no white space."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # translate looks at every character in a map; few texts need it
    digits = F.when(low.rlike("[０-９]"), F.translate(low, "０１２３４５６７８９", "0123456789")).otherwise(low)
    return F.regexp_replace(digits, r"(?U)\s+", "")


# Ideographs and kana, without the blank U+3000; and where one of these or white space ends a run of others.
_CJK = r"\u3001-\u30ff\u3400-\u9fff"
_NO_CJK = rf"(?U)\s*[^{_CJK}\s][^{_CJK}]*"


def cjk_only(text: Column) -> Column:
    """``squeezed`` cut down for words that ``is_cjk``: what stands between such characters is one mark, mere white space nothing. The same of these words are in it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _NO_CJK, "|"), r"(?U)\s+", "")


def cjk_runs(text: Column) -> Column:
    """A text cut down for words that ``is_cjk``: each run of other characters, white space too, is one mark. Such a word is in it where it is in the text."""
    return F.regexp_replace(text, f"[^{_CJK}]+", "|")


def is_cjk(word: str) -> bool:
    return bool(word) and all("\u3001" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in word)


def squeeze_word(word: str) -> str:
    return "".join(word.lower().translate(str.maketrans("０１２３４５６７８９", "0123456789")).split())


def contains_any_squeezed(squeezed_text: Column, words: Sequence[str]) -> Column:
    """F8: as F7, on a text that ``squeezed`` made; done once per text."""
    return has_any(squeezed_text, [squeeze_word(w) for w in words])


def bounded_pattern(word: str) -> str:
    """a side of the word that is an ASCII letter or digit must not touch another one."""
    quoted = "\\Q" + word + "\\E"
    edge = lambda c: c.isascii() and c.isalnum()
    return "(?iu)" + ("(?<![A-Za-z0-9])" if edge(word[0]) else "") + quoted + ("(?![A-Za-z0-9])" if edge(word[-1]) else "")


# Letters that (?iu) takes for ASCII ones.
_FOLDED = ("ſKİı", "skii")


def folded(text: Column) -> Column:
    """Lower case as (?iu) compares it with words of ASCII and caseless characters."""
    return F.lower(F.when(any_of([F.contains(text, F.lit(c)) for c in _FOLDED[0]]), F.translate(text, *_FOLDED)).otherwise(text))


def has_bounded(folded_text: Column, word: str) -> Column:
    """F9 on a text that ``folded`` made: a plain search, and a pattern only where the word is found and has edges to look at."""
    if not all(c.isascii() or c.lower() == c.upper() for c in word):
        raise ValueError(f"a word with letters that are neither ASCII nor caseless: {word}")
    w = word.lower()
    found = F.contains(folded_text, F.lit(w))
    edge = lambda c: c.isascii() and c.isalnum()
    if not (edge(w[0]) or edge(w[-1])):
        return found
    quoted = "\\Q" + w + "\\E"
    # the word comes first in the pattern, so that the search is for it
    return found & folded_text.rlike(quoted + (f"(?<![a-z0-9]{quoted})" if edge(w[0]) else "") + ("(?![a-z0-9])" if edge(w[-1]) else ""))


def contains_any_bounded(folded_text: Column, words: Sequence[str]) -> Column:
    """any word, on a text that ``folded`` made; done once per text."""
    return any_of([has_bounded(folded_text, w) for w in words if w])


def unapproved_placeholders(text: Column) -> Column:
    """placeholder-like tokens of other styles, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in UNAPPROVED])))


def normalise_placeholders(text: Column) -> Column:
    """numbers of approved placeholders get three digits."""
    names = "|".join(APPROVED)
    one = F.regexp_replace(text, rf"\[({names})_(\d)\]", r"[$1_00$2]")
    return F.regexp_replace(one, rf"\[({names})_(\d\d)\]", r"[$1_0$2]")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


# Bullets, brackets and blanks that are trimmed from a term.
TRIMMED = " \t\r\n　・●○■□◆◇▲△▼▽★☆※-*•「」『』【】()[]（）〔〕<>＜＞《》〈〉\"'“”‘’、。,.;:：；"


def nfkc(text: Column) -> Column:
    """Unicode NFKC; ASCII texts, most of them, skip Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def nfkc_trim(text: Column) -> Column:
    """N1."""
    return F.btrim(nfkc(text), F.lit(TRIMMED))


def context(text: Column, word: Column, radius: int = 30, dots: str = "") -> Column:
    """The surroundings of the first occurrence, white space squeezed."""
    at = F.position(word, text)
    begin = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text) + 1, at + F.length(word) + radius)
    middle = F.btrim(F.regexp_replace(F.substring(text, begin, end - begin), r"(?U)\s+", " "))
    before = F.when(begin > 1, F.lit(dots)).otherwise(F.lit(""))
    after = F.when(end <= F.length(text), F.lit(dots)).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(before, middle, after)).otherwise(F.lit(""))


def excerpt(text: Column, chars: int = 220) -> Column:
    """N3."""
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, chars)


def abbreviations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Z0-9]{1,}(?:/[A-Z0-9]{2,})?\b"), F.lit(0))))
