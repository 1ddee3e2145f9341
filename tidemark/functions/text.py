"""Text and URL column expressions. Whole strings only, JVM-side except Unicode composition."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import TITLE_LIMIT, TRACKING_PARAMS
from tidemark.functions.timing import col

WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
URL_PARTS = r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def words(c: Column | str) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def long_words(c: Column | str) -> Column:
    """Lower-case word tokens of at least two characters in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD2), F.lit(0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of n neighbouring tokens; an empty array for shorter input."""
    def grams(t: Column) -> Column:
        count = F.size(t) - F.lit(n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                           lambda i: F.concat_ws(sep, F.slice(t, i, n)))
        return F.when(count >= 1, runs).otherwise(F.array().cast("array<string>"))
    return bind(tokens, grams)


def clean_title(c: Column | str) -> dict[str, Column]:
    """Drop control characters other than newline and tab, cut at the title limit; `full` is the text before the cut."""
    cleaned = F.regexp_replace(col(c), r"[\p{C}&&[^\n\t]]", "")
    return {"title": F.substring(cleaned, 1, TITLE_LIMIT),
            "truncated": F.length(cleaned) > TITLE_LIMIT, "full": cleaned}


@F.pandas_udf(T.StringType())
def compose_nfc(s: pd.Series) -> pd.Series:
    """Canonical composition has no built-in; one Arrow batch at a time."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def canonical_url(c: Column | str) -> Column:
    """http(s) only, no user info; tracking parameters and fragment dropped, host lower-cased.

    Pairs keep their order and blank values. Percent escapes are left as they are written.
    NULL marks a URL that is refused.
    """
    u = F.trim(col(c))
    scheme = F.regexp_extract(u, URL_PARTS, 1)
    netloc = F.regexp_extract(u, URL_PARTS, 2)
    path = F.regexp_extract(u, URL_PARTS, 3)
    query = F.regexp_extract(u, URL_PARTS, 4)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING_PARAMS))
    pairs = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.concat_ws("&", pairs))).otherwise("")
    ok = (scheme != "") & (F.regexp_replace(netloc, r":\d*$", "") != "") & ~netloc.contains("@")
    return F.when(ok, F.concat(scheme, F.lit("://"), F.lower(netloc),
                               F.when(path == "", F.lit("/")).otherwise(path), tail))
