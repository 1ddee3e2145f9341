"""Operator 9: token counts of fields or sections by offset mapping.

A document is encoded once as a whole. Every token has a span of characters; sections are spans too, and both
lists are in order, so one merge joins each token to the section it begins in. Rule for tokens that
cross a boundary: such a token counts for the section that holds the most of its characters, the earlier one if
equal; `n_crossing` says how many tokens of a section reach into another one. No section loses or doubles a token: the counts of a
document add up to the count of its text.

Sections of the query are the lines of the text; a line feed belongs to the line it ends. One narrow pass
without a shuffle. Defined results: a null or empty text has no sections and gives no row; repeated rows
give their rows again; a null key stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec
from tidemark.llm.common import batch_of, read, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def line_starts(text: str) -> np.ndarray:
    """First characters of the lines of a text that is not empty."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(text)]])


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per section the tokens allocated to it and those of them that cross a boundary.

    `starts`, `ends`: token spans; `sections`: first characters of adjacent sections, the first one 0."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    home = first.copy()
    for t in np.flatnonzero(last > first):
        edges = np.concatenate([[starts[t]], sections[first[t] + 1:last[t] + 1], [ends[t]]])
        home[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(home, minlength=len(sections)), np.bincount(home[last > first], minlength=len(sections))


def section_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                   pattern: str = public_tokenizers.PATTERN,
                   sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """(key, section, start_char, n_chars, n_tokens, n_crossing), one row per section."""
    where = path or public_tokenizers.path(VOCABULARY)
    schema = pa.schema([("key", pa.int64())] + [(c, pa.int64()) for c in ("section", "start_char", "n_chars", "n_tokens", "n_crossing")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, pattern)
        for b in batches:
            keys, parts = b.column(0).to_pylist(), []
            for k, t in zip(keys, texts_of(b.column(1)), strict=True):
                if t:
                    first = sections(t)
                    n, crossing = allocate(*own.spans(t), first)
                    parts.append((k, np.arange(len(first)), first, np.diff(np.append(first, len(t))), n, crossing))
            if parts:
                repeated = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
                yield batch_of(schema, repeated, *(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, 6)))

    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, "key bigint, section bigint, start_char bigint, n_chars bigint, n_tokens bigint, n_crossing bigint"
                             ).withColumnRenamed("key", key)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                 pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, n_tokens) of whole texts; null for a null text."""
    where = path or public_tokenizers.path(VOCABULARY)
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, pattern)
        for b in batches:
            yield batch_of(schema, b.column(0), [None if t is None else own.count(t) for t in texts_of(b.column(1))])

    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, "key bigint, n_tokens bigint").withColumnRenamed("key", key)


def op9_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(read(spark, sf_dir, "documents"))
