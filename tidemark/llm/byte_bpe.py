"""Operator 2: byte-level BPE encoding and decoding with a serialised sentencepiece model.

One narrow pass without a shuffle: a task reads its rows in Arrow batches, splits each whole text by the
pattern, encodes the pre-tokens and decodes by the inverse mapping. A lost task is simply run again.

Defined results: a null text encodes like the empty one (no ids, empty bytes); repeated rows and null keys
stay as they are; an empty table gives an empty result; columns other than `key` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec
from tidemark.llm.common import batch_of, read, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           pattern: str = public_tokenizers.PATTERN, with_bytes: bool = False) -> DataFrame:
    """(key, ids) with ids as little-endian unsigned 32-bit integers; `with_bytes` adds the decoded bytes."""
    where = path or public_tokenizers.path(VOCABULARY)
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.binary())] * with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, pattern)
        for b in batches:
            ids = [own.encode(t or "") for t in texts_of(b.column(1))]
            extra = [[own.decode(i) for i in ids]] if with_bytes else []
            yield batch_of(schema, b.column(0), ids, *extra)

    return source.mapInArrow(run, "key bigint, ids binary" + ", decoded binary" * with_bytes).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, decoded) from ids; null ids decode to null."""
    where = path or public_tokenizers.path(VOCABULARY)
    schema = pa.schema([("key", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, public_tokenizers.PATTERN)
        for b in batches:
            yield batch_of(schema, b.column(0), [None if i is None else own.decode(i) for i in b.column(1).to_pylist()])

    source = encoded.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids"))
    return source.mapInArrow(run, "key bigint, decoded binary").withColumnRenamed("key", key)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest per document of the ids and of the bytes decoded from them."""
    out = encode(read(spark, sf_dir, "documents"), with_bytes=True)
    return out.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
