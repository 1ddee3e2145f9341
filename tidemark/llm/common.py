"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.neardup import SHARED_BITS, shared_bits
from tidemark.session import cut_lineage

BROADCAST_ROWS = 1_000_000
TEXT_ROWS = 1_000   #: whole texts that a Python worker is handed at once; work and results are per text, so it only bounds memory


def in_small_batches(spark) -> None:
    """Hand texts to Python workers TEXT_ROWS at a time, or fewer where the session says so: each batch is held by Spark's writer, by Arrow and as strings."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    """Strings of a column; bytes that are no UTF-8 become replacement characters."""
    return [None if b is None else b.decode("utf-8", "replace") for b in bytes_of(column)]


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)],
                           schema=schema)


def crc(key: Column) -> Column:
    """crc32 of the key written as text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the input does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a key list for broadcast only after its size is counted; a longer list joins by a shuffle.

    Both ways give the same rows. `keys` is read twice, so it should be a checkpoint or a cheap scan.
    """
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def bits_of(units: DataFrame) -> np.ndarray:
    """Bits of fixed size that are set for two parts of every number of a frame (unit)."""
    second = F.shiftright("unit", SHARED_BITS.bit_length() - 1)
    return shared_bits(units.select(F.explode(F.array("unit", second)).alias("h")))


def named(unit: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Places of the numbers that `bits_of` has set both bits for, all without bits. What looks named by chance goes in the join that follows."""
    if bits is None:
        return np.arange(len(unit))
    mask = 8 * len(bits) - 1
    both = (unit & mask, (unit >> mask.bit_length()) & mask)
    return np.flatnonzero(np.logical_and(*((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 for bit in both)))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


REWRITE_ROWS = 100_000   #: lists of cuts that may be broadcast
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def rewritten(docs: DataFrame, marks: DataFrame, cut: Callable[[str, list], str], key: str, text: str) -> DataFrame:
    """`docs` with the texts changed that `marks` (doc_id, text_key, cut) names; text_key is xxhash64 of the text.

    Documents left without a word go; n_chars follows the text where there is such a column. Only changed texts pass through
    Python. The list of cuts is broadcast after its size is checked, else joined by a shuffle of the documents that bits name; all others stay where they are.
    """
    own, mine, new = fresh(docs, "cut_doc_id"), fresh(docs, "cut_text_key"), fresh(docs, "cut_text")
    where = fresh(docs, "cut_places")
    marks = cut_lineage(marks.select(F.col("doc_id").alias(own), F.col("text_key").alias(mine), F.col("cut").alias(where)))
    old = F.col(f"`{text}`").cast("string")
    if marks.limit(REWRITE_ROWS + 1).count() > REWRITE_ROWS:
        bits = bits_of(marks.select(F.col(own).alias("unit")))

        @F.arrow_udf(T.BooleanType())
        def listed(keys: pa.Array) -> pa.Array:
            out = np.zeros(len(keys), dtype=bool)
            out[named(keys.fill_null(0).to_numpy(zero_copy_only=False), bits)] = True
            return pa.array(out)

        one = fresh(docs, "cut_listed")
        asked = docs.withColumn(one, listed.asNondeterministic()(F.col(f"`{key}`").cast("bigint")))
        same = [f"`{c}`" for c in docs.columns]
        rest, docs = asked.where(~F.col(one)).select(*same), asked.where(one).select(*same)
    else:
        rest, marks = None, F.broadcast(marks)

    @F.arrow_udf(T.StringType())
    def changed(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t, p) for t, p in zip(texts_of(texts), places.to_pylist(), strict=True)], pa.string())

    met = docs.join(marks, (F.col(f"`{key}`").cast("bigint") == F.col(own)) & (F.xxhash64(old) == F.col(mine)), "left")
    # else Spark moves the test for words below this column and rewrites each text twice, with two Python workers a task that stay
    met = met.withColumn(new, changed.asNondeterministic()(F.when(F.col(where).isNotNull(), old), F.col(where)))
    met = met.where(F.col(where).isNull() | F.col(new).rlike(HAS_WORD))
    out = {text: F.coalesce(F.col(new), old)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(where).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    met = met.withColumns(out).select(*(f"`{c}`" for c in docs.columns))
    return met if rest is None else rest.unionByName(met)
