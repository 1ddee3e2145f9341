"""Operator 7: near-duplicates by SuperMinHash, banding, verification and union of verified links.

Every element of a set gets one random permutation of the signature places; its j-th draw goes to the place
permuted to j with the value j + u, u in [0, 1). A place keeps its smallest value. After draw j all places filled are final, so a
set stops as soon as every place is filled: a large set needs one draw per element.

Steps. (1) One pass makes shingle sets, their digests and band keys. (2) Equal sets are one class from the start,
so copies never meet. (3) In each bucket of a band every class is compared with the bucket's smallest class, on full
sets; buckets that still lie in several components are resolved exactly by rare shingles (links.py), so no link
of a bucket is lost and no bucket is capped or turned into all its pairs. (4) Components of the verified links.

Bands: 32 of 4 places find a pair of similarity 0.75 with probability 1 - 5e-6, more similar ones more surely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bytes_of, fresh, read, small_side
from tidemark.llm.components import components
from tidemark.llm.links import grouped
from tidemark.llm.words import mix, shingle_sets, words
from tidemark.session import cut_lineage

BANDS, ROWS = 32, 4
PERCENT = 75
_SEED = 0x5851F42D4C957F2D


def _draw(elements: np.ndarray, j: int) -> np.ndarray:
    return mix(elements + np.uint64((j + 1) * _SEED & 0xFFFFFFFFFFFFFFFF))


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets), places) of sets of 64-bit hashes; places of an empty set hold infinity.

    A value is (draw number, 32 random bits) in one integer, so comparisons are exact."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), places), top, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = None   # the permutations so far, made only for sets that need a second draw
    flat = out.reshape(-1)
    for j in range(places):
        if not len(elements):
            break
        r = _draw(elements, j)
        k = j + ((r >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(j << 32) | (r & np.uint64(0xFFFFFFFF))
        rows = np.arange(len(elements))
        if order is None:
            place = k
        else:
            place = order[rows, k].astype(np.int64)
        np.minimum.at(flat, owner * places + place, value)
        open_sets = (out == top).any(axis=1)
        stay = open_sets[owner]
        if not stay.all():
            elements, owner, place, k = elements[stay], owner[stay], place[stay], k[stay]
            order = None if order is None else order[stay]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
        rows = np.arange(len(elements))
        order[rows, k] = order[rows, j]
        order[rows, j] = place
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys; the band number is part of a key."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(_SEED) + parts[:, :, i])
    return key.view(np.int64)


_SMALL_SETS = 1 << 15   #: elements whose permutations are held at once


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of rows (doc_id, text); bands is null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for w in words(bytes_of(b.column(1))):
                sets = [s for _, s in shingle_sets(w)]
                keys: list[list[int] | None] = []
                at = 0
                while at < len(sets):
                    to, size = at, 0
                    while to < len(sets) and (to == at or size + len(sets[to]) <= _SMALL_SETS):
                        size += len(sets[to])
                        to += 1
                    found = band_keys(signatures(sets[at:to], bands * rows), bands, rows)
                    keys += [k.tolist() if len(s) else None for k, s in zip(found, sets[at:to], strict=True)]
                    at = to
                yield batch_of(schema, ids.slice(w.lo, w.hi - w.lo), [len(s) for s in sets],
                               [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], keys)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of rows (doc_id, text)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for w in words(bytes_of(b.column(1))):
                yield batch_of(schema, ids.slice(w.lo, w.hi - w.lo), [s.view(np.int64) for _, s in shingle_sets(w)])

    return docs.select("doc_id", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def of_documents(full: DataFrame, classes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of the copies among (doc_id, digest), node the head of their class (digest, head), and (node, component) of the heads that are linked.

    A copy needs no link, it takes the component of its head. Only where rows of one key hold several texts, copies join classes: such keys become links."""
    copies = full.join(classes, "digest").where("head <> doc_id").select("doc_id", "head")
    several = cut_lineage(full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not several.isEmpty():
        bridges = copies.join(small_side(several), "doc_id", "left_semi").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(bridges))
    return copies.groupBy("doc_id").agg(F.min("head").alias("node")), found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Defined results: a null or wordless text has no shingles and is its own component. A null key is never
    linked: its component is null and it is kept. Rows that share a key are one document: all their texts link it,
    n_shingles is each row's own. kept says whether doc_id = component_id, so repeated rows of a kept key are all kept.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = cut_lineage(sketches(rows))
    full = sketch.where("doc_id is not null and n_shingles > 0")
    # one class per digest, named by its smallest document
    classes = full.groupBy("digest").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("h"))
    classes = cut_lineage(classes.select("digest", F.col("h.doc_id").alias("head"), "h.bands"))
    members = classes.select(F.col("head").alias("node"), F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    crowded = cut_lineage(members.join(heads, "bucket"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return full_sets(rows.join(small_side(nodes.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi"))

    copies, found = of_documents(full.select("doc_id", "digest"), classes.select("digest", "head"), grouped(crowded, sets_of, percent))
    out = sketch.select("doc_id", "n_shingles").join(copies, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id")).join(found, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns; rows equal in key and text count once, rows of a null key stay."""
    ids = docs.select(F.col(f"`{key}`").cast("bigint").alias("id")).where("id is not null")
    own = fresh(docs, "dropped_doc_id")
    found = near_duplicates(docs, key, text)
    gone = small_side(cut_lineage(found.where("not kept").select(F.col("doc_id").alias(own)).distinct()))
    left = docs.join(gone, F.col(f"`{key}`").cast("bigint") == F.col(own), "left_anti")
    many = small_side(cut_lineage(ids.groupBy("id").count().where("count > 1").select(F.col("id").alias(own))))
    same = F.col(f"`{key}`").cast("bigint") == F.col(own)
    return left.join(many, same, "left_anti").unionByName(left.join(many, same, "left_semi").dropDuplicates([key, text]))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
