"""Operator 4: line dedup by winnowing over line hashes.

The lines of a text that hold a word are hashed; K consecutive ones make a k-gram. In every window of SPAN consecutive k-grams the
one with the smallest hash (the last of equals) is a fingerprint; a text with fewer k-grams is one window. So every run of K + SPAN - 1
lines that two places share has the same fingerprint in both. Fingerprints of one hash are joined to the first place
(smallest doc_id, then line) that has it. A match is extended both ways: by each number of lines up to SPAN - 1 to the left and to the right, and each
extension is matched with the first place that has it, which need not be the place of the fingerprint. Lines of later matches are
deleted; the first place of a run keeps it.

Result: every line of a run of K + SPAN - 1 lines or more that occurs earlier is deleted, wherever the earlier run stands, and
no line outside a repeated run of K lines is. All joins are on hashes: a run in a third of all documents is one key whose counts are combined before
the shuffle, and the join back is a plain sort-merge join that Spark can split.

The query keeps to that rule, which its SQL states. The pipeline takes its fingerprints and extensions too, and then, by an exact pass beside them, what no window has chosen
(`unchosen`): every other two consecutive lines and every single line of LINE_WORDS words or more. So all later repeats of either are deleted, whatever stands
around them; short single lines alone stay.

Defined results: rows of a null key or text, and lines without a word, take no part and stay. Rows equal in key and text are one document. A document
that loses all lines with a word is dropped by `deduplicated`. Other columns pass through, whatever their names; n_chars follows the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, read, rewritten, texts_of

K, SPAN = 2, 2
LINE_WORDS = 5   #: words of a line that is deleted without a repeated neighbour

_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_SPACES}]+")


def _digest(parts: list[str]) -> str:
    return hashlib.md5("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def fingerprints(text: str, k: int = K, span: int = SPAN) -> list[tuple[str, int, list[int]]]:
    """(key, place, line numbers) of the fingerprints of a text and of their extensions; place is the first line's number."""
    numbered = [(i, _digest([line])) for i, line in enumerate(text.split("\n")) if line.strip(_SPACES)]
    number, line = [n for n, _ in numbered], [h for _, h in numbered]
    grams = [_digest(line[i:i + k]) for i in range(len(line) - k + 1)]
    chosen = set()
    for at in range(max(1, len(grams) - span + 1) if grams else 0):
        chosen.add(min(range(at, min(at + span, len(grams))), key=lambda i: (grams[i], -i)))
    out = []
    for i in sorted(chosen):
        out.append((grams[i], number[i], number[i:i + k]))
        for e in range(1, span):
            if i >= e:
                out.append((_digest([f"L{e}", *line[i - e:i + k]]), number[i], number[i - e:i + k]))
            if i + k + e <= len(line):
                out.append((_digest([f"R{e}", *line[i:i + k + e]]), number[i], number[i:i + k + e]))
    return out


def unchosen(text: str, least: int, chosen: list[tuple[str, int, list[int]]]) -> list[tuple[str, int, list[int]]]:
    """(key, place, line numbers) of every two consecutive lines that `chosen` lacks and of every line of `least` words or more. The keys of pairs are those of k-grams of two."""
    numbered = [(i, line, _digest([line])) for i, line in enumerate(text.split("\n")) if line.strip(_SPACES)]
    have = {(h, i) for h, i, _ in chosen}
    out = [(_digest(["1", h]), i, [i]) for i, line, h in numbered if len(_WORD.findall(line)) >= least]
    pairs = [(_digest([h, g]), i, [i, j]) for (i, _, h), (j, _, g) in zip(numbered, numbered[1:], strict=False)]
    return out + [p for p in pairs if (p[0], p[1]) not in have]


def deletions(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, span: int = SPAN, least: int | None = None) -> DataFrame:
    """(doc_id, text_key, line, kept_doc_id): lines (numbered from 0) to delete from a text, and the first document that keeps each.

    text_key is xxhash64 of the text, so that rows of one key with different texts are told apart. With `least` lines and pairs that
    no window has chosen follow (`unchosen`)."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"),
                       F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = pa.schema([("h", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("lines", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(texts_of(b.column(2))):
                found = fingerprints(t, k, span)
                if least is not None:
                    found += unchosen(t, least, found)
                if found:
                    n = len(found)
                    yield batch_of(schema, [f[0] for f in found], pa.array([b.column(0)[i].as_py()] * n, pa.int64()),
                                   pa.array([b.column(1)[i].as_py()] * n, pa.int64()), [f[1] for f in found], [f[2] for f in found])

    prints = rows.mapInArrow(run, "h string, doc_id bigint, text_key bigint, place int, lines array<int>")
    prints = prints.select(F.xxhash64("h").alias("a"), F.xxhash64("h", F.lit(1)).alias("b"), "doc_id", "text_key", "place", "lines")
    here = F.struct("doc_id", "place")
    first = prints.groupBy("a", "b").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first <> last").select("a", "b", "first")
    later = prints.join(first, ["a", "b"]).where(here > F.col("first"))
    found = later.select("doc_id", "text_key", F.explode("lines").alias("line"), F.col("first.doc_id").alias("kept"))
    return found.groupBy("doc_id", "text_key", "line").agg(F.min("kept").alias("kept_doc_id"))


def without_lines(text: str, lines: list[int]) -> str:
    gone = set(lines)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, span: int = SPAN, least: int | None = None) -> DataFrame:
    """The documents without the deleted lines."""
    marks = deletions(docs, key, text, k, span, least).groupBy("doc_id", "text_key").agg(F.collect_list("line").alias("cut"))
    return rewritten(docs, marks, without_lines, key, text)


def op4_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted lines of all documents, with the first document that keeps each."""
    return deletions(read(spark, sf_dir, "documents")).select("doc_id", "line", "kept_doc_id")


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT doc_id, CAST(line AS INTEGER) AS line, md5(x) AS h FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT doc_id, line, h, lag(h) OVER o AS hl, lag(line) OVER o AS ll, lead(h) OVER o AS h2, lead(line) OVER o AS l2,
             lead(h, 2) OVER o AS h3, lead(line, 2) OVER o AS l3 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
k AS (SELECT *, md5(h || h2) AS gram FROM g WHERE h2 IS NOT NULL),
c AS (SELECT * FROM (SELECT *, lag(gram) OVER o AS before, lead(gram) OVER o AS after FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line))
      WHERE (before IS NULL AND after IS NULL) OR (before IS NOT NULL AND gram <= before) OR (after IS NOT NULL AND gram < after)),
f AS (SELECT doc_id, line AS place, gram AS key, [line, l2] AS lines FROM c
      UNION ALL SELECT doc_id, line, md5('L1' || hl || h || h2), [ll, line, l2] FROM c WHERE hl IS NOT NULL
      UNION ALL SELECT doc_id, line, md5('R1' || h || h2 || h3), [line, l2, l3] FROM c WHERE h3 IS NOT NULL),
p AS (SELECT key, min((doc_id, place)) AS first FROM f GROUP BY key),
d AS (SELECT f.doc_id, unnest(lines) AS line, first[1] AS kept FROM f JOIN p USING (key) WHERE (f.doc_id, place) > first)
SELECT doc_id, line, min(kept) AS kept_doc_id FROM d GROUP BY doc_id, line
"""
