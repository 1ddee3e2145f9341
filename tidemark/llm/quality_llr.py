"""Operator 1: quality rules and a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are longest runs of letters and digits (ASCII ones and everything beyond ASCII) or of ASCII punctuation; n-grams are
tokens and pairs of neighbours, hashed to BUCKETS. Two multinomials with add-one smoothing are
counted over all documents: trusted text (labelled quality 1) and raw text (everything). A document's score is the mean over
its n-grams of ln p_trusted - ln p_raw, so its length cancels out; it is kept if the score reaches THRESHOLD.

Counting sends at most BUCKETS rows per task; only BUCKETS sums reach the driver. The list of trusted ids is broadcast after its size is
checked, else joined by a shuffle.

Defined results: a null text has no words; a text without n-grams has a null score and is not kept; without any trusted text all
weights are 0. A document is trusted if all its labels say 1. Repeated rows each give a row; a null key is never trusted; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bytes_of, read, small_side, texts_of
from tidemark.llm.words import shingles, words

BUCKETS = 10_000
THRESHOLD = -0.1
PRIME = (1 << 31) - 1
BASE, PAIR = 257, 1_000_003

_PIECE = 1 << 19
_KIND = np.zeros(129, dtype=np.uint8)   # 0 between tokens, 1 letters and digits, 2 punctuation; 128 stands for all beyond
_KIND[33:127] = 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _KIND[_lo:_hi] = 1
_KIND[128] = 1


def _powers(n: int) -> np.ndarray:
    out, x = np.empty(n, dtype=np.int64), 1
    for i in range(n):
        out[i], x = x, x * BASE % PRIME
    return out


_POWERS = _powers(1024)


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the tokens; the hash is Horner's polynomial over code points, modulo PRIME."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _KIND[np.minimum(points, 128)]
    change = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts = change[:-1][kind[change[:-1]] > 0] if len(change) else change
    if not len(starts):
        return starts, starts
    ends = change[np.searchsorted(change, starts) + 1]
    sizes = ends - starts
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    inside = points[kind > 0].astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    inside *= powers[np.repeat(firsts + sizes - 1, sizes) - np.arange(len(inside))]
    inside %= PRIME
    return starts, np.add.reduceat(inside, firsts) % PRIME


def _long(text: str) -> np.ndarray:
    out, at = [], 0
    while at < len(text):
        to = at + _PIECE
        while to < len(text) and ord(text[to]) > 32:
            to += 1
        out.append(_hashes(text[at:to])[1])
        at = to
    return np.concatenate(out) if out else np.empty(0, np.int64)


def ngram_buckets(texts: Sequence[str | None], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, document, bucket) of the n-grams of texts lo..hi-1."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < _PIECE):
            size += len(texts[hi] or "") + 1
            hi += 1
        group = [t or "" for t in texts[lo:hi]]
        if hi == lo + 1:
            h = _long(group[0])
            doc = np.full(len(h), lo)
        else:
            at, h = _hashes("\n".join(group))
            doc = lo + np.searchsorted(np.cumsum([0, *(len(g) + 1 for g in group[:-1])]), at, side="right") - 1
        same = doc[1:] == doc[:-1]
        pairs = (h[:-1] * PAIR + h[1:])[same] % PRIME
        yield lo, hi, np.concatenate([doc, doc[1:][same]]), np.concatenate([h, pairs]) % buckets
        lo = hi


def weights(rows: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """ln p_trusted - ln p_raw per bucket, from all rows (doc_id, text) and the ids (doc_id) of trusted ones."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("good", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            mark = np.asarray(b.column(1).fill_null(False))
            for _, _, doc, bucket in ngram_buckets(texts_of(b.column(0)), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[mark[doc]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield batch_of(schema, used.astype(np.int32), raw[used], good[used])

    marked = rows.join(small_side(trusted.withColumn("good", F.lit(True))), "doc_id", "left").select("text", "good")
    counted = marked.mapInArrow(run, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():   # at most `buckets` rows
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(buckets)
    return np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


_SPACES = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTED = np.ones(256, dtype=bool)   # begins a code point of a word
_COUNTED[0x80:0xC0] = False
_COUNTED[[32, *range(9, 14)]] = False


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(texts: Sequence[bytes | None], n: int = 5) -> Iterator[tuple[int, int]]:
    """(words, words inside n-word windows that the text has twice or more) of every text."""
    for w in words(texts, lower=False):
        at, h = shingles(w.doc, w.hash, n)
        docs = np.arange(w.lo, w.hi)
        word_from, word_to = np.searchsorted(w.doc, docs), np.searchsorted(w.doc, docs, side="right")
        of = w.doc[at]
        from_, to = np.searchsorted(of, docs), np.searchsorted(of, docs, side="right")
        for i in range(len(docs)):
            count, mine = int(word_to[i] - word_from[i]), h[from_[i]:to[i]]
            order = np.argsort(mine, kind="stable")
            equal = mine[order][1:] == mine[order][:-1]
            if not equal.any():
                yield count, 0
                continue
            twice = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
            cover = np.zeros(count + 1, dtype=np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + n, -1)
            yield count, int(np.count_nonzero(np.cumsum(cover)[:count]))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score), one row per input row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = 1 and r = 1").select("doc_id")
    weight = weights(rows, trusted, buckets)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t or b"" for t in bytes_of(b.column(1))]
            texts = [t.decode("utf-8", "replace") for t in raw]
            arrays = [np.frombuffer(t, np.uint8) for t in raw]
            counts = list(repeated_words(raw))
            score = np.full(len(raw), np.nan)
            for lo, hi, doc, bucket in ngram_buckets(texts, buckets):
                n = np.bincount(doc - lo, minlength=hi - lo)
                total = np.bincount(doc - lo, weights=weight[bucket], minlength=hi - lo)
                score[lo:hi] = np.where(n > 0, total / np.maximum(n, 1), np.nan)
            yield batch_of(schema, b.column(0), [c[0] for c in counts], [int(np.count_nonzero(_COUNTED[a])) for a in arrays],
                           [int(np.count_nonzero(_SYMBOL[a])) for a in arrays], [repeated_lines(t) for t in texts],
                           [c[1] for c in counts], pa.array(score, pa.float64(), from_pandas=True))

    base = rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.select("doc_id", *names, failed.alias("base_failed"), (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"),
                       F.round("score", 6).alias("score"))


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
win AS (SELECT r, i, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS s
        FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS x(k) GROUP BY r),
nw AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
tok AS (SELECT r, unnest(regexp_extract_all(t, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-`{{-~]+')) AS w,
               generate_subscripts(regexp_extract_all(t, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-`{{-~]+'), 1) AS i FROM d),
hashed AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(w) + 1), lambda k: unicode(substr(w, k, 1))::BIGINT)),
                                 lambda a, b: (a * {BASE} + b) % {PRIME}) AS h FROM (SELECT DISTINCT w FROM tok)),
seq AS (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS nxt FROM tok JOIN hashed USING (w)),
grams AS (SELECT r, h % {BUCKETS} AS b FROM seq UNION ALL SELECT r, (h * {PAIR} + nxt) % {PRIME} % {BUCKETS} FROM seq WHERE nxt IS NOT NULL),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
c AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS g FROM grams JOIN d USING (r) GROUP BY b),
s AS (SELECT sum(n) AS n, sum(g) AS g FROM c),
wt AS (SELECT b, CASE WHEN s.g = 0 THEN 0 ELSE ln((c.g + 1) / (s.g + {BUCKETS})) - ln((c.n + 1) / (s.n + {BUCKETS})) END AS x FROM c, s),
score AS (SELECT r, avg(x) AS score FROM grams JOIN wt USING (b) GROUP BY r),
f AS (SELECT doc_id, coalesce(nw.n, 0) AS n_words, CAST(coalesce(nw.chars, 0) AS BIGINT) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, score
      FROM d LEFT JOIN nw USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN score USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(score >= {THRESHOLD}, FALSE) AS kept, round(score, 6) AS score
FROM f
"""
