"""Operator 12: personal data by fixed rules and a character-level bidirectional LSTM with CRF transitions.

Rules find e-mail addresses, IP numbers, payment cards and phone numbers in their plain forms. The tagger is trained in numpy on labelled spans and adds
disguised and unusual forms that the rules miss ("jo at mail dot example dot org", "10[.]0[.]0[.]1", cards grouped by dots, phones without a plus). Its
spans must then pass an exact check (Luhn, parts up to 255, digits counted, an address once the disguise is undone), and never touch a span of the rules.

Training: SAMPLE windows of text from documents chosen by a hash of the id, half of them at a digit or an @, so real numbers that are no personal data are
seen. Their labels are the spans of the rules; into half of the windows a made-up span is written in one of the forms below, into others numbers
that are not personal (dates, versions, prices, digests). Only these windows reach the driver; the trained arrays (some 20 kB) go to the tasks.

Application: every whole text is cut into windows of WINDOW characters that overlap by OVERLAP; all windows of a batch run in step. A window that provably has
its best path outside every span is not decoded further. Spans cut by a window's edge are united with their other half; among spans
that still overlap, the set of greatest total score is kept for the whole text.

One narrow pass, no shuffle; memory is bounded by STEP_WINDOWS windows at a time. Defined results: a null or empty text has no spans; repeated rows give their
rows again; a null key stays null; an empty table gives an empty result; other columns are not read. Without any text to train on the
windows are made of spaces.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, texts_of
from tidemark.llm.lstm_crf import Tagger

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3000            #: windows that train, and that validate by a tenth
TRAIN_CHARS = 96         #: characters of a training window
HIDDEN, EPOCHS, BATCH, RATE = 8, 10, 48, 0.04
WINDOW, OVERLAP = 384, 64
STEP_WINDOWS = 1024
LEAST_SCORE = 8.0        #: what a span of the tagger must score above being outside, summed over its characters (log units)
MOVES = 3                #: words by which either end of a tagged span may be moved to make it a valid value


class Span(NamedTuple):
    kind: int
    start: int
    end: int


# rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ZONE = re.compile(r"[0-9+][0-9+ ().-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. The part before an @ reaches back over the whole run of its characters, at most to the address before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start. Numbers lie in zones of digits and their separators, so each zone is searched by itself."""
    out = [Span(0, a, b) for a, b in emails(text)]
    numbers = ([], [], [])
    for zone in _ZONE.finditer(text):
        lo, hi = zone.span()
        if hi - lo < 7:
            continue
        numbers[0].extend(Span(1, *m.span()) for m in _IP.finditer(text, lo, hi) if small_parts(m[0]))
        for m in _CARD.finditer(text, lo, hi):
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                numbers[1].append(Span(2, *m.span()))
        numbers[2].extend(Span(3, *m.span()) for m in _PHONE.finditer(text, lo, hi) if 9 <= len(digits_of(m[0])) <= 15)
    return [*out, *numbers[0], *numbers[1], *numbers[2]]


# the exact check of the tagger's spans

_AT = re.compile(r"\s*(?:[\[({<]\s*(?:at|@)\s*[\])}>]|＠|@)\s*|\s+at\s+", re.IGNORECASE)
_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>])\s*|\s+dot\s+|\s+\.\s*|\.\s+", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PARTS = re.compile(r"[0-9]{1,3}(?:\s*(?:[\[({]?\s*(?:\.|dot)\s*[\])}]?)\s*[0-9]{1,3}){3}", re.IGNORECASE)
_CARD_LIKE = re.compile(r"[0-9]+(?:[^A-Za-z0-9]{1,3}[0-9]+)+")
_PHONE_LIKE = re.compile(r"[+(]?[0-9](?:[0-9]|[ ()./ ‐-―-]{1,3}[0-9(])*[0-9]")


def plausible(kind: int, s: str) -> bool:
    """Whether a tagged string is a value of its kind once the disguise is undone."""
    if kind == 0:
        return bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", s, count=1)))) and len(_AT.findall(s)) == 1
    if kind == 1:
        return bool(_PARTS.fullmatch(s)) and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    d = digits_of(s)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1 and bool(_CARD_LIKE.fullmatch(s))
    groups = re.findall("[0-9]+", s)
    marked = s.startswith(("+", "(", "00"))
    return 9 <= len(d) <= 15 and 3 - marked <= len(groups) <= 6 and max(map(len, groups)) <= 8 and bool(_PHONE_LIKE.fullmatch(s))


_WORD = re.compile(r"\S+")
_LOOSE = ".,;:!?\"'|#$%&*"


def fitted(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The plausible span nearest to a tagged one: its ends are set to ends of words and moved by up to MOVES words, the least move first."""
    lo, hi = max(0, start - 60), min(len(text), end + 60)
    words = [m.span() for m in _WORD.finditer(text, lo, hi)]
    first = sum(b <= start for _, b in words)
    last = sum(a < end for a, _ in words) - 1
    moves = sorted(((i, j) for i in range(-MOVES, MOVES + 1) for j in range(-MOVES, MOVES + 1)), key=lambda m: (abs(m[0]) + abs(m[1]), m[0] - m[1]))
    for i, j in moves:
        x, y = first + i, last + j
        if 0 <= x <= y < len(words):
            a, b = words[x][0], words[y][1]
            for right in (_LOOSE, _LOOSE + ")"):
                s = text[a:b].rstrip(right)
                c = a + len(s) - len(s.lstrip(_LOOSE))
                if c < a + len(s) and c < end and start < a + len(s) and plausible(kind, text[c:a + len(s)]):
                    return c, a + len(s)
    return None


# characters

_PLAIN = 128
LETTER, OTHER, PAD = _PLAIN, _PLAIN + 1, _PLAIN + 2
CLASSES = _PLAIN + 3
_PLANE = 1 << 16
_CLASS = np.array([i if i < _PLAIN else LETTER if chr(i).isalpha() else OTHER for i in range(_PLANE)], np.int16)
_CLASS[65:91] = _CLASS[97:123]
_CLASS[48:58] = 48
_CLASS[9:14] = 10


def classes_of(text: str) -> np.ndarray:
    """Class of every character: letters without case, one class for digits, white space, letters beyond ASCII, and the rest."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _PLANE - 1)]


# tags: 0 outside, 1 + 2k the first character of kind k, 2 + 2k a further one

TAGS = 1 + 2 * len(KINDS)
ALLOWED = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = False
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
STARTS = np.ones(TAGS, bool)   # a window may begin inside a span


def tags_of(size: int, spans: Sequence[Span]) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for k, a, b in spans:
        if a < size and b > 0:
            out[max(a, 0):min(b, size)] = 2 + 2 * k
            if a >= 0:
                out[a] = 1 + 2 * k
    return out


# made-up spans

def _email(r: random.Random, name: str) -> str:
    local = r.choice([name, f"{name}.{r.randrange(100):02d}", f"{name}{r.randrange(10)}", f"{name[:1]}.{name}"])
    host = [r.choice(["mail", "web", "post", name[::-1] or "x", "my-site"]) + r.choice(["", str(r.randrange(10))])]
    host += r.choice([[], ["example"], ["co"]]) + [r.choice(["com", "org", "net", "de", "fr", "es"])]
    dots = [r.choice(x) for x in (["."], ["."], ["."], [" dot ", "[dot]", "(dot)", " [dot] ", " (dot) "], [" . ", "[.]", " .", ". "])]
    dot = r.choice(dots)
    at = r.choice(["@"] if dot == "." and r.random() < 0.4 else [" at ", "[at]", "(at)", " [at] ", " (at) ", "{at}", " AT ", " @ ", "＠", "[@]"])
    if dot in (" . ", " .", ". ") and at == " at ":
        at = " @ "
    return local.replace(".", dot if r.random() < 0.2 else ".") + at + dot.join(host)


def _ip(r: random.Random) -> str:
    return r.choice([".", ".", "[.]", "(.)", " . ", "[dot]", "(dot)", " dot ", " [.] "]).join(str(r.randrange(1 if r.random() < 0.2 else 256) or r.randrange(256)) for _ in range(4))


def _card(r: random.Random) -> str:
    n = r.choice([13, 15, 16, 16, 16, 16, 19])
    d = [r.randrange(10) for _ in range(n)]
    sep = r.choice(["", "", " ", "-", ".", "/", "  ", "_", " - ", " ", "–", ", "])
    return sep.join("".join(map(str, d[i:i + 4])) for i in range(0, n, 4))


def _phone(r: random.Random) -> str:
    def d(n: int) -> str:
        return "".join(str(r.randrange(10)) for _ in range(n))

    head = r.choice([f"+{r.randrange(1, 99)} ", "+1 ", "", "", f"00{r.randrange(1, 99)} ", "1-"])
    body = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"({d(3)}){d(3)}-{d(4)}",
                     f"{d(3)}/{d(3)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(7)}" if head.strip() else f"({d(3)}) {d(7)}"])
    return head + body


def _harmless(r: random.Random) -> str:
    """Numbers and words that look a little like personal data."""
    def d(n: int) -> str:
        return "".join(str(r.randrange(10)) for _ in range(n))

    return r.choice([f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", d(r.randrange(1, 12)),
                     "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), f"{d(4)}-{d(4)}", f"{d(3)}-{d(4)}", " at the dot ", f" at {d(1)}. ",
                     f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(2)} at {d(2)}", f"{d(5)}/{d(2)}", "@", " dot ", f"@{d(2)}", "a @ b", f"{d(2)}% $ {d(3)}", f"{d(25)}", f"({d(4)})", f"{d(1)}.{d(1)}. {d(2)}."])


def training_windows(contexts: Sequence[str], size: int = TRAIN_CHARS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(size, windows) classes and tags: contexts with the rules' spans, most of them with something written into them."""
    r, makers = random.Random(seed), (None, _ip, _card, _phone)
    cls, tags = np.full((size, len(contexts)), PAD, np.int64), np.zeros((size, len(contexts)), np.int8)
    for i, text in enumerate(contexts):
        # every number shaped like a card teaches the shape; the check digit is tested afterwards
        spans = [s for s in rule_spans(text) if s.kind != 2]
        spans += [Span(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19 and not any(s.start < m.end() and m.start() < s.end for s in spans)]
        at = r.randrange(4, size - 8)
        while 0 < at < len(text) and text[at - 1] not in " \n":
            at -= 1
        clear = not any(s.start < at < s.end for s in spans)
        chance = r.random()
        if chance < 0.75 and clear:
            kind = r.choice((0, 0, 1, 2, 3, 3))   # the forms of e-mail addresses and phones vary most
            names = re.findall("[A-Za-z]{2,12}", text) or ["name"]
            new = (_email(r, r.choice(names).lower()) if not kind else makers[kind](r)) if chance < 0.5 else _harmless(r)
            tail = r.choice([" ", " ", ", ", "\n", ".\n", "!! ", "? ", ") "])
            spans = [s if s.end <= at else Span(s.kind, s.start + len(new) + len(tail), s.end + len(new) + len(tail)) for s in spans]
            if chance < 0.5:
                spans.append(Span(kind, at, at + len(new)))
            text = text[:at] + new + tail + text[at:]
        text = text[:size]
        cls[:len(text), i], tags[:, i] = classes_of(text), tags_of(size, spans)
        tags[len(text):, i] = 0
    return cls, tags


def contexts_of(docs: DataFrame, sample: int = SAMPLE, size: int = TRAIN_CHARS, key: str = "doc_id", text: str = "text") -> list[str]:
    """At most `sample` windows of text: the documents of smallest hash, each at a place given by its hash or at its first digit or @ after that."""
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("length(text) > 0")
    shade = F.xxhash64(F.col("doc_id").cast("string"), F.length("text"))
    place = 1 + F.pmod(F.shiftright("shade", 8), F.greatest(F.lit(1), F.length("text") - size))
    near = place + F.greatest(F.lit(0), F.regexp_instr(F.expr("substring(text, cast(place as int), 4000)"), F.lit("[0-9]{2}|@")) - 1 - F.pmod(F.shiftright("shade", 30), F.lit(size // 2)))
    # a first cut by the hash leaves about twice the sample, so few windows are moved
    share = min(1.0, 2.0 * (sample + 20) / max(1, source.count()))
    rows = source.withColumn("shade", shade).where(F.pmod(F.xxhash64("shade"), F.lit(1_000_000)) / 1e6 <= share)
    rows = rows.withColumn("place", place).withColumn("from", F.when(F.pmod("shade", F.lit(2)) == 0, F.col("place")).otherwise(near))
    rows = rows.select(F.expr(f"substring(text, cast(`from` as int), {size})").alias("window"), "shade")
    return [r["window"] for r in rows.orderBy("shade", "window").limit(sample).collect()]


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, key: str = "doc_id", text: str = "text") -> Tagger:
    """A tagger trained on a bounded sample of the documents."""
    contexts = contexts_of(docs, sample, key=key, text=text) or [" " * TRAIN_CHARS]
    return trained([contexts[i % len(contexts)] for i in range(sample)], epochs)


def trained(contexts: Sequence[str], epochs: int = EPOCHS) -> Tagger:
    tagger = Tagger(CLASSES, HIDDEN, ALLOWED, STARTS)
    tagger.losses = tagger.train(*training_windows(contexts), epochs, BATCH, RATE)
    return tagger


# whole texts

class _Found(NamedTuple):
    kind: int
    start: int
    end: int
    score: float
    open_left: bool
    open_right: bool


def _window_spans(tags: np.ndarray, emit: np.ndarray, at: int, size: int) -> Iterator[_Found]:
    """Spans of one decoded window that begins at character `at` of a text of `size` characters."""
    n = min(len(tags), size - at)
    kind = (tags[:n].astype(np.int64) - 1) // 2   # outside becomes -1
    begins = np.flatnonzero((kind >= 0) & ((tags[:n] % 2 == 1) | (np.diff(kind, prepend=-1) != 0)))
    for a in begins.tolist():
        b = a + 1
        while b < n and kind[b] == kind[a] and tags[b] % 2 == 0:
            b += 1
        steps = np.arange(a, b)
        score = float((emit[steps, tags[a:b]] - emit[steps, 0]).sum())
        yield _Found(int(kind[a]), at + a, at + b, score, a == 0 and at > 0, b == n and at + n < size)


def reconciled(found: Sequence[_Found]) -> list[Span]:
    """Spans of a whole text from those of its windows: halves are united, then the best set without overlaps is chosen."""
    merged: list[_Found] = []
    for f in sorted(found, key=lambda f: (f.kind, f.start, f.end)):
        if merged and (m := merged[-1]).kind == f.kind and f.start <= m.end and (m.open_right or f.open_left or (m.start, m.end) == (f.start, f.end)):
            right = f if f.end >= m.end else m
            merged[-1] = _Found(f.kind, m.start, max(m.end, f.end), max(m.score, f.score), m.open_left, right.open_right and f.open_right)
        else:
            merged.append(f)
    merged = sorted((f for f in merged if f.score >= LEAST_SCORE), key=lambda f: (f.end, f.start, f.kind))
    ends, best, last = [], [(0.0, ())], []
    for f in merged:
        before = int(np.searchsorted(ends, f.start, side="right"))
        take = (best[before][0] + f.score, (before, f))
        best.append(take if take[0] > best[-1][0] else (best[-1][0], ()))
        ends.append(f.end)
    k = len(merged)
    while k:
        if best[k][1]:
            k, f = best[k][1]
            last.append(Span(f.kind, f.start, f.end))
        else:
            k -= 1
    return last[::-1]


def tagged_spans(texts: Sequence[str | None], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans of whole texts."""
    found: list[list[_Found]] = [[] for _ in texts]
    owner, places, windows = [], [], []

    def flush() -> None:
        if not windows:
            return
        cls = np.full((WINDOW, len(windows)), PAD, np.intp)
        longest = 0
        for i, w in enumerate(windows):
            cls[:len(w), i] = w
            longest = max(longest, len(w))
        emit = tagger.emissions(cls[:longest + 1])
        some = np.flatnonzero(~tagger.surely_outside(emit))
        if len(some):
            part = np.ascontiguousarray(emit[:, :, some])
            tags = tagger.decode(part)
            for j in np.flatnonzero(tags.any(axis=0)).tolist():
                d = owner[some[j]]
                found[d].extend(_window_spans(tags[:, j], part[:, :, j], places[some[j]], len(texts[d])))
        owner.clear(), places.clear(), windows.clear()

    for d in sorted(range(len(texts)), key=lambda d: len(texts[d] or "")):   # short texts together
        text = texts[d] or ""
        for at in range(0, max(len(text) - OVERLAP, 1 if text else 0), WINDOW - OVERLAP):
            owner.append(d)
            places.append(at)
            windows.append(classes_of(text[at:at + WINDOW]))
            if len(windows) == STEP_WINDOWS:
                flush()
    flush()
    return [reconciled(f) if f else [] for f in found]


def all_spans(text: str, base: list[Span], tagged: Sequence[Span]) -> list[Span]:
    """The rules' spans and those of the tagger that are plausible and touch none of them; by kind, then start."""
    new = []
    for k, start, end in tagged:
        found = fitted(k, text, start, end) if not any(start < s.end and s.start < end for s in base if s.kind == k) else None
        if k == 2 and not found and text[start:end].lstrip(_LOOSE + " ").startswith(("+", "(", "00")):   # a number that fails as a card may be a phone's
            k, found = 3, fitted(3, text, start, end)
        if found and not any(found[0] < s.end and s.start < found[1] for s in [*base, *new]):
            new.append(Span(k, *found))
    return sorted([*base, *new], key=lambda s: (s.kind, s.start))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, by_rule: boolean>>"


def private_spans(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of a text in code points, by kind, then start."""
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_rule", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(one))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = texts_of(b.column(1)), []
            for t, tagged in zip(texts, tagged_spans(texts, tagger), strict=True):
                base = rule_spans(t or "")
                out.append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "by_rule": s in base} for s in all_spans(t or "", base, tagged)])
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(one))], schema=schema)

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def op12_pii_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts by kind and a digest of the rules' spans, and all spans."""
    docs = read(spark, sf_dir, "documents")
    return digests(private_spans(docs, fit(docs)))


def digests(found: DataFrame) -> DataFrame:
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["by_rule"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS),
                        F.size(F.filter("spans", lambda s: ~s["by_rule"])).cast("bigint").alias("n_added"),
                        F.sha2(written(F.filter("spans", lambda s: s["by_rule"])).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
