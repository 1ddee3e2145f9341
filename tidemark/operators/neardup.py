"""Near-duplicate suppression of syndicated items.

Similarity depends only on two texts, so it is decided once per pair of distinct texts (text
classes), not per cutoff. Exact copies share a class and never form pairs. Candidate pairs come
from a prefix of each text: two sets with Jaccard ≥ 0.85 must share one of their first
|x| − ⌈0.85·|x|⌉ + 1 shingles in any common order. In the order taken here frequent shingles come last, so they are joined on only where a text has few others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import CANDIDATE_LIMIT, JACCARD_MIN, SIMILAR_WITHIN_S
from tidemark.functions.text import bind, words
from tidemark.functions.timing import seconds_between
from tidemark.operators.slotspans import groups_of
from tidemark.session import cut_lineage, small_side, spread

HOT = 32             #: texts that may share a prefix shingle before it counts as frequent
HOT_LIMIT = 200_000  #: frequent shingles that tasks are told of
HOT_ROUNDS = 8
HOT_OF_TASK = 25_000  #: frequent shingles that a task names before the first round
SKETCH = 1 << 20     #: shingles a task counts at once to find them
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 1_000   #: of a block of similar texts that are compared
BIN_SHINGLES = 1 << 18   #: of small groups that share a task
SHARED_BITS = 1 << 27   #: bits that tell tasks which shingles are shared


def shingles(title: Column | str) -> Column:
    """Distinct three-word runs as 64-bit hashes; empty for fewer than three words."""
    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(2), F.greatest(F.size(w) - 1, F.lit(2))), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))
    return bind(words(title), runs)


def text_classes(items: DataFrame, body: str | None = None) -> DataFrame:
    """record_id, class_id, shingles, n. Records with equal shingle sets share a class.

    class_id is NULL for texts too short to match anything. `body` names the whole text; without it the title counts.
    """
    d = spread(items.select("record_id", F.coalesce(body or "title").alias("body"))).select(
        "record_id", F.array_sort(shingles("body")).alias("shingles"))
    n = F.size("shingles")
    return d.withColumn("n", n).withColumn(
        "class_id", F.when(n > 0, F.unhex(F.md5(F.array_join(F.transform("shingles", lambda x: x.cast("string")), ",")))))


def places_of(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, place): asset, status and stretch of time in which a text occurs. Two records that may suppress each other share a place:
    the stretches are as long as the rule reaches, and each record is listed in its own and the next one."""
    stretch = F.floor(F.unix_micros("source_observed_at") / (SIMILAR_WITHIN_S * 1000000)).cast("bigint")
    d = items.join(classes.where("class_id IS NOT NULL").select("record_id", "class_id"), "record_id")
    return d.withColumn("_b", F.explode(F.array(stretch, stretch + 1))).select(
        "class_id", F.xxhash64("asset", F.coalesce("status", F.lit("")), "_b").alias("place")).distinct()


def one_per_class(classes: DataFrame) -> DataFrame:
    """class_id, shingles, n: one record of every class. Only the ids of copies are compared, their shingles are not shuffled."""
    known = classes.where("class_id IS NOT NULL")
    ids = known.select("class_id", "record_id")
    first = ids.groupBy("class_id").agg(F.min("record_id").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    copies = cut_lineage(ids.join(first, "class_id").where("record_id <> _first").select("class_id", "record_id").distinct())
    return known.join(small_side(copies), ["class_id", "record_id"], "left_anti").select("class_id", "shingles", "n")


def rare_first(hot: np.ndarray, shared: np.ndarray | None = None) -> Callable[[Column, Column], Column]:
    """The first `keep` of sorted shingles, those of `hot` put last; with `shared` (shared_bits) without those that no bit is set for."""
    def cut(sets: pa.Array, keep: pa.Array) -> pa.Array:
        flat, edges, keep = sets.flatten().to_numpy(zero_copy_only=False), sets.offsets.to_numpy(), keep.to_numpy()
        edges = edges - edges[0]
        row = np.repeat(np.arange(len(keep)), np.diff(edges))
        late = np.zeros(len(flat), bool)
        if len(hot):
            late = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat
        order = np.lexsort((late, row))   # stable: by row, rare ones first, then as they were
        taken = order[np.arange(len(flat)) - edges[row] < keep[row]]
        if shared is not None:
            bit = flat[taken] & (SHARED_BITS - 1)
            taken = taken[(shared[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        ends = np.cumsum(np.bincount(row[taken], minlength=len(keep)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat[taken]))

    if shared is None and not len(hot):
        return lambda sets, keep: F.slice(sets, F.lit(1), keep)
    return F.arrow_udf(cut, T.ArrayType(T.LongType()))


def shared_bits(keys: DataFrame) -> np.ndarray:
    """Bits that are set for the last bits of every shingle of a frame (h). Their number is fixed, so a task gets the same 16 MB whatever the tables hold."""
    bit = F.col("h").bitwiseAND(SHARED_BITS - 1) + 1
    set_ = keys.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).repartition("b")
    set_ = set_.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    out = np.zeros((SHARED_BITS >> 15, 1 << 12), np.uint8)
    for b, bits in zip(set_["b"].to_pylist(), set_["bits"].to_pylist(), strict=True):
        out[b - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def often_in_tasks(sets: DataFrame) -> DataFrame:
    """(s, f): shingles that tasks met several times in whole texts, HOT_OF_TASK of a task at most, with the number of times. A task that has SKETCH shingles in hand
    forgets those met once. This is a first guess of what is frequent; it settles an order of shingles, in which no text or shingle is left out."""
    schema = pa.schema([("s", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, f, held = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([s, *held])
            keys, at = np.unique(every, return_inverse=True)
            return keys, np.bincount(at, np.concatenate([f, np.ones(len(every) - len(s))]), len(keys)).astype(np.int64)

        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, held)) > SKETCH:
                s, f = merged()
                top = np.argsort(-f, kind="stable")[:min(SKETCH // 4, int((f > 1).sum()))]
                s, f, held = s[top], f[top], []
        s, f = merged()
        top = np.argsort(-f, kind="stable")[:min(HOT_OF_TASK, int((f > 1).sum()))]
        yield pa.record_batch([pa.array(s[top]), pa.array(f[top])], schema=schema)

    return sets.select("shingles").mapInArrow(run, "s bigint, f bigint")


def prefix_size(n: Column, threshold: float) -> Column:
    return (n - F.ceil(n * F.lit(threshold - 1e-9)) + 1).cast("int")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(class_id, n, s): the prefix shingles that two texts or more hold in their prefixes, and a few that only one text holds.

    Prefixes hold under any common order. Here it is the hash, with frequent shingles last: those that tasks meet often in whole texts, then those found in more
    than HOT prefixes move to the end and the prefixes are taken anew, until few pairs come from frequent ones. Prefixes are counted by 31 bits of their shingles,
    and those of one text are left out by bits (shared_bits) where they are read. What looks shared by chance costs a row and changes no pair. How many
    shingles move (HOT_LIMIT, HOT_ROUNDS) decides the number of candidates, not the pairs.
    """
    keep, short = prefix_size(F.col("n"), threshold), F.col("s").bitwiseAND(0x7FFFFFFF).cast("int")

    def postings(shared: np.ndarray | None = None) -> DataFrame:
        return sets.select("class_id", "n", F.explode(rare_first(hot, shared)(F.col("shingles"), keep)).alias("s"))

    guess = often_in_tasks(sets).groupBy("s").agg(F.sum("f").alias("f")).where(F.col("f") > HOT)
    hot = np.unique(guess.orderBy(F.col("f").desc(), "s").limit(HOT_LIMIT).select("s").toArrow()["s"].to_numpy())
    for left in range(HOT_ROUNDS, 0, -1):
        shared = cut_lineage(postings().groupBy(short.alias("h")).agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
        work = shared.agg(F.sum("f").alias("all"), F.sum(F.when(F.col("f") > HOT, F.col("f") * F.col("f"))).alias("often")).first()
        if left == 1 or (work["often"] or 0) <= HOT * (work["all"] or 0):
            break
        often = shared.where(F.col("f") > HOT).orderBy(F.col("f").desc(), "h").limit(HOT_LIMIT).select("h")
        often = postings().join(F.broadcast(often), short == F.col("h"), "left_semi").select("s").distinct().limit(HOT_LIMIT + 1).toArrow()["s"].to_numpy()
        fresh = np.setdiff1d(often, hot)
        if not len(fresh) or len(hot) + len(fresh) > HOT_LIMIT:
            break
        hot = np.union1d(hot, fresh)
    return postings(shared_bits(shared))


def listed(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a class id is one of a frame (class_id), or looks like one by bits of fixed size."""
    bits = shared_bits(keys.select(F.xxhash64("class_id").alias("h")))

    def test(h: pa.Array) -> pa.Array:
        bit = h.to_numpy(zero_copy_only=False) & (8 * len(bits) - 1)
        return pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)

    named = F.arrow_udf(test, T.BooleanType()).asNondeterministic()   # a column of its own: Spark may move a filter that calls Python where it can't be run
    return lambda c: named(F.xxhash64(c))


def compared(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(class_id, other_id, jaccard) of the candidates (class_id, other_id, n, m) at or above the threshold, by their whole sets.

    A set goes to the others of its connected group once, not once a pair. Small groups share a task; a group of more than BLOCK_SHINGLES or BLOCK_TEXTS is cut into
    blocks by a hash, and a task holds two of them.
    """
    ends = F.explode(F.array(F.struct("class_id", "n"), F.struct(F.col("other_id").alias("class_id"), F.col("m").alias("n"))))
    involved = candidates.select(ends.alias("e")).select("e.*").distinct()
    back = candidates.select(F.col("other_id").alias("class_id"), F.col("class_id").alias("other_id"))
    groups = groups_of(candidates.select("class_id", "other_id").unionByName(back), "class_id", "other_id")
    place = involved.join(groups.withColumnRenamed("member", "class_id"), "class_id")
    size = F.sum("n").cast("bigint")
    blocks = place.groupBy("group").agg(F.greatest(F.ceil(size / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("blocks"))
    place = cut_lineage(place.join(blocks, "group"))
    bins = max(1, -(-(place.where("blocks = 1").agg(size).first()[0] or 0) // BIN_SHINGLES))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.xxhash64("group"))
    place = place.select("class_id", cell.alias("cell"), "blocks", F.pmod(F.xxhash64("class_id"), "blocks").cast("int").alias("mine"))
    theirs = place.select(F.col("class_id").alias("other_id"), F.col("mine").alias("its"))
    pairs = candidates.join(place, "class_id").join(theirs, "other_id")
    pairs = pairs.select("cell", F.least("mine", "its").alias("lo"), F.greatest("mine", "its").alias("hi"), "class_id", "other_id")
    held = sets.select("class_id", "shingles").withColumn("_listed", listed(place)(F.col("class_id"))).where("_listed").drop("_listed")
    held = held.join(small_side(place), "class_id")
    held = held.withColumn("its", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select(F.col("cell").alias("at"), F.least("mine", "its").alias("from"), F.greatest("mine", "its").alias("to"), F.col("class_id").alias("id"), "shingles")
    schema = pa.schema([("class_id", pa.binary()), ("other_id", pa.binary()), ("jaccard", pa.float64())])

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        if not len(pairs):
            return schema.empty_table()
        lists = held["shingles"].combine_chunks()
        flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        of = {c: flat[lo:hi] for c, lo, hi in zip(held["id"].to_pylist(), edges, edges[1:], strict=False)}
        out = []
        for a, b in zip(pairs["class_id"].to_pylist(), pairs["other_id"].to_pylist(), strict=True):
            common = len(np.intersect1d(of[a], of[b], assume_unique=True))
            alike = common / (len(of[a]) + len(of[b]) - common)
            if alike >= threshold:
                out.append((a, b, alike))
        return pa.table([pa.array([x[i] for x in out], schema.types[i]) for i in range(3)], schema=schema)

    both = pairs.groupBy("cell", "lo", "hi").cogroup(held.groupBy("at", "from", "to"))
    return both.applyInArrow(run, "class_id binary, other_id binary, jaccard double")


def similar_pairs(classes: DataFrame, threshold: float = JACCARD_MIN, places: DataFrame | None = None) -> DataFrame:
    """Symmetric pairs (class_id, other_id, jaccard) of different texts at or above the threshold; with `places` only those that share one,
    so that candidates grow with what is written within the reach of the rule, not with all history.

    `classes` is read several times, so it should be a checkpoint. Shuffled are prefixes and the texts of candidates, not all shingles."""
    sets = one_per_class(classes)
    prefix, meet = prefixes(sets, threshold), ["s"]
    if places is not None:
        prefix, meet = prefix.join(places, "class_id"), ["s", "place"]
    prefix = cut_lineage(prefix)
    other = prefix.select(F.col("class_id").alias("other_id"), F.col("n").alias("m"), *meet)
    met = prefix.join(other, meet).where(
        (F.col("class_id") < F.col("other_id")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold - 1e-9)))
    # up to the end of the prefix that ends first all common shingles are in both prefixes; beyond it there are at most as many as that text has left
    rest = F.greatest(F.col("n") - prefix_size(F.col("n"), threshold), F.col("m") - prefix_size(F.col("m"), threshold))
    least = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-6
    shared = met.groupBy("class_id", "other_id", "n", "m", *meet[1:]).agg(F.countDistinct("s").alias("c"))
    candidates = cut_lineage(shared.where(F.col("c") + rest >= least).select("class_id", "other_id", "n", "m").distinct())
    one_way = cut_lineage(compared(candidates, sets, threshold))
    return one_way.unionByName(one_way.select(
        F.col("other_id").alias("class_id"), F.col("class_id").alias("other_id"), "jaccard"))


def suppress_near_duplicates(events: DataFrame, similar: DataFrame, slot: list[str]) -> DataFrame:
    """Add `kept`: an event is dropped when a kept earlier event of the same slot and status is
    similar and was observed at most 48 hours apart. Order: (available_at, event_id).

    Rounds work on the first undecided event of each (slot, status, text class). It is kept when
    no similar class has an earlier undecided first event; kept events then drop what follows
    them. Copies are only ever compared with kept events, so a class of any size costs one row
    per copy and round.
    """
    group = [*slot, "_status", "class_id"]
    order = F.struct("available_at", "event_id")
    d = cut_lineage(events.withColumn("_status", F.coalesce("status", F.lit(""))))
    pairs = similar.select("class_id", "other_id")

    sizes = d.where("class_id IS NOT NULL").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    partner = sizes.select(*slot, "_status", F.col("class_id").alias("other_id"))
    linked = (sizes.join(pairs, "class_id").join(partner, [*slot, "_status", "other_id"], "left_semi")
              .select(*group))
    contested = sizes.where("_n > 1").select(*group).unionByName(linked).distinct()
    # state of the contested events: 0 undecided, 1 kept, 2 dropped
    states = cut_lineage(
        d.join(contested, group, "left_semi")
        .select(*group, "event_id", "available_at", "source_observed_at", F.lit(0).alias("_state")))
    while not states.where("_state = 0").isEmpty():
        states = cut_lineage(_one_round(states, pairs, slot, group))
    dropped = states.where("_state = 2").select(*slot, "event_id", F.lit(True).alias("_drop"))
    return (d.join(dropped, [*slot, "event_id"], "left")
            .withColumn("kept", F.col("_drop").isNull()).drop("_drop", "_status"))


def _one_round(states: DataFrame, pairs: DataFrame, slot: list[str], group: list[str]) -> DataFrame:
    """Decide the first undecided event of every group that no earlier rival can drop."""
    order = F.struct("available_at", "event_id")
    head = F.struct("h.available_at", "h.event_id")
    open_ = states.where("_state = 0")
    heads = open_.groupBy(*group).agg(
        F.min_by(F.struct("available_at", "event_id", "source_observed_at"), order).alias("h"))
    rival = heads.select(*slot, "_status", F.col("class_id").alias("other_id"), head.alias("_r"))
    blocked = (heads.join(pairs, "class_id").join(rival, [*slot, "_status", "other_id"])
               .where(F.col("_r") < head).select(*group).distinct())
    winners = heads.join(blocked, group, "left_anti")
    reach = winners.select(*group, "h").unionByName(
        winners.join(pairs, "class_id").select(*slot, "_status", F.col("other_id").alias("class_id"), "h"))
    decided = (open_.join(reach, group)
               .where((head == order) | (
                   (head < order)
                   & (F.abs(seconds_between("h.source_observed_at", "source_observed_at")) <= SIMILAR_WITHIN_S)))
               .groupBy(*slot, "event_id").agg(F.max(F.when(head == order, 1).otherwise(2)).alias("_new")))
    return (states.join(decided, [*slot, "event_id"], "left")
            .withColumn("_state", F.coalesce("_new", "_state")).select(states.columns))


def over_candidate_limit(judged: DataFrame, classes: DataFrame, slot: list[str],
                         limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Slots in which some event shares a shingle with more than `limit` kept earlier events.

    Only slots with more than `limit` kept events can qualify. A shingle in more than limit + 1
    kept events decides its slot by a count alone. In what remains every posting holds at most
    limit + 1 events, so the exact count joins a bounded number of rows per event and shingle.
    """
    kept = judged.where("kept AND class_id IS NOT NULL")
    large = kept.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*slot)
    text = classes.where("class_id IS NOT NULL").groupBy("class_id").agg(F.first("shingles").alias("shingles"))
    posted = (judged.where("class_id IS NOT NULL").join(large, slot, "left_semi").join(text, "class_id")
              .select(*slot, "event_id", "available_at", "kept", F.explode("shingles").alias("s")))
    held = posted.where("kept")
    by_count = (held.groupBy(*slot, "s").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > limit + 1).select(*slot).distinct())
    rest = posted.join(by_count, slot, "left_anti")
    prior = rest.where("kept").select(*slot, "s", F.col("event_id").alias("p_id"),
                                      F.col("available_at").alias("p_at"))
    exact = (rest.join(prior, [*slot, "s"])
             .where(F.struct("p_at", "p_id") < F.struct("available_at", "event_id"))
             .groupBy(*slot, "event_id").agg(F.countDistinct("p_id").alias("n"))
             .where(F.col("n") > limit).select(*slot).distinct())
    return by_count.unionByName(exact).distinct()
