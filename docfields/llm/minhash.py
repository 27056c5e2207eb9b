"""Near-duplicates by MinHash: hash minima, banding, verification, components.

A document is the set of its distinct word shingles. Equal sets fall into one
class first, by digest; the rest works on one document per class. BANDS keys
of ROWS minima each put similar classes into common buckets (at a similarity
of 0.8 a pair misses all of them once in eight million). Within a bucket not
all pairs are taken:

1. each member is compared with the bucket's pivot, the smallest id;
2. in buckets that still hold several components, members outside the largest
   one are compared with another of its members, until that finds no more or
   next to nothing; a pivot that has met all others, and a bucket of one
   component, are settled and go;
3. members of buckets that hold several components still are joined exactly: a
   link needs a common shingle early in both sets' rare-first order (the prefix
   filter), so only members of different components that have one are compared.

So two members of a bucket end in one component, have been compared, or cannot
be linked; a large group of near copies costs a few comparisons per member, as
what sets its members apart is rare. A comparison is
the agreement of signatures (far below the threshold: no link) and then the
exact intersection of the full sets.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import arrow_map, dropped, prepare, renamed, saved, slices
from docfields.llm.components import connected_components

BANDS, ROWS = 40, 5
#: Signatures must agree in so many of their minima; pairs at 0.8 do in 160 of
#: 200 with a deviation of 6, so none in a billion is lost.
SIGNATURE_LEAST = 0.6
SEED = 7
#: Rounds of pivots at most, and pairs a link of a round that is not the last; the rest is joined.
ROUNDS, PAIRS_A_LINK = 20, 100
#: Slots in which shingles are counted.
SLOTS = 1 << 20


@lru_cache(1)
def hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (splitmix64; its constants are fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; A-Z in lower case,
    words between ASCII white space; fewer words make one shingle, none no set."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j:j + n])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all sets (none empty), one row each."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    for i, (a, b) in enumerate(zip(*hash_parameters(), strict=True)):
        out[i] = np.minimum.reduceat(x * a + b, starts)
    return out.T


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), 1))
    for j in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, j::ROWS][:, :BANDS].astype(np.uint64))
    return h.view(np.int64)


def fingerprint(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest, keys, signature`` of every row; the last
    three are null for empty sets."""
    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            sets = [shingles(t, k) for t in texts[a:b]]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, keys, marks = ([None] * len(sets) for _ in range(3))
            if full:
                minima = signatures([sets[i] for i in full])
                low = mixed(minima.astype(np.uint64)).astype(np.uint8)
                for i, key, mark in zip(full, band_keys(minima), low, strict=True):
                    digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    keys[i], marks[i] = key, mark.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "signature"])

    return arrow_map(docs, run, "doc_id long, n_shingles long, digest binary, keys array<long>, signature binary")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            sets = [shingles(t, k) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()),
                                          pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "set"])

    return arrow_map(docs, run, "id long, set array<long>")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (``a, b, of_a, of_b``) whose signatures agree often enough."""
    def run(batch: pa.RecordBatch):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
        yield batch.select([0, 1, 2, 3]).filter(pa.array((a == b).mean(axis=1) >= SIGNATURE_LEAST))

    return arrow_map(pairs.select("a", "b", "of_a", "of_b", "mark_a", "mark_b"), run, "a long, b long, of_a long, of_b long")


class Comparison:
    """Verifies pairs of ids on signatures and full sets."""

    def __init__(self, marks: DataFrame, sets: DataFrame, percent: int):
        self.marks, self.sets, self.percent = marks, sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """``u, v``: the components (``of_a``, ``of_b``) of the linked ones of
        ``pairs`` (``a``: many, ``b``: pivot)."""
        m, s = self.marks, self.sets
        marked = (pairs.join(m.select(F.col("id").alias("a"), F.col("signature").alias("mark_a")), "a")
                       .join(m.select(F.col("id").alias("b"), F.col("signature").alias("mark_b")), "b"))
        near = saved(agreeing(marked), "minhash-near")
        full = (near.join(s.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
                    .join(s.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"))
        out = saved(overlapping(full, self.percent).select(F.col("of_a").alias("u"), F.col("of_b").alias("v")).distinct(), "minhash-links")
        dropped(near)
        return out


def overlapping(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap by ``percent`` of their union. Sets are
    sorted, so the common shingles of a pair are found by one search."""
    def run(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select([2, 3]).filter(pa.array(keep))

    return arrow_map(pairs.select("a", "b", "of_a", "of_b", "set_a", "set_b"), run, "of_a long, of_b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked whose sets of ``k``-word shingles overlap by at least
    ``percent`` per cent of their union; ``component_id`` is the smallest id
    reachable, ``kept`` marks the document of that id. Empty sets (null or
    blank texts) link with nothing. Rows that repeat an id belong to one
    component. Rows without an id take no part: no component, kept. An empty
    table gives no rows; other columns are not looked at. Ids are whole numbers.
    """
    spark = prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = saved(fingerprint(src, k), "minhash-prints")
    known = prints.where("doc_id is not null and digest is not null")

    # classes of equal sets, each named by its smallest id
    classes = saved(known.groupBy("digest").agg(F.min("doc_id").alias("id")), "minhash-classes")
    member_of = saved(known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "id"), "minhash-members")

    # buckets with more than one class; a class goes by its first document
    again = saved(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "minhash-again")
    repeated = bool(again.head(1))
    firsts = member_of.where("doc_id = id").select("doc_id").distinct()
    reps = known.join(firsts, "doc_id", "left_semi")
    if repeated:  # rows that share an id: each text of it once
        reps = reps.dropDuplicates(["doc_id", "digest"])
    reps = saved(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "keys", "signature"), "minhash-firsts")
    counts = saved(prints.select("doc_id", "n_shingles"), "minhash-counts")
    dropped(prints, classes)
    wide = reps.select("id", "n", F.explode("keys").alias("key"))
    shared = saved(wide.groupBy("key").agg(F.min("id").alias("b"), F.min_by("n", "id").alias("m"), F.max("id").alias("last"))
                       .where("b < last").select("key", "b", "m"), "minhash-shared")
    split = saved(wide.join(shared, "key").select("key", "id", "n", F.col("id").alias("component"), "b", "m"), "minhash-split")
    size = split.count()
    dropped(shared)

    involved = saved(split.select("id").distinct(), "minhash-ids", size)
    texts = src.join(involved, src["doc_id"] == involved["id"], "left_semi")
    if repeated:
        texts = texts.join(again, "doc_id", "left_anti").union(texts.join(again, "doc_id", "left_semi").distinct())
    compare = Comparison(saved(reps.select("id", "signature").join(involved, "id", "left_semi"), "minhash-marks"),
                         saved(shingle_sets(texts, k), "minhash-sets"), percent)
    dropped(reps, involved)

    # every member of a bucket with its pivot; components grow, and what may still hold a link shrinks
    merges, done = [], []
    written, split = split, split.select("*", F.col("b").alias("top"))
    for seed in range(ROUNDS):
        pairs = split.where((F.col("component") != F.col("top")) & _alike("n", "m", percent))
        pairs = pairs.select(F.col("id").alias("a"), "b", F.col("component").alias("of_a"), F.col("top").alias("of_b"))
        pairs = pairs.dropDuplicates(["a", "b"])
        if done:
            pairs = pairs.join(reduce(DataFrame.union, [p.select("a", "b") for p in done]), ["a", "b"], "left_anti")
        pairs = saved(pairs, "minhash-pairs", size)
        done.append(pairs)
        links = compare.links(pairs)
        found = links.count()
        if found:
            merges.append(connected_components(links))
        dropped(links)
        now = _members(split, merges[-1] if found else None, size)
        split = saved(_unsettled(now, seed), "minhash-split", size)
        dropped(written, now)
        written = split
        # a round that finds little would name every member again for the next to find less
        if not found or PAIRS_A_LINK * found < pairs.count() or not split.head(1):
            break
    dropped(*done)
    if split.head(1):
        rare = saved(_rare_shingles(compare.sets, split, percent), "minhash-rare")
        pairs = saved(_rare_pairs(rare, split, percent), "minhash-rare-pairs")
        links = compare.links(pairs)
        if links.head(1):
            merges.append(connected_components(links))
        dropped(rare, pairs, links)
    dropped(split, compare.marks, compare.sets)

    named = member_of.distinct()
    if merges:  # the rounds' components put together first, so that documents are named once
        if len(merges) > 1:
            merges.append(connected_components(reduce(DataFrame.union, [m.select(F.col("node").alias("u"), F.col("component").alias("v")) for m in merges])))
        merged = merges[-1]
        named = (named.join(merged, named["id"] == merged["node"], "left")
                      .select("doc_id", F.coalesce("component", "id").alias("id")))
    named = saved(named.groupBy("doc_id").agg(F.min("id").alias("component_id")), "minhash-named")
    dropped(member_of, again, *merges)  # what is left is what the result reads
    result = counts.join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _members(split: DataFrame, merged: DataFrame | None, size: int) -> DataFrame:
    """Members of buckets (``key, id, n, component``) after a round: without the
    last pivots, of which all is known, and under their new components, if any."""
    left = split.where("id != b").select("key", "id", "n", "component")
    if merged is None:
        return left
    # a member is named once, whatever the number of its buckets, and written once, as its buckets are read twice
    members = left.groupBy("id", "n", "component").agg(F.collect_list("key").alias("keys"))
    now = (members.join(merged, members["component"] == merged["node"], "left")
                  .select("id", "n", F.coalesce(merged["component"], members["component"]).alias("component"), "keys"))
    return saved(now.select(F.explode("keys").alias("key"), "id", "n", "component"), "minhash-now", size)


def _unsettled(now: DataFrame, seed: int) -> DataFrame:
    """The members ``now`` without buckets that hold one component. Each with
    the next pivot of its bucket, a member of the largest component (``b``, its
    size ``m``, its component ``top``)."""
    order = F.xxhash64("id", F.lit(seed))
    held = now.groupBy("key", "component").agg(F.count("*").alias("size"), F.min_by("id", order).alias("b"), F.min_by("n", order).alias("m"))
    tops = held.groupBy("key").agg(F.max(F.struct("size", "component", "b", "m")).alias("t"), F.count("*").alias("held")).where("held > 1")
    return now.join(tops, "key").select("key", "id", "n", "component", "t.b", "t.m", F.col("t.component").alias("top"))


def _rare_shingles(sets: DataFrame, split: DataFrame, percent: int) -> DataFrame:
    """``key, id, n, left``: the rarest shingles of each member of ``split``, as
    many as a link cannot miss, each with the number of shingles from it on.

    Any fixed order of shingles would do; rare first makes the buckets small.
    How frequent they are is counted in SLOTS slots, one array of fixed size.
    """
    spark = sets.sparkSession
    chosen = sets.join(saved(split.select("id").distinct(), "minhash-rest"), "id", "left_semi")
    found = (chosen.select(F.explode("set").alias("t")).groupBy(F.pmod("t", F.lit(SLOTS)).alias("slot"))
                   .agg(F.count("*").alias("n")).toArrow())
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def run(batch: pa.RecordBatch):
        keys, ids, sizes, left = [], [], [], []
        for i, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = one.values.to_numpy()
            n = len(t)
            most = n - -(-percent * n // 100) + 1
            rare = t[np.lexsort((t, shared.value[t % SLOTS]))[:most]]
            keys.append(rare)
            ids += [i] * len(rare)
            sizes += [n] * len(rare)
            left += range(n, n - len(rare), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(c, pa.int64()) for c in (ids, sizes, left))],
                                         names=["key", "id", "n", "left"])

    return arrow_map(chosen, run, "key long, id long, n long, left long")


def _alike(n: str, m: str, percent: int):
    """Whether sets of these sizes can overlap enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _rare_pairs(rare: DataFrame, split: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that a link cannot be told from yet.

    Sets of n and m shingles that overlap by ``percent`` of their union have at
    least percent / (100 + percent) of n + m in common. Their first common
    shingle in the rare-first order is followed, in either set, by all the
    others, so at least that many must be left from it on. Components are paired
    per shingle first, by their extremes; members of one never meet each other.
    """
    named = rare.join(split.select("id", "component").distinct(), "id")
    named = saved(named, "minhash-named-rare")
    held = named.groupBy("key", "component").agg(F.min("n").alias("lo"), F.max("left").alias("left"))
    several = held.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    several = saved(several.select("key"), "minhash-several")
    held = saved(held.join(several, "key"), "minhash-held")

    def enough(n: str, m: str, left_n: str, left_m: str):
        common = percent * (F.col(n) + F.col(m))
        return (((100 + percent) * F.col(left_n) >= common) & ((100 + percent) * F.col(left_m) >= common))

    def side(df: DataFrame, k: int, *columns: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{c}{k}") for c in columns])

    apart = (side(held, 1, "component", "lo", "left").join(side(held, 2, "component", "lo", "left"), "key")
             .where((F.col("component1") < F.col("component2")) & enough("lo1", "lo2", "left1", "left2"))
             .select("key", "component1", "component2", "lo1", "left1", "lo2", "left2"))
    apart = saved(apart, "minhash-apart")
    # members that may link with the best of the other component, then with each other
    members = named.join(several, "key")
    first, second = (side(members, k, "component", "id", "n", "left").withColumnRenamed(f"left{k}", f"from{k}") for k in (1, 2))
    ones = (apart.join(first, ["key", "component1"]).where(enough("n1", "lo2", "from1", "left2"))
                 .select("key", "component2", "component1", "id1", "n1", "from1"))
    return (ones.join(second, ["key", "component2"])
                 .where(_alike("n1", "n2", percent) & enough("n1", "n2", "from1", "from2"))
                 .select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("component1").alias("of_a"), F.col("component2").alias("of_b"))
                 .dropDuplicates(["a", "b"]))
