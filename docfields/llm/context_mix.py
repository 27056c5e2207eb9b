"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a stream of bytes: its words (A-Z in lower case) parted by one space,
then an end byte. Bytes are coded in bits by a prefix code for each byte before and
class of the byte before that, made from their counts, so likely bytes take few
decisions. Every bit is
predicted by several predictors, each of which looks up a hash of its context
(the last 3, 5 or 7 bytes) and of the place in the code.
Predictions are mixed as log odds: a gate (the longest context that has been seen,
and the depth in the code) picks the weights. The mix is refined by an adaptive map
from gate and mixed odds to the odds found there. The sum over the bits of
a text gives its probability, and its bits per byte.

Learning gathers, from all training documents:

1. counts of words, and of bytes after bytes;
2. bit counts of all contexts in tables of fixed size. A task adds up its own
   tables and sends compressed chunks; tasks that own the chunks add them up as
   they stream in;
3. on one part in six of the training documents, which the tables leave out,
   each task learns the weights online, bit block by bit block, and the map; the
   weights are averaged by the bits seen.

While a document is scored its own copy of the weights goes on learning, block
by block, from the bits already scored; a document starts from the model, so its
score depends on its text and the model alone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import arrow_map, prepare, renamed, saved

#: Predictors: bytes of context, ascending, and the bits of the table's size.
CONTEXTS = ((3, 22), (5, 22), (7, 22))
#: Slots next to each other that the bits of one context share: they stand in one line of a cache.
REGION = 64
#: Slots of a chunk of the tables (a chunk never spans two tables).
CHUNK = 1 << 14
#: What is added to both counts of a slot.
PRIOR = 0.4
#: Log odds are kept in steps of 1 / ODDS in a byte; UNSEEN marks a slot without counts.
ODDS, UNSEEN = 16, -128
#: Log odds by the byte that keeps them.
KEPT_ODDS = np.concatenate([np.arange(128), [0], np.arange(-127, 0)]).astype(np.float32) / ODDS
#: Depths of the code that gates tell apart, and gates.
DEPTHS = 6
GATES = (len(CONTEXTS) + 1) * DEPTHS
#: Buckets of mixed log odds in the adaptive map, from -LIMIT to LIMIT.
BUCKETS, LIMIT = 65, np.float32(8)
STEPS = np.float32((BUCKETS - 1) / (2 * LIMIT))
#: Least probability of a bit.
LEAST = np.float32(1 / 65536)
#: Steps of learning: while training (adaptive) and within a document.
RATE, OWN_RATE = 0.02, 0.002
#: Bytes worked on at a time (what fits a core's cache), while learning and while
#: scoring, and documents at most.
SEGMENT, SCORED, LANES = 1 << 15, 1 << 16, 2048
#: Bytes whose followers are counted at a time.
SLICE = 1 << 21
#: Bytes of the blocks after which a document's weights move; beyond STEADY, a
#: block moves them no further than one of that size.
BLOCKS, STEADY = (128, 256, 512, 1024, 2048, 4096), 1024
#: Words in the broadcast dictionary at most; others are joined.
HOT_WORDS = 1 << 18
#: The end of a text.
END = b"\n"


def stream(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text, and the bytes that are scored."""
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + END


def key_of(word: bytes) -> bytes:
    """Short words count as themselves, long ones as a digest (no UTF-8 text begins with FF)."""
    return word if len(word) <= 16 else b"\xff" + xxhash.xxh3_128_digest(word)


#: Classes of the second byte before, by a hash; a code for each class and byte before.
CLASSES = 16
CLASS_OF = ((np.arange(256) * 0x9E3779B1 >> 7) % CLASSES).astype(np.int64)
#: All (class, byte before, byte).
TRIPLES = CLASSES << 16


def triples(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the code of the bytes at ``at`` goes by: class of the second byte before, the byte before, the byte."""
    return CLASS_OF[data[at - 2]] << 16 | data[at - 1].astype(np.int64) << 8 | data[at]


class Code:
    """Binary prefix codes of bytes, one for each byte before and class of the
    byte before it: Huffman's, with every byte counted once more than found.

    Tables over all triples: ``sizes`` and ``first`` give a triple's bits in
    ``flat``: the node of its tree times 16, twice the depth, and the bit.
    """

    def __init__(self, counts: np.ndarray):
        found = counts.reshape(-1, 256)
        used, which = [np.zeros(256, np.int64)], np.zeros(len(found), np.int64)
        for i in np.flatnonzero(found.any(axis=1)):  # what never occurred shares one code
            which[i] = len(used)
            used.append(found[i])
        place, depth, sizes = [], [], []
        for own in used:
            heap = [(n + 1, b) for b, n in enumerate(own.tolist())]
            heapq.heapify(heap)
            child = {}
            for node in range(256, 511):
                n, a = heapq.heappop(heap)
                m, b = heapq.heappop(heap)
                child[node] = (a, b)
                heapq.heappush(heap, (n + m, node))
            ways: dict[int, list[int]] = {510: []}  # of each node: twice the places on the way, plus the bits taken
            for node in range(510, 255, -1):
                way = ways.pop(node)
                for taken, c in enumerate(child[node]):
                    ways[c] = [*way, 2 * (510 - node) + taken]
            for b in range(256):
                sizes.append(len(ways[b]))
                place += ways[b]
                depth += range(len(ways[b]))
        way = np.array(place, np.uint16)
        self.flat = ((way >> 1) << 4) | (np.minimum(depth, DEPTHS - 1).astype(np.uint16) << 1) | (way & 1)
        first = np.cumsum(sizes) - sizes
        self.sizes = np.array(sizes, np.uint8).reshape(-1, 256)[which].ravel()
        self.first = first.astype(np.int32).reshape(-1, 256)[which].ravel()

    def bits(self, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each triple's byte in turn, and how many it has."""
        sizes = self.sizes.take(triple).astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.first.take(triple) - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat.take(at), sizes


def contexts(data: np.ndarray) -> list[np.ndarray]:
    """For every byte, the hash of each predictor's context: the bytes before it."""
    b = data.astype(np.uint32) + np.uint32(1)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, CONTEXTS[-1][0] + 1):
        h[n:] += b[:-n]
        h *= np.uint32(0x85EBCA6B)
        if any(n == order for order, _ in CONTEXTS):
            out.append(h + np.uint32(n))
    return out


#: Bytes before a segment that its contexts look at.
BEFORE = CONTEXTS[-1][0]


def segments(streams: list[bytes], limit: int = SEGMENT) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """Groups of pieces (stream, place of its first byte, bytes before, bytes)
    of about ``limit`` bytes: at most LANES whole short streams, or one piece of
    a long one, cut where a block ends."""
    group, size = [], 0
    for i, s in enumerate(streams):
        if len(s) > limit:
            cuts = [0, *range(limit - (limit - sum(BLOCKS)) % BLOCKS[-1], len(s), limit - limit % BLOCKS[-1]), len(s)]
            for at, end in zip(cuts, cuts[1:]):
                yield [(i, at, s[max(0, at - BEFORE):at].rjust(BEFORE, END), s[at:end])]
            continue
        if group and (size + len(s) > limit or len(group) == LANES):
            yield group
            group, size = [], 0
        group.append((i, 0, END * BEFORE, s))
        size += len(s)
    if group:
        yield group


class Bits:
    """All bits of a group of pieces: values, depths and slots.

    ``by_block``: bytes are taken by block of their document, then by document;
    ``waves`` are the ends of the blocks, ``rates`` how far each moves the
    weights, and ``lane`` the piece of every bit."""

    def __init__(self, code: Code, pieces: list[tuple[int, int, bytes, bytes]], by_block: bool = False):
        data = np.frombuffer(b"".join(x for p in pieces for x in p[2:]), np.uint8)
        lengths = np.array([len(p[3]) for p in pieces])
        starts = np.cumsum(lengths + BEFORE) - lengths
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = inside + np.repeat(starts, lengths)
        if by_block:
            lane = np.repeat(np.arange(len(pieces)), lengths)
            edges = np.cumsum(BLOCKS)
            place = inside + np.repeat([p[1] for p in pieces], lengths)
            block = np.where(place < edges[-1], np.searchsorted(edges, place, "right"),
                             len(BLOCKS) + (place - edges[-1]) // BLOCKS[-1]).astype(np.uint32)
            order = np.argsort(block, kind="stable")
            at, block = at[order], block[order]
        flat, sizes = code.bits(triples(data, at))
        self.bit, self.depth = (flat & 1).astype(bool), (flat >> 1).astype(np.uint8) & 7
        self._byte = np.repeat(np.arange(len(at)), sizes)
        self._place = flat >> 4
        self._contexts = [region(c[at], bits) for c, (_, bits) in zip(contexts(data), CONTEXTS, strict=True)]
        if by_block:
            ends = np.concatenate([[0], np.cumsum(sizes)])
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()]
            self.waves = ends[[*starts, len(at)]].tolist()
            size = np.array(BLOCKS)[np.minimum(block[starts], len(BLOCKS) - 1)]
            self.rates = (OWN_RATE * np.minimum(1, STEADY / size)).astype(np.float32)
            self.lane = lane[order].take(self._byte)

    def slots(self, k: int, more: int = 0) -> np.ndarray:
        """Slots of all bits in the table of a predictor, times 2 ** more: the
        place in the code, shifted by the context, within the context's region."""
        at = self._contexts[k].take(self._byte)
        inside = at + self._place
        inside &= np.uint32(REGION - 1)
        at &= np.uint32(0xFFFFFFFF ^ (REGION - 1))
        at |= inside
        return at.astype(np.int64) << more if more else at.astype(np.int64)


def region(context: np.ndarray, bits: int) -> np.ndarray:
    """A region of the table for each context, and in its low bits a shift."""
    h = context ^ (context >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def count_bits(docs: DataFrame, code: Code) -> np.ndarray:
    """The tables, all in one array: log odds of every slot as bytes, from the
    counts of all bits of ``docs`` (``text``)."""
    sizes = [1 << bits for _, bits in CONTEXTS]
    offsets = np.cumsum([0, *sizes])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * offsets[-1], np.int32)
        one = np.int32(1)
        for batch in batches:
            for text in _runs(batch.column(0)):
                for pieces in segments(text):
                    bits = Bits(code, pieces)
                    for k, offset in enumerate(offsets[:-1]):
                        np.add.at(counts[2 * offset:2 * (offset + sizes[k])], bits.slots(k, 1) | bits.bit, one)
        for chunk, part in enumerate(counts.reshape(-1, 2 * CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()),
                                                  "counts": [pa.compress(part.astype("<i4").tobytes(), "zstd", asbytes=True)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(data, 8 * CHUNK, "zstd", asbytes=True), "<i4")
                sums[chunk] = sums.get(chunk, 0) + part.astype(np.int64)
        for chunk, both in sums.items():
            zeros, ones = both.reshape(-1, 2).T
            odds = np.clip(np.rint(ODDS * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127)
            odds = np.where(zeros + ones > 0, odds, UNSEEN).astype(np.int8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "odds": [odds.tobytes()]})

    table = np.full(offsets[-1], UNSEEN, np.int8)
    chunks = saved(docs.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, odds binary"),
                   "mix-tables")
    for r in chunks.toLocalIterator():  # a table of fixed size
        table[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["odds"], np.int8)
    return table


def _runs(texts: pa.Array, count: Counter | None = None, limit: int = 1 << 21) -> Iterator[list[bytes]]:
    """Streams of a few megabytes of texts at a time; ``count`` takes their words and ends."""
    out, size = [], 0
    for text in texts:
        words, data = stream(text.as_py())
        if count is not None:
            count.update(words)
            count[b""] += 1
        out.append(data)
        size += len(data)
        if size > limit:
            yield out
            out, size = [], 0
    if out:
        yield out


@dataclass
class Model:
    """Code, tables, weights of each gate (and a bias), and the adaptive map."""

    code: Code
    table: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def inputs(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of every predictor for all bits, and the gates."""
        out, seen, offset = [], np.zeros(len(bits.bit), np.uint8), 0
        for k, (_, size) in enumerate(CONTEXTS):
            odds = self.table[offset:offset + (1 << size)].take(bits.slots(k))
            offset += 1 << size
            seen = np.where(odds != UNSEEN, np.uint8(k + 1), seen)
            out.append(KEPT_ODDS.take(odds.view(np.uint8)))
        return out, (seen * np.uint8(DEPTHS) + bits.depth).astype(np.int64)

    def refine(self, gate: np.ndarray, mixed: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Probability of a one: half the mix, half what the map found at such odds."""
        found = self.refined.take(bucket(gate, mixed))
        found += plain
        found *= np.float32(0.5)
        return np.clip(found, LEAST, 1 - LEAST, out=found)


def bucket(gate: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Place in the adaptive map: the gate and the nearest of its log odds."""
    near = np.clip(mixed, -LIMIT, LIMIT)
    near += LIMIT
    near *= STEPS
    return gate * BUCKETS + np.rint(near, out=near).astype(np.int64)


def likely(mixed: np.ndarray) -> np.ndarray:
    """Probability of a one at these log odds."""
    out = np.clip(mixed, -20, 20)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def mix(weights: np.ndarray, row: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    """Mixed log odds; ``weights``: a row of predictors' weights and a bias for each gate."""
    each = np.ascontiguousarray(weights.T)
    mixed = each[-1].take(row)
    for w, x in zip(each, inputs):
        mixed += w.take(row) * x
    return mixed


def gradient(rows: int, row: np.ndarray, error: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    """Sum of the errors times the inputs, by row of the weights."""
    return np.stack([*(np.bincount(row, error * x, rows) for x in inputs), np.bincount(row, error, rows)], axis=1).astype(np.float32)


def start_weights() -> np.ndarray:
    out = np.full((GATES, len(CONTEXTS) + 1), 0.3, np.float32)
    out[:, -1] = 0
    return out


def bucket_centers() -> np.ndarray:
    return 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, BUCKETS)))


def learn_mix(docs: DataFrame, code: Code, table: np.ndarray) -> Model:
    """The model: weights and map learned online in every task's part of ``docs``
    (``text``), and averaged by the bits that each gate and bucket has seen."""
    begin = Model(code, table, start_weights(), np.tile(bucket_centers(), (GATES, 1)).ravel().astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(begin)
    n_weights = GATES * (len(CONTEXTS) + 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.weights.astype(np.float64)
        power, seen = np.full_like(weights, 1e-3), np.zeros(GATES)
        found = np.zeros((2, GATES * BUCKETS))
        for batch in batches:
            for streams in _runs(batch.column(0)):
                for pieces in segments(streams):
                    bits = Bits(code, pieces)
                    inputs, gate = model.inputs(bits)
                    for a in range(0, len(gate), 1 << 13):
                        cut = slice(a, a + (1 << 13))
                        x, g, y = [i[cut] for i in inputs], gate[cut], bits.bit[cut]
                        mixed = mix(weights, g, x)
                        near = bucket(g, mixed)
                        found += [np.bincount(near, minlength=found.shape[1]), np.bincount(near, y, found.shape[1])]
                        step = gradient(GATES, g, y - likely(mixed), x)
                        power += step * step
                        weights += RATE * step / np.sqrt(power)
                        seen += np.bincount(g, minlength=GATES)
        n = np.concatenate([np.repeat(seen, len(CONTEXTS) + 1), found[0]])
        total = np.concatenate([weights.ravel() * n[:n_weights], found[1]])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at])], names=["slot", "n", "total"])

    weights, refined = begin.weights.ravel().copy(), begin.refined.copy()
    rows = docs.mapInArrow(learn, "slot long, n double, total double").groupBy("slot").agg(F.sum("n"), F.sum("total")).collect()
    for slot, n, total in rows:  # fixed in number
        if slot < n_weights:
            weights[slot] = total / n
        else:
            slot -= n_weights
            refined[slot] = (total + 4 * refined[slot]) / (n + 4)
    return Model(code, table, weights.reshape(GATES, -1), refined)


class Scorer:
    """Log probabilities of whole streams by a model."""

    def __init__(self, model: Model):
        self.model = model

    def scores(self, streams: list[bytes]) -> np.ndarray:
        out = np.zeros(len(streams))
        own, last = None, -1
        for pieces in segments(streams, SCORED):
            if not (len(pieces) == 1 and pieces[0][0] == last and pieces[0][1]):
                own = np.tile(self.model.weights, (len(pieces), 1))
            last = pieces[-1][0]
            bits = Bits(self.model.code, pieces, True)
            inputs, gate = self.model.inputs(bits)
            row = gate + bits.lane * GATES
            logs = np.empty(len(gate), np.float32)
            for a, b, rate in zip(bits.waves, bits.waves[1:], bits.rates, strict=False):
                x, r, y = [i[a:b] for i in inputs], row[a:b], bits.bit[a:b]
                mixed = mix(own, r, x)
                plain = likely(mixed)
                p = self.model.refine(gate[a:b], mixed, plain)
                logs[a:b] = np.where(y, p, 1 - p)
                if b < len(gate) or len(pieces) == 1:
                    own += rate * gradient(len(own), r, y - plain, x)
            np.add.at(out, [p[0] for p in pieces], np.bincount(bits.lane, np.log(logs), len(pieces)))
        return out / math.log(10)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte`` of every row.

    The model learns from the rows for which ``held_out`` does not hold (null
    counts as not; by default remainder 2 of the id's crc32 modulo 7). ``score``
    is the log10 probability of the words, parted by one space, and the end;
    ``base_score`` that of a unigram model of the words and the end with one
    added to each count. ``n_known``: tokens that training has. Null and empty
    texts are the end alone; repeated rows are scored each; without training rows
    every word is unknown; an empty table gives no rows. Other columns are not
    looked at.
    """
    spark = prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col)
    crc = F.crc32(F.col("doc_id").cast("string")) % 7
    out = F.coalesce(crc == 2 if held_out is None else held_out, F.lit(False))
    train = src.where(~out)
    words = saved(word_counts(train), "mix-words")
    totals = words.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    follow = np.zeros(TRIPLES, np.int64)
    for r in words.where("kind = 1").collect():  # TRIPLES at most
        follow[int.from_bytes(r["key"], "big")] = r["n"]
    vocabulary = words.where("kind = 0").select("key", "n")
    hot = {bytes(r["key"]): r["n"] for r in vocabulary.where(F.col("n") >= hot_bound(vocabulary)).collect()}
    code = Code(follow)
    weighed = F.coalesce(crc == 3, F.lit(False))
    model = learn_mix(train.where(weighed).select("text"), code, count_bits(train.where(~weighed).select("text"), code))

    first = saved(_score(src.withColumn("held_out", out).withColumn("row", F.monotonically_increasing_id()), model, hot), "mix-scores")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(vocabulary, "key")
    rare = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    n_train, n_words = totals
    base = F.col("hot_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_train + n_words + 1))
    return (first.join(rare, "row", "left")
                 .select("doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes",
                         (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")))


def word_counts(train: DataFrame) -> DataFrame:
    """``kind, key, n``: counts of words and the end (kind 0), and of the triples
    of the streams, ends before the first byte (kind 1)."""
    def run(batch: pa.RecordBatch):
        words, follow = Counter(), np.zeros(TRIPLES, np.int64)
        for streams in _runs(batch.column(0), words):
            for group in segments(streams, SLICE):
                data = np.frombuffer(b"".join(x for p in group for x in p[2:]), np.uint8)
                lengths = np.array([len(p[3]) for p in group])
                at = np.arange(lengths.sum()) + np.repeat(BEFORE * np.arange(1, len(group) + 1), lengths)
                follow += np.bincount(triples(data, at), minlength=TRIPLES)
        at = np.flatnonzero(follow)
        kind = pa.array(np.repeat(np.array([0, 1], np.int8), [len(words), len(at)]))
        keys = pa.array([*map(key_of, words), *(int(p).to_bytes(4, "big") for p in at)], pa.binary())
        yield pa.RecordBatch.from_arrays([kind, keys, pa.array([*words.values(), *follow[at].tolist()], pa.int64())], names=["kind", "key", "n"])

    found = arrow_map(train.select("text"), run, "kind byte, key binary, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def hot_bound(vocabulary: DataFrame) -> int:
    """The least count from which on there are at most HOT_WORDS words, from
    the numbers of words per eighth of a power of two."""
    step = F.floor(F.log2("n") * 8).alias("step")
    left = HOT_WORDS
    bound = 1 << 62
    for r in sorted(vocabulary.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        left -= r["words"]
        if left < 0:
            break
        bound = r["least"]
    return bound


def _score(docs: DataFrame, model: Model, hot: dict[bytes, int]) -> DataFrame:
    """One row per document with its score, what the dictionary knows of its
    words, and the words that it does not have."""
    logs = {k: math.log10(n + 1) for k, n in hot.items()}
    shared = docs.sparkSession.sparkContext.broadcast((model, logs))

    def run(batch: pa.RecordBatch):
        model, logs = shared.value
        scorer = Scorer(model)
        texts = batch.column(1)
        at, size = 0, 0
        while at < len(texts):
            streams, tokens, known, sums, keys, times, ends = [], [], [], [], [], [], [0]
            a, size = at, 0
            while at < len(texts) and size < 1 << 21:
                words, data = stream(texts[at].as_py())
                counts = Counter(words)
                counts[b""] = 1
                total = have = 0
                for word, n in counts.items():
                    # a long word stands in the dictionary by its digest only
                    if (log := logs.get(word)) is None and (log := logs.get(key := key_of(word))) is None:
                        keys.append(key)
                        times.append(n)
                    else:
                        total += n * log
                        have += n
                streams.append(data)
                tokens.append(len(words) + 1)
                known.append(have)
                sums.append(float(total))
                ends.append(len(keys))
                size += len(data)
                at += 1
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(times, pa.int64())], ["key", "times"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, at - a) for c in (0, 2, 3)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(sums, pa.float64()), rare, pa.array(scorer.scores(streams)), pa.array(list(map(len, streams)), pa.int64())],
                names=["doc_id", "held_out", "row", "n_tokens", "hot_known", "hot_logs", "rare", "score", "n_bytes"])

    return arrow_map(docs, run, "doc_id long, held_out boolean, row long, n_tokens long, hot_known long, hot_logs double, "
                                "rare array<struct<key:binary,times:long>>, score double, n_bytes long")
