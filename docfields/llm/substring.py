"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where it falls below a bound at
the end of a word (or of a character of three bytes and more, for scripts
without spaces) a chunk ends. The hash sees the last 16 bytes only, so after an
insertion the cuts fall where they fell before. Equal digests are equal chunks;
a chunk belongs to the document with the smallest id that holds it (of several
texts with one id, to that of the smallest key), there to its first place. Runs of other chunks with together ``min_words`` words or more
are taken out: passages repeat, single common phrases do not count. In scripts
without spaces a fixed number of characters counts as a word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm.common import arrow_map, dropped, prepare, saved, slices

#: Bytes of a chunk, and how often a word's or a wide character's end is a cut.
LEAST, MOST = 24, 512
WORD_RATE, WIDE_RATE = 6, 16
#: Words that a run of repeated chunks must have to go: what is left of a
#: passage of 50 words when the chunks at both its edges differ.
MIN_WORDS = 15
#: Scripts without spaces, and how many of their characters count as a word:
#: Han and kana; Thai, Lao, Tibetan, Burmese, Khmer and their neighbours.
UNSPACED = [(re.compile("[\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF]"), 2),
            (re.compile("[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u19DF\u1A00-\u1AAF\uA980-\uA9DF\uAA60-\uAA7F]"), 5)]
#: Punctuation of these scripts, no word by itself.
WIDE_MARKS = re.compile("[\u3000-\u303F\uFF00-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]")
SEED = 11


@lru_cache(1)
def gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 16, 256, np.uint16)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places where a chunk may end (the next byte begins another)."""
    h = gear()[data]
    for d in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[d:] = h[:-d]
        h = h + (shifted << np.uint16(d))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    out = space & (h < 65536 // WORD_RATE)
    if data.size > 2 and data.max() >= 0xE0:
        inner = (data & 0xC0) == 0x80
        wide = np.zeros_like(out)
        wide[2:-1] = inner[2:-1] & ~inner[3:] & ((data[:-3] >= 0xE0) | inner[:-3])
        out |= wide & (h < 65536 // WIDE_RATE)
    return np.flatnonzero(out) + 1


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """End of each chunk of each text."""
    places = candidates(np.frombuffer(b"".join(texts), np.uint8)).tolist()
    out, k, start = [], 0, 0
    for text in texts:
        end, last, ends = start + len(text), start, []

        def forced(upto: int) -> None:
            nonlocal last
            while upto - last > MOST:
                at = last + MOST
                while text[at - start] & 0xC0 == 0x80:
                    at -= 1
                ends.append(at - start)
                last = at

        while k < len(places) and places[k] < end:
            c = places[k]
            k += 1
            if c - last >= LEAST and c > start:
                forced(c)
                if c - last >= LEAST:
                    ends.append(c - start)
                    last = c
        while k < len(places) and places[k] == end:
            k += 1
        forced(end)
        if end > last:
            ends.append(end - start)
        out.append(ends)
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    """128 bits of a chunk without the white space around it."""
    return xxhash.xxh3_128_digest(chunk.strip())


def words_in(part: bytes) -> int:
    """Words between ASCII white space; scripts without spaces by characters."""
    if part.isascii():
        return len(part.split())
    text, n = part.decode(), 0
    for letters, per_word in UNSPACED:
        text, found = letters.subn(" ", text)
        n += found // per_word
    return n + len((WIDE_MARKS.sub(" ", text) if n else text).encode().split())


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, place, high, low``: each chunk's number and its digest in two halves."""
    def run(batch: pa.RecordBatch):
        ids, texts, keys = (batch.column(i).to_pylist() for i in range(3))
        for a, b in slices(texts):
            data = [(t or "").encode() for t in texts[a:b]]
            sizes, digests = [], []
            for text, ends in zip(data, chunk_ends(data), strict=True):
                sizes.append(len(ends))
                digests += [digest(text[x:y]) for x, y in zip([0, *ends], ends)]
            if digests:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids[a:b], np.int64), sizes)),
                     pa.array(np.repeat(np.array(keys[a:b], np.int64), sizes)),
                     pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "text_key", "place", "high", "low"])

    return arrow_map(docs, run, "doc_id long, text_key long, place int, high long, low long")


def cut(text: str, repeated: dict[int, int], min_words: int) -> tuple[str, int, int, int, list[int]]:
    """A text without its repeated passages; ``repeated``: by chunk number, the
    document that holds the chunk first."""
    data = text.encode()
    ends = chunk_ends([data])[0]
    foreign = [repeated.get(i) for i in range(len(ends))]
    kept, firsts, i, gone = [], [], 0, 0
    while i < len(ends):
        j = i
        while j < len(ends) and (foreign[j] is None) == (foreign[i] is None):
            j += 1
        part = data[ends[i - 1] if i else 0:ends[j - 1]]
        if foreign[i] is not None and words_in(part) >= min_words:
            firsts += foreign[i:j]
            gone += 1
        else:
            kept.append(part)
        i = j
    out = b"".join(kept).decode()
    return out, len(ends), sum(f is not None for f in foreign), gone, sorted(set(firsts))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, marks``: per document its chunks that an earlier
    place holds, as (place, the first place's doc_id).

    Places are ordered by ``doc_id``, then by the text's key where several texts
    share an id, then by number. Two passes over the chunks: a count by one half
    of the digest (8 bytes a chunk, combined before the shuffle), and the places
    of the chunks whose half repeats. Among these, told apart by whole digests,
    the first place of each is found. What is joined comes from written tables,
    so Spark splits large keys; only the marks stay written. A document's marks
    are no more than its chunks.
    """
    at = F.struct("doc_id", "text_key", "place")
    halves = chunk_rows(docs).groupBy("high").agg(F.count("*").alias("n"))
    halves = saved(halves.where("n > 1").select("high"), "substring-halves")
    places = saved(chunk_rows(docs).join(halves, "high", "left_semi"), "substring-places")
    dropped(halves)
    found = places.groupBy("high", "low").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    twice = saved(found.where("n > 1").select("high", "low", "first"), "substring-repeats")
    marks = places.join(twice, ["high", "low"]).where(at != F.col("first"))
    out = saved(marks.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("place", F.col("first.doc_id").alias("owner"))).alias("marks")), "substring-marks")
    dropped(places, twice)
    return out


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                     details: bool = True) -> DataFrame:
    """Every row of ``docs`` with repeated passages cut from its text.

    All columns stay; ``details`` adds ``n_chunks``, ``n_repeated`` (chunks that
    an earlier place holds), ``n_cut`` (passages taken out), ``first_docs`` (the
    documents that keep them). The first place of every passage stays, so
    nothing is lost from the corpus. Rows that repeat an id and its text count as
    one document, other texts of an id are documents of their own; null texts stay null; rows without an id pass unchanged; an empty
    table gives no rows; other columns pass, also where they bear the names
    used here (``details`` then replaces those). Ids are whole numbers.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"))
    marks = repeated_chunks(source.where("doc_id is not null and text is not null"))
    marks = marks.select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("marks").alias("_cut_marks"))
    joined = docs.join(marks, (F.col(f"`{id_col}`").cast("long") == F.col("_cut_id"))
                       & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_cut_key")), "left")
    extra = ["n_chunks", "n_repeated", "n_cut", "first_docs"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())]
    plain = [f for f in docs.schema if not (details and f.name in extra)]
    schema = T.StructType([*plain, *(T.StructField(n, k) for n, k in zip(extra, kinds, strict=True) if details)])
    at_source, at_text = docs.columns.index(text_col), [f.name for f in plain].index(text_col)
    keep = [docs.columns.index(f.name) for f in plain]

    def run(batch: pa.RecordBatch):
        texts = batch.column(at_source).to_pylist()
        for a, b in slices(texts):
            part = batch.slice(a, b - a)
            marked = part.column(part.num_columns - 1).to_pylist()
            rows = []
            for text, m in zip(texts[a:b], marked, strict=True):
                if text is None or m is None:
                    n = len(chunk_ends([text.encode()])[0]) if text and details else 0
                    rows.append((text, n, 0, 0, []))
                else:
                    rows.append(cut(text, {x["place"]: x["owner"] for x in m}, min_words))
            columns = [part.column(i) for i in keep]
            done = list(zip(*rows, strict=True))
            columns[at_text] = pa.array(done[0], pa.string())
            if details:
                columns += [pa.array(c, pa.int64()) for c in done[1:4]] + [pa.array(done[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    shape = joined.select(*[joined[f"`{c}`"] for c in docs.columns], "_cut_marks")
    return arrow_map(shape, run, schema)
