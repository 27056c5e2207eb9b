"""Token ids in binary shard files, packed at fixed width.

A shard holds the ids of consecutive documents (ascending ``doc_id``). Layout,
all little-endian::

    payload    blocks of BLOCK ids; 64 ids of b bits fill b 64-bit words, the
               last group of a block is padded with zeros
    blocks     uint64[n_blocks + 1]  byte offset of each block in the payload
    doc_ids    int64[n_docs]
    nulls      uint8[n_docs]         1 where the document has no id
    starts     int64[n_docs + 1]     first id of each document in the shard
    footer     FOOTER: magic, bits, block size, n_docs, n_ids, n_blocks

Any id range can be read alone: its blocks follow from the offsets, and a
block unpacks with b vector operations.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import ENTRY_BYTES, PieceCache, filesystem, held, prepare, renamed, slices
from docfields.session import scratch_path

MAGIC = b"TOKPACK1"
FOOTER = struct.Struct("<8sIIQQQ")
#: Letters with accents that are lower case and composed, so that no normal form changes them.
ACCENTED = "à-öø-ÿ"
#: Words of such letters and printable ASCII.
PLAIN = re.compile(f"[!-~{ACCENTED}]+")
#: The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other
#: bytes for the characters from 256 on. Fixed values.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
#: Bytes of parts of words that are kept with their ids.
PART_BYTES = 96 << 20
#: Ids per block (a multiple of 64).
BLOCK = 1 << 14


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids to ``bits`` words of 64 bits, low bits first."""
    ids = np.concatenate([ids, np.zeros(-len(ids) % 64, ids.dtype)]).astype(np.uint64).reshape(-1, 64)
    out = np.zeros((len(ids), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= ids[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= ids[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class ShardWriter:
    """Streams ids into one shard file; only the document index is held."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest: list[np.ndarray] = []
        self.waiting, self.at, self.n = 0, 0, 0
        self.blocks, self.doc_ids, self.nulls, self.starts = [0], [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            data = pack(ids[a:min(a + self.block, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.blocks, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1"), (self.starts, "<i8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.block, len(self.doc_ids), self.n, len(self.blocks) - 1))


class ShardReader:
    """Random access to one shard: the index in memory, ids by block on demand."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index = 8 * (n_blocks + 1) + 17 * self.n_docs + 8
        file.seek(file.size() - FOOTER.size - index)
        data, at = file.read(index), 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.blocks = take(n_blocks + 1, "<u8")
        self.doc_ids, self.nulls, self.starts = take(self.n_docs, "<i8"), take(self.n_docs, "u1"), take(self.n_docs + 1, "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; reads only their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.blocks[first]))
        data = self.file.read(int(self.blocks[last + 1] - self.blocks[first]))
        # whole blocks follow each other without padding, so they unpack as one
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(data, self.bits, n)[start - first * self.block:stop - first * self.block]

    def documents(self, about: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading ``about`` ids at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + about, "right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a = int(self.starts[k] - self.starts[i])
                yield (None if self.nulls[k] else int(self.doc_ids[k]), int(self.starts[k]),
                       ids[a:a + int(self.starts[k + 1] - self.starts[k])])
            i = j


class Encoder:
    """Ids of whole texts by the tokenizers library, each segment encoded once.

    Where white space always parts tokens, a text's ids are those of its
    segments in turn. Where the vocabulary folds case, ASCII segments are folded
    first and skip the library's normaliser, which does no more to them. Other
    texts, and those that may hold special strings, are encoded whole.
    """

    def __init__(self, path: str):
        # tasks run side by side already; threads of the library's own only spin
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bits = max(self.full.get_vocab(with_added_tokens=True).values()).bit_length()
        one = lambda t: self.full.encode(t, add_special_tokens=False).ids
        self.parted = one("a b\nc") == one("a") + one("b") + one("c")
        self.folds = self.parted and one("ABCXYZ") == one("abcxyz")
        self.bare = Tokenizer.from_str(json.dumps({**spec, "normalizer": None})) if self.folds else self.full
        self.marks = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        # where the vocabulary parts words by one pattern, ASCII words can be parted here and
        # each part, which many words share, goes to the library's merges once
        self.part, self.parts, self.part_bytes = self._pattern(spec), {}, 0
        self.cache = PieceCache(self._encode, 192 << 20)

    def _pattern(self, spec: dict) -> re.Pattern | None:
        """The vocabulary's own pattern for the letters of ``PLAIN``, if that and
        the byte alphabet are all there is."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not self.folds or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        if not (steps[0]["invert"] and steps[0]["behavior"] == "Removed" and "Regex" in steps[0]["pattern"]):
            return None
        pattern = steps[0]["pattern"]["Regex"].replace(r"\p{L}", f"a-zA-Z{ACCENTED}").replace(r"\p{N}", "0-9")
        return None if r"\p" in pattern else re.compile(pattern)

    def _by_parts(self, word: str) -> list[int]:
        ids = []
        for part in self.part.findall(word):
            if (own := self.parts.get(part)) is None:
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
                own = self.parts[part] = [t.id for t in self.full.model.tokenize(spelled)]
                self.part_bytes += len(part) + ENTRY_BYTES + 32 * len(own)
            ids += own
        return ids

    def _encode(self, segments: list[bytes]) -> list[list[int]]:
        if self.part_bytes > PART_BYTES:
            self.parts, self.part_bytes = {}, 0
        out: list = [None] * len(segments)
        rest: dict[bool, list[int]] = {True: [], False: []}
        texts = [s.decode() for s in segments]
        for i, t in enumerate(texts):
            if self.part and PLAIN.fullmatch(t):
                out[i] = self._by_parts(t)
            else:
                rest[t.isascii()].append(i)
        for tokenizer, at in ((self.bare, rest[True]), (self.full, rest[False])):
            found = tokenizer.encode_batch_fast([texts[i] for i in at], add_special_tokens=False) if at else []
            for i, e in zip(at, found, strict=True):
                out[i] = e.ids
        return out

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        parts, whole = [], {}
        for i, t in enumerate(texts):
            data = (t or "").encode()
            folded = data.lower()
            if not self.parted or any(m in folded for m in self.marks):
                whole[i] = self.full.encode(t or "", add_special_tokens=False).ids
                parts.append([])
            else:
                parts.append((folded if self.folds else data).split())
        ids, sizes = self.cache.ids([s for p in parts for s in p], np.fromiter(map(len, parts), np.int64, len(parts)))
        if whole:
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            each = [np.array(whole[i], np.int32) if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(len(parts))]
            ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, sizes


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def write_token_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = None,
                       id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode every text and write shard files to ``folder`` (shared storage)
    in ascending id order; returns (file, documents, ids) of each shard.

    Documents are range-partitioned by id, so a shard is one partition; the
    digest of the text and the row's place break ties, so copies of one id
    spread over shards too. A task writes to a name of its own and renames it
    at the end: a lost or repeated task leaves whole files only. The driver
    gets one row per shard. Null ids come first; a null text is empty.
    """
    if end_id is not None and not 0 <= end_id < 1 << 32:
        raise ValueError("end_id is an unsigned 32-bit id")
    spark = prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = src.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = (keyed.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row")
                    .select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], np.int32)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, draft = f"tokens-{part:08d}.bin", f"{root}/.draft-{part:08d}-{uuid.uuid4().hex}"
        writer = out = None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                if writer is None:
                    out = store.open_output_stream(draft)
                    writer = ShardWriter(out, max(coder.bits, (end_id or 0).bit_length()))
                ids, sizes = coder.ids(texts[a:b])
                at = 0
                for key, n in zip(keys[a:b], sizes.tolist(), strict=True):
                    writer.add(key, np.concatenate([ids[at:at + n], end]))
                    at += n
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [len(writer.doc_ids)], "ids": [writer.n]})

    rows = ordered.mapInArrow(run, "file string, docs long, ids long").collect()
    return sorted((r["file"], r["docs"], r["ids"]) for r in rows)


def read_token_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start``: ids of all documents before it, over all shards. One task per
    shard; a task holds a shard's index and about a million ids.
    """
    prepare(spark)
    before = [0, *np.cumsum([s[2] for s in shards]).tolist()]
    files = [(i, s[0], before[i]) for i, s in enumerate(shards)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                _, name, base = files[i]
                with store.open_input_file(f"{root}/{name}") as f:
                    rows = []
                    for doc, start, ids in ShardReader(f).documents():
                        rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return spark.range(len(files), numPartitions=len(files)).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_store(docs: DataFrame, vocabulary: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the shards and return what the files hold, per document.

    Null text: only the end id. Repeated rows: each is stored. Empty table:
    no files, no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    return read_token_shards(spark, folder, write_token_shards(docs, vocabulary, folder, end_id))
