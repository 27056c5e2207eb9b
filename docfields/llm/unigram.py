"""SentencePiece encoding and decoding: unigram Viterbi over a double array.

The pieces of a public model, with their scores as log scores, are compiled
into a double-array trie over UTF-8 bytes. A text is prefixed with the white
space marker (where the model says so), spaces become markers, and the best
path by total score gives the pieces; where no piece covers a character an
unknown edge of one character stands in (score: the lowest score less 10) and
is spelled in byte pieces. Of equal scores the path found first holds: ends
are reached from earlier starts first.

No piece holds a marker after another character, nor a line feed, so a text
falls apart into segments whose best paths are independent.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import PieceCache, arrow_map, held, prepare, renamed, slices

#: The white space marker, and what an unknown character costs below the lowest score. Fixed values.
MARKER, UNKNOWN_COST = "▁", 10.0


class DoubleArray:
    """Trie in two arrays: child of state s by byte b is base[s] + b + 1 where check holds s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        root: dict = {}
        for key, value in keys:
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], todo = 0, [(root, 0)]
        # where to look for room: lone children fill the holes, families start where there is space
        lone = family = 1
        for node, state in todo:
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            codes = sorted(node)
            slot = lone if len(codes) == 1 else family
            while True:
                start = slot - codes[0] - 1
                if slot + 257 >= len(check):
                    for array, fill in ((base, 0), (check, -1), (value, -1)):
                        array.extend([fill] * len(array))
                if start >= 0 and all(check[start + c + 1] < 0 for c in codes):
                    break
                slot += 1
            if len(codes) == 1:
                lone = slot
            elif slot - family > 64:
                family = slot - 32
            base[state] = start
            for c in codes:
                check[start + c + 1] = state
                todo.append((node[c], start + c + 1))
        self.base, self.check, self.value = base, check, value


class Unigram:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = MARKER if norm.add_dummy_prefix else ""
        self.size = len(model.pieces)
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.scores = [p.score for p in model.pieces]
        self.unknown = min(p.score for _, p in normal) - UNKNOWN_COST
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.spelled = [p.piece.encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in model.pieces]
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        # where texts may be cut: before a run of markers, around line feeds
        pieces = [p.piece for _, p in normal]
        self.parted = not any(re.search(f"[^{MARKER}]{MARKER}", p) or "\n" in p for p in pieces)
        self.trie = DoubleArray([(p.piece.encode(), i) for i, p in normal])
        self.cache = PieceCache(lambda segments: [self.best(s) for s in segments])

    def best(self, text: str) -> list[int]:
        """Ids of the best path over a text with markers."""
        data = text.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        least = float("-inf")
        total, back, how = [least] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        total[0] = 0.0
        i = 0
        while i < n:
            here, state, j, first = total[i], 0, i, data[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            single = False
            while j < n:
                to = base[state] + data[j] + 1
                if check[to] != state or to == 0:
                    break
                state = to
                j += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    single = single or j - i == width
                    if score > total[j]:
                        total[j], back[j], how[j] = score, i, piece
            if not single and here + self.unknown > total[i + width]:
                total[i + width], back[i + width], how[i + width] = here + self.unknown, i, -1
            i += width
        out, at = [], n
        while at > 0:
            start = back[at]
            if how[at] >= 0:
                out.append(how[at])
            else:
                out.extend(self.bytes[b] for b in reversed(data[start:at]))
            at = start
        out.reverse()
        return out

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = self.prefix + text.replace(" ", MARKER)
        return SEGMENT.findall(marked) if self.parted else [marked]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        parts = [self.segments(t) for t in texts]
        return self.cache.ids([s for p in parts for s in p], np.fromiter(map(len, parts), np.int64, len(parts)))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to UTF-8, markers become spaces, the
        first space goes where the model adds one; bytes that are no UTF-8
        become U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(MARKER, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


SEGMENT = re.compile(f"{MARKER}+[^{MARKER}\n]*|[^{MARKER}\n]+|\n")


def unigram(path: str) -> Unigram:
    return held(("unigram", path), lambda: Unigram(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_pieces, n_byte_pieces, ids_crc32, round_trip`` per row.

    ``model``: path of a model file, the same on every node. ``round_trip``
    says whether decoding the ids gives the text again (it does unless the text
    itself holds the marker). Null and empty texts have no pieces and decode to
    the empty text; null ids, repeated rows and empty tables pass through as
    they are; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch):
        coder = unigram(model)
        for a, b in slices(batch.column(1).to_pylist()):
            part = batch.slice(a, b - a)
            texts = part.column(1).to_pylist()
            ids, sizes = coder.ids(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = ids.astype("<u4")
            byte = np.concatenate([[0], np.cumsum(coder.is_byte[ids])])
            flat = ids.tolist()
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(sizes), pa.array(np.diff(byte[ends])),
                pa.array([zlib.crc32(raw[x:y].tobytes()) for x, y in zip(ends, ends[1:])], pa.int64()),
                pa.array([coder.decode(flat[x:y]) == (t or "") for x, y, t in zip(ends, ends[1:], texts)]),
            ], names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long, "
                               "n_byte_pieces long, ids_crc32 long, round_trip boolean", holds=True)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded rows; null ids give an empty text, a row with
    an id outside the vocabulary (or a null one) no text."""
    prepare(encoded.sparkSession)
    src = renamed(encoded, doc_id=id_col, ids=ids_col)

    def run(batch: pa.RecordBatch):
        coder = unigram(model)
        rows = batch.column(1).to_pylist()
        fine = [not r or None not in r and 0 <= min(r) and max(r) < coder.size for r in rows]
        texts = [coder.decode(r or []) if ok else None for r, ok in zip(rows, fine, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string", holds=True)
