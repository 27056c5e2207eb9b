"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a BPE vocabulary with word
ends, exactly as its library does:

* the *splitter* works on character classes and marks where a word starts.
  Texts are cut into chunks of fixed length; each chunk gives a map from every
  entry state to the exit state; the maps compose by a parallel prefix scan,
  which yields each chunk's true entry state, and a last pass emits the marks;
* the *merger* works on the bytes of one word. Its state is what a suffix of
  the word still allows: for every place where a token may have begun, the
  token before it and how many tokens lead there. Each transition carries the
  number of tokens it emits. States are compiled when first met and kept.

Both are exact, so the counts do not depend on chunk or batch size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import arrow_map, held, prepare, renamed, slices

#: Characters per chunk of the splitter.
CHUNK = 512
#: Words and merger states kept per worker before the tables start anew.
KEPT_WORDS, KEPT_STATES = 800_000, 40_000
#: Rank beyond all merges.
FAR = 1 << 60

# Character classes of the splitter.
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)
# Its states; a contraction has one or two more letters to take.
FREE, IN_LETTERS, IN_OTHER, ONE_MORE, TWO_MORE = range(5)

# Fixed values of the vocabulary's split pattern: contractions after an apostrophe.
SHORT_ENDS = "stmd"
LONG_ENDS = ("re", "ve", "ll")


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and word-start mark, by state * 6 + class."""
    step, mark = np.zeros((5, 6), np.uint8), np.zeros((5, 6), np.uint8)
    for s in range(5):
        for c in range(6):
            if s in (ONE_MORE, TWO_MORE):
                step[s, c] = FREE if s == ONE_MORE else ONE_MORE
            elif c == SPACE:
                step[s, c] = FREE
            elif s == IN_OTHER and c in (OTHER, SHORT, LONG):
                step[s, c] = IN_OTHER
            else:
                step[s, c] = {LETTER: IN_LETTERS, NUMBER: FREE, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE}[c]
                mark[s, c] = not (s == IN_LETTERS and c == LETTER)
    return step.ravel(), mark.ravel()


STEP, MARK = _splitter()


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point (letters, numbers, white space, other)."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


@lru_cache(1)
def unknown_characters() -> re.Pattern:
    """Code points that Python's Unicode tables do not have (yet), private and
    surrogate ones left out."""
    return _characters([c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"])


@lru_cache(1)
def suspect_characters() -> re.Pattern:
    """The unknown ones up to U+FFFF and all beyond. The engine finds these by
    one look-up a character; beyond U+FFFF it tries range by range."""
    return _characters([c for c in range(0x110000) if c > 0xFFFF or unicodedata.category(chr(c)) == "Cn"])


def _characters(codes: list[int]) -> re.Pattern:
    runs, first = [], None
    for a, b in zip([-2, *codes], [*codes, -2]):
        if b != a + 1:
            if first is not None:
                runs.append(f"\\U{first:08x}-\\U{a:08x}")
            first = b
    return re.compile(f"[{''.join(runs)}]")


def has_unknown(text: str) -> bool:
    """Whether a text holds one of :func:`unknown_characters`."""
    found = None if text.isascii() else suspect_characters().search(text)
    return found is not None and unknown_characters().search(text, found.start()) is not None


def classes_of(codes: np.ndarray) -> np.ndarray:
    cls = char_classes()[codes]
    at = np.flatnonzero(codes == 39)
    if at.size:
        after = np.append(codes, [0, 0])
        one, two = after[at + 1], after[at + 2]
        cls[at[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = SHORT
        for a, b in LONG_ENDS:
            cls[at[(one == ord(a)) & (two == ord(b))]] = LONG
    return cls


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps (row i: chunks 0..i applied in turn), in
    log2(n) rounds of composition."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].copy(), axis=1)
        d *= 2
    return out


def word_marks(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where words start, over the classes of a text."""
    n = len(cls)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, SPACE, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for col in grid:
        maps = STEP[maps * np.uint8(6) + col[:, None]]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = prefix_maps(maps)[:-1, FREE]
    marks = np.empty_like(grid)
    for i, col in enumerate(grid):
        at = entry * np.uint8(6) + col
        marks[i] = MARK[at]
        entry = STEP[at]
    return marks.T.reshape(-1)[:n]


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Words of lower-cased texts, and how many each text has."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).copy()
    cls = classes_of(codes)
    marks = word_marks(cls)
    codes[cls == SPACE] = 10
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[np.concatenate([[0], ends])]
    starts = np.flatnonzero(marks)
    cut = starts[(starts > 0) & (codes[starts - 1] != 10)]
    return np.insert(codes, cut, 10).tobytes().decode("utf-32-le").encode().split(), np.diff(total)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class Merger:
    """Transducer over the bytes of a word that emits token counts."""

    def __init__(self, model: dict):
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(pairs)}
        self.tokens = set(model["vocab"])
        bare = {t.removesuffix(self.end) if self.end else t for t in self.tokens}
        self.prefixes = {t[:i] for t in bare for i in range(len(t))}
        self.symbols = byte_symbols()
        self.valid: dict[tuple[str | None, str], bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.last: list[dict[int, int]] = []
        self.state(("", ((None, 0),)))

    def state(self, key: tuple) -> int:
        k = self.ids.setdefault(key, len(self.states))
        if k == len(self.states):
            self.states.append(key)
            self.next.append({})
            self.last.append({})
        return k

    def spines(self, token: str) -> tuple[list, list] | None:
        """Parts at the right and left edge of a token while it is built, each
        with the rank of the merge that ends it; None if merges never build it."""
        if token not in self.edges:
            parts, done = [(c, None, None, 0) for c in token.removesuffix(self.end)], False
            if self.end and token.endswith(self.end):
                parts[-1] = (parts[-1][0] + self.end, None, None, 0)
            while len(parts) > 1 and not done:
                ranks = [self.ranks.get((p[0], q[0]), FAR) for p, q in zip(parts, parts[1:])]
                best, done = min(ranks), min(ranks) == FAR
                out, i = [], 0
                while i < len(parts):
                    if not done and i + 1 < len(parts) and self.ranks.get((parts[i][0], parts[i + 1][0])) == best:
                        out.append((parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1], best))
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            sides = None
            if len(parts) == 1:
                sides = ([], [])
                for side, child in zip(sides, (2, 1)):
                    node, until = parts[0], FAR
                    while node is not None:
                        side.append((node[0], until))
                        node, until = node[child], node[3]
            self.edges[token] = sides
        return self.edges[token]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether a tokenization may hold ``token`` right after ``before``:
        no merge across the border comes before those that end its parts
        (of equal ranks the one further left comes first)."""
        key = (before, token)
        got = self.valid.get(key)
        if got is None:
            right, left = self.spines(before) if before else ([], None), self.spines(token)
            got = left is not None and right is not None
            if got and before:
                rank = self.ranks.get
                got = not any((r := rank((x, y))) is not None and r < x_until and r <= y_until
                              for x, x_until in right[0] for y, y_until in left[1])
            if len(self.valid) > KEPT_STATES:
                self.valid.clear()
            self.valid[key] = got
        return got

    def reach(self, state: int, byte: int, final: bool) -> tuple[str, tuple, int, str] | None:
        """The token that ends at this byte, and the tokens up to its end."""
        seen, window = self.states[state]
        text = seen + self.symbols[byte]
        for i in range(len(text)):
            token = text[i:]
            full = token + self.end if final else token
            if full in self.tokens and (place := window[i]) is not None and self.fits(place[0], full):
                return text, window, place[1] + 1, token
        return None

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state and the tokens emitted."""
        got = self.reach(state, byte, False)
        if got is None:
            raise ValueError("vocabulary is not closed under its merges")
        text, window, count, token = got
        i = 0
        while text[i:] not in self.prefixes:
            i += 1
        places = [*window, (token, count)][i:]
        kept = [p if text[i + k:] in self.prefixes else None for k, p in enumerate(places)]
        base = kept[0][1]
        key = (text[i:], tuple(p and (p[0], p[1] - base) for p in kept))
        out = self.next[state][byte] = (self.state(key), base)
        return out

    def finish(self, state: int, byte: int) -> int:
        got = self.reach(state, byte, True)
        if got is None:
            raise ValueError("vocabulary is not closed under its merges")
        out = self.last[state][byte] = got[2]
        return out

    def count(self, word: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self.clear()
        state, total, following, step = 0, 0, self.next, self.step
        for b in word[:-1]:
            got = following[state].get(b)
            if got is None:
                got = step(state, b)
            state = got[0]
            total += got[1]
        b = word[-1]
        end = self.last[state].get(b)
        return total + (self.finish(state, b) if end is None else end)


class WordCounts(dict):
    """Tokens by word; missing words run through the transducer."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: bytes) -> int:
        n = self.merger.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


class Counter:
    """Token counts of whole texts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = WordCounts(Merger(spec["model"]))
        marks = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.path, self.library = path, None

    def by_library(self, text: str) -> int:
        """Tokens of a text with characters newer than Python's tables, which
        may be letters or have another case to the library."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> tuple[str, int]:
        """Normal form of a text without its special strings, and their number.
        A text with unknown characters is counted whole by the library."""
        n = 0
        if has_unknown(text):
            return "", self.by_library(text)
        if self.special and "<|" in text:
            text, n = self.special.subn("\n", text)
        if not text.isascii():
            # lower case goes character by character: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower(), n

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        plain, special = zip(*(self.plain(t or "") for t in texts), strict=True)
        words, per_text = split_words(list(plain))
        n = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        at = np.concatenate([[0], np.cumsum(per_text)])
        return np.diff(np.concatenate([[0], np.cumsum(n)])[at]) + np.array(special, np.int64)


def counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary``: path of a BPE vocabulary with word ends (``.json``), the
    same on every node. A null text counts as empty; a null id stays null;
    repeated rows give repeated results; an empty table gives none; other
    columns of the input are not looked at.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1).to_pylist()):
            part = batch.slice(a, b - a)
            texts = part.column(1).to_pylist()
            n = counter(vocabulary).counts(texts)
            size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = renamed(docs, doc_id=id_col, text=text_col)
    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, "
                               "over_limit boolean", holds=True)
