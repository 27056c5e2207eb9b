"""Quality rules by tokeniser fertility.

A public vocabulary cuts each text into tokens. Three measures follow:
characters per token, the share of byte-fallback tokens, and the entropy of
the document's tokens in bits. What is usual depends on language and length,
so each document is held against the middle of its group (language or, where
none is given, script; and length class), in units of the group's upper
spread, taken from all documents that pass the base rules. Outside a band the
document is rejected.

Copies count once in the groups. A group of fewer than ``MIN_GROUP`` distinct
documents borrows from pooled ones, with larger least spreads. Entropy is held
against the length class over all languages or, where that is small too, against
as many neighbouring classes on both sides as make ``MIN_GROUP`` (all, if there
are no more). As it grows with length, the milder of two verdicts counts among
neighbours: of the entropy and of what it lacks to the most that so many tokens
can have. Characters per token
and byte share are held against the language over all lengths, then the script,
then all documents. So every document is held against a band of each measure.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.llm.common import PieceCache, arrow_map, held, prepare, renamed, saved, slices

#: Base rules: least words, most words in repeated 3-word windows (per cent).
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Bands, in upper spreads from the middle: entropy, and entropy and characters per token together.
ENTROPY_BAND, JOINT_BAND = -3.3, -6.5
#: Byte-fallback share: most above the group's middle.
BYTE_BAND = 0.25
#: Least spread: bits of entropy, and characters per token as a share of the middle; in a wider group more.
MIN_BITS, MIN_CHARS, WIDE_BITS, WIDE_CHARS = 0.08, 0.008, 0.2, 0.03
#: The same share where languages are pooled: they differ more than documents do.
POOLED_CHARS = 0.15
MIN_GROUP = 60
MEASURES = ("chars_per_token", "byte_share", "entropy", "lack")
#: Levels of the upper spread: the middle and one standard deviation above it.
LEVELS = (0.5, 0.84)

#: Scripts told apart where no language is given: first and last code point. Fixed values.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF),
           ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]


class Fertility:
    """Token ids of texts by a sentencepiece model, words encoded once each."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.cache = PieceCache(lambda s: self.model.encode(s, num_threads=1))

    def ids(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        # pieces cross from one word to the next only over several spaces or a marker
        if "" in parts or "▁" in text:
            return np.array(self.model.encode(text), np.int32)
        return self.cache.ids(parts, np.array([len(parts)]))[0]


def fertility(path: str) -> Fertility:
    return held(("fertility", path), lambda: Fertility(path))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    w = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, n)
    k = len(seen)
    pair = w[:-1] * k + w[1:]
    if k > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, kind, count = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    twice = count[kind] > 1
    covered = np.zeros(n, bool)
    for d in range(3):
        covered[d:n - 2 + d] |= twice
    return int(covered.sum())


def script_of(text: str) -> str:
    """Script of most letters; ``other`` where none is listed."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = [int(((codes >= a) & (codes <= b)).sum()) for _, a, b in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][0] if max(counts) else "other"


def measure_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str | None = "lang", carry: bool = False) -> DataFrame:
    """Base counts and fertility measures per row, with its group's keys.
    ``carry`` brings each row's own columns along, as the structure ``row``."""
    prepare(docs.sparkSession)
    has_lang = lang_col is not None and lang_col in docs.columns
    used = {"doc_id": id_col, "text": text_col} | ({"lang": lang_col} if has_lang else {})
    src = renamed(docs, **used)
    kind = src.schema["doc_id"].dataType.simpleString()
    if carry:
        src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        at = {k: docs.columns.index(c) for k, c in used.items()}
    names = [*(["row"] if carry else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
             "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "language", "script"]

    def row(text: str, lang: str | None) -> tuple:
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        ids = fertility(vocabulary).ids(text) if text else np.zeros(0, np.int32)
        n = len(ids)
        share = np.unique(ids, return_counts=True)[1] / n if n else np.zeros(0)
        code, script = (lang or "").strip().lower(), script_of(text)
        return (len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)), repeated_words(words), n, len(text) / n if n else 0.0,
                float(fertility(vocabulary).is_byte[ids].mean()) if n else 0.0,
                float(-(share * np.log2(share)).sum()) if n else 0.0,
                code if LANGUAGE.fullmatch(code) else "script:" + script, script)

    def run(batch: pa.RecordBatch):
        if carry:
            whole = batch.column(0)
            columns = {k: whole.field(i) for k, i in at.items()}
        else:
            columns = {k: batch.column(i) for i, k in enumerate(used)}
        texts = columns["text"].to_pylist()
        langs = columns["lang"].to_pylist() if has_lang else [None] * len(texts)
        for a, b in slices(texts):
            rows = [row(t or "", lang) for t, lang in zip(texts[a:b], langs[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([*([whole.slice(a, b - a)] if carry else []), columns["doc_id"].slice(a, b - a),
                                              *map(pa.array, zip(*rows, strict=True))], names=names)

    schema = T.StructType([*(src.schema if carry else []), *T.StructType.fromDDL(
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_tokens long, chars_per_token double, byte_share double, entropy double, language string, script string")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (arrow_map(src, run, schema, holds=True)
            .withColumn("base_failed", failed)
            .withColumn("lack", F.log2(F.greatest("n_tokens", F.lit(1))) - F.col("entropy"))
            .withColumn("length_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")))


#: A language code; other values of the column count as none.
LANGUAGE = re.compile("[a-z]{2,3}")


def neighbourhoods(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs (length class, class that counts for it): each class with as many
    neighbours on both sides as together hold MIN_GROUP documents."""
    out = []
    for c in sorted(sizes):
        width = 0
        while (sum(n for m, n in sizes.items() if abs(m - c) <= width) < MIN_GROUP
               and any(abs(m - c) > width for m in sizes)):
            width += 1
        out += [(c, m) for m in sorted(sizes) if abs(m - c) <= width]
    return out


def group_bands(measured: DataFrame) -> dict[str, tuple[list[str], DataFrame]]:
    """Middle and upper spread by group, by length class, the same with neighbours, by
    language, by script, and of all documents; with the columns to join by.

    Values are counted on a grid of a thousandth first, so the exact percentiles
    have bounded state and do not depend on the order of rows. The driver sees
    one row per length class."""
    keys = ["language", "length_class"]
    kept = (measured.where(~F.col("base_failed")).select(*keys, "script", "n_tokens", *MEASURES).distinct())
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, 3).alias("value")) for m in MEASURES])
    counted = saved(kept.select(*keys, "script", F.inline(values)).groupBy(*keys, "script", "measure", "value")
                        .agg(F.count("*").alias("n")), "quality-counts")
    sizes = counted.where(F.col("measure") == MEASURES[0]).groupBy("length_class").agg(F.sum("n").alias("n")).collect()
    pairs = neighbourhoods({r["length_class"]: r["n"] for r in sizes})
    near = measured.sparkSession.createDataFrame(pairs, "for_class int, length_class int")
    by_class = counted.join(F.broadcast(near), "length_class").drop("length_class").withColumnRenamed("for_class", "length_class")

    def spread(rows: DataFrame, by: list[str], name: str, least: int = MIN_GROUP) -> tuple[list[str], DataFrame]:
        at = F.percentile("value", F.array(*map(F.lit, LEVELS)), F.col("n"))
        rows = rows.groupBy(*by, "measure").agg(at.alias("at"), F.sum("n").alias("size"))
        of = lambda m, v: F.max(F.when(F.col("measure") == m, v))
        return by, (rows.where(F.col("size") >= least).groupBy(*by)
                        .agg(F.struct(*[of(m, F.col("at")[0]).alias(f"mid_{m}") for m in MEASURES],
                                      *[of(m, F.col("at")[1] - F.col("at")[0]).alias(f"up_{m}") for m in MEASURES])
                              .alias(name)))

    return {"own": spread(counted, keys, "own"), "by_length": spread(counted, ["length_class"], "by_length"),
            "by_near": spread(by_class, ["length_class"], "by_near", 1), "by_language": spread(counted, ["language"], "by_language"), "by_script": spread(counted, ["script"], "by_script"),
            "of_all": spread(counted.withColumn("every", F.lit(1)), ["every"], "of_all", 1)}


def quality_rules(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str | None = "lang") -> DataFrame:
    """One row per document: base counts, measures, ``base_failed``, ``kept``.

    A null text counts as empty and fails the base rules; null ids and repeated
    rows are judged row by row; a null or odd language falls back to the
    script; an empty table gives no rows; other columns are not looked at.

    The measures are written once to the shared folder. Bands are broadcast:
    their keys are language codes of two or three letters or a listed script,
    times length classes, whatever the size of the corpus.
    """
    return _judged(saved(measure_documents(docs, vocabulary, id_col, text_col, lang_col), "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "entropy", "language")


def keep_good(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass :func:`quality_rules`, with all their
    columns; rows are judged where they stand, without a join back."""
    measured = saved(measure_documents(docs, vocabulary, id_col, text_col, lang_col, carry=True), "quality")
    return _judged(measured).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _judged(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``."""
    scored = measured.withColumn("every", F.lit(1))
    for by, bands in group_bands(measured).values():
        scored = scored.join(F.broadcast(bands), by, "left")

    def z(measure: str, bands: str, least) -> Column:
        spread = F.greatest(F.col(f"{bands}.up_{measure}"), least)
        return (F.col(measure) - F.col(f"{bands}.mid_{measure}")) / spread

    chars = lambda bands, share: F.col(f"{bands}.mid_chars_per_token") * share
    near = F.greatest(z("entropy", "by_near", F.lit(WIDE_BITS)), -z("lack", "by_near", F.lit(WIDE_BITS)))
    z_entropy = F.coalesce(z("entropy", "own", F.lit(MIN_BITS)), z("entropy", "by_length", F.lit(WIDE_BITS)), near, F.lit(0.0))
    z_chars = F.coalesce(z("chars_per_token", "own", chars("own", MIN_CHARS)),
                         z("chars_per_token", "by_language", chars("by_language", WIDE_CHARS)),
                         z("chars_per_token", "by_script", chars("by_script", POOLED_CHARS)),
                         z("chars_per_token", "of_all", chars("of_all", POOLED_CHARS)), F.lit(0.0))
    usual_bytes = F.coalesce(*[f"{b}.mid_byte_share" for b in ("own", "by_language", "by_script", "of_all")], F.lit(1.0))
    outside = ((z_entropy < ENTROPY_BAND) | (z_entropy + z_chars < JOINT_BAND)
               | (F.col("byte_share") - usual_bytes > BYTE_BAND))
    return scored.withColumn("kept", ~F.col("base_failed") & ~outside)
