"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.session import scratch_path, ship_package

#: Bytes of text that one Python step holds in numpy form at a time.
SLICE_BYTES = 2 << 20
#: Arrow batches to Python stages: rows and bytes (a batch of long documents must fit a worker).
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20

#: ASCII white space as a character class body: what separates words.
SPACE = r"\x20\x09-\x0D"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and bound Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """The one large object (a tokenizer with its caches) that a Python worker
    keeps from task to task. Another one takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
              schema: str | T.StructType, holds: bool = False) -> DataFrame:
    """``mapInArrow`` with a function from one batch to batches. Workers serve
    one stage after the other: what they have :func:`held` goes, unless this one
    ``holds`` something itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            _HELD.clear()
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about ``limit`` characters (one row at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


#: Rows of a small table's part.
PART_ROWS = 100_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts
    lineage, survives lost executors, and is computed once. ``rows``, a known
    bound of its size, makes parts of ``PART_ROWS`` rows (one per task slot at
    least), so that small steps of an iteration are few tasks."""
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables written by :func:`saved` that nothing reads any more: a
    step of an iteration whose outcome is itself written."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            store, root = filesystem(path)
            store.delete_dir(root)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null, native."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE}]+"))).cast("long")


def renamed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns
    of the input, whatever they are called, never reach its joins."""
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


#: Bytes that a cached segment takes besides its own and its ids'.
ENTRY_BYTES = 200


class PieceCache:
    """Token ids of text segments, kept in flat arrays so that a whole slice of
    documents is gathered at once. ``encode`` turns new segments into id lists.
    Emptied when it holds about ``limit`` bytes, keys and ids included."""

    def __init__(self, encode: Callable[[list], list], limit: int = 112 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = self.bytes = 0

    def _add(self, segments: list) -> None:
        lists = self.encode(segments)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        self.bytes += sum(map(len, segments)) + 4 * len(ids) + ENTRY_BYTES * len(segments)
        k, need = len(self.at), self.used + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(lists) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used:need] = ids
        self.starts[k:k + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k:k + len(lists)] = sizes
        self.used = need
        self.at.update(zip(segments, range(k, k + len(segments)), strict=True))

    def ids(self, segments: list, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in turn, and how many each text has."""
        if self.bytes > self.limit:
            self.clear()
        k = np.fromiter(map(self.at.get, segments, repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(k < 0).tolist()
        if missing:
            self._add(list(dict.fromkeys([segments[i] for i in missing])))
            k[missing] = [self.at[segments[i]] for i in missing]
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[k] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)


def filesystem(uri: str):
    """The file system of a folder in shared storage, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, name: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, in the
    given order, and the rows written in that order.

    Rows are range-partitioned by the order; each task adds up its own range
    and one total per range goes through the driver. The order should end in
    something unique, so that no run of equal rows fills a range.
    """
    columns = df.schema
    part = T.StructType([*columns, T.StructField(out, T.LongType()), T.StructField("_part", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = 0, TaskContext.get().partitionId()
        for b in batches:
            v = b.column(columns.fieldNames().index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(v)
            if len(ends):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v), pa.array(np.full(len(v), at, np.int32))],
                                             names=[f.name for f in part])

    prepare(df.sparkSession)
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, part), name)
    totals = ranged.groupBy("_part").agg((F.max(F.col(out) + F.col(value))).alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(totals, key=lambda r: r["_part"]):
        offsets.append((r["_part"], before))
        before += r["n"]
    if not offsets:
        return ranged.drop("_part")
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return (ranged.join(F.broadcast(table), "_part").withColumn(out, F.col(out) + F.col("_before"))
                  .select(*columns.fieldNames(), out))
