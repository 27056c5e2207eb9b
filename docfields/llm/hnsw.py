"""Nearest neighbours by inner product on one navigable graph per shard.

Equal vectors are one node. Nodes fall into shards by hash; each shard is
indexed by its own hierarchical navigable small-world graph, stored as flat
neighbour arrays in one file of the shared folder. Queries visit every shard in
batches; the shards' answers are scored again on the original vectors in double
precision and merged.

Inner products become distances by one more coordinate that brings all vectors
of a graph to the same norm: then the nearest is the one of largest product. A
shard has a graph for each class of norms, so that this norm stays near the
vectors' own and single precision tells neighbours apart.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import arrow_map, filesystem, prepare, renamed, saved
from docfields.session import scratch_path

#: Neighbours per node (twice as many on the lowest level), and width of the beams.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 112
#: Nodes of a shard; with fewer in all, shards are made for the cluster's slots. What the
#: beam finds falls with the size of a graph: of the 21 nearest 0.93 in one of 16,384 nodes
#: (random directions of 64 dimensions), 0.86 of 32,768, 0.81 of 51,282 (given vectors).
SHARD_NODES = 1 << 13
#: Bits of norm that a graph spans: its longest vector is up to 16 times its shortest.
NORM_BITS = 4
SEED = 3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of norm 1 of the same directions; the largest component goes
    first, so that no square is too large or too small for a double."""
    x = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0.0), np.finfo(np.float64).tiny)[:, None]
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.finfo(np.float64).tiny)[:, None]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors, as parts of the longest, with the coordinate that makes all norms 1."""
    x = vectors / np.maximum(np.abs(vectors).max(initial=0.0), np.finfo(np.float64).tiny)
    norms = np.einsum("ij,ij->i", x, x)
    most = max(norms.max(initial=0.0), np.finfo(np.float64).tiny)
    more = np.sqrt(np.maximum(most - norms, 0.0))
    return (np.concatenate([x, more[:, None]], axis=1) / np.sqrt(most)).astype(np.float32)


def norm_class(x: np.ndarray) -> int:
    """Class of a vector's norm; norms near 1 are in the middle of theirs."""
    most = np.abs(x).max()
    part = x / most
    return int(np.round((np.log2(most) + np.log2(part @ part) / 2) / NORM_BITS))


def levels_of(n: int) -> np.ndarray:
    """Level of each node, geometric with base LINKS; node 0 is on the top one."""
    u = np.random.default_rng(SEED).random(n)
    level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)), 8).astype(np.int64)
    if n:
        level[0] = level.max()
    return level


def beam_search(x: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int,
                chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes of one level for each query, by best-first search,
    all queries in step. ``table``: neighbours by node, -1 where none.
    Products are compared: on vectors of equal norm the largest is the nearest.
    """
    found = [_beam(x, table, queries[a:a + chunk], entry[a:a + chunk], width) for a in range(0, len(queries), chunk)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _beam(x, table, queries, entry, width):
    n, degree = len(queries), table.shape[1]
    seen = np.zeros((n, len(x) + 1), bool)
    rows = np.arange(n)
    ids = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    ids[:, 0], open_[:, 0] = entry, True
    near[:, 0] = np.einsum("ij,ij->i", x[entry], queries)
    seen[rows, entry] = True
    while True:
        # the best node of each beam that was not expanded yet
        score = np.where(open_, near, -np.inf)
        best = score.argmax(axis=1)
        live = np.flatnonzero(score[rows, best] > -np.inf)
        if not live.size:
            return ids, near
        node = ids[live, best[live]]
        open_[live, best[live]] = False
        around = table[node]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        seen[live[:, None], np.where(around >= 0, around, len(x))] = True
        gain = np.einsum("ijk,ik->ij", x[around], queries[live])
        gain = np.where(fresh, gain, -np.inf).astype(np.float32)
        all_near = np.concatenate([near[live], gain], axis=1)
        all_ids = np.concatenate([ids[live], around], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        pick = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[live] = np.take_along_axis(all_near, pick, 1)
        ids[live] = np.where(near[live] > -np.inf, np.take_along_axis(all_ids, pick, 1), -1)
        open_[live] = np.take_along_axis(all_open, pick, 1) & (near[live] > -np.inf)


def diverse(x: np.ndarray, node: int, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by nearness, those nearer to the node than to any
    chosen before; filled up with the nearest of the rest."""
    near = near[:4 * most]
    to_node = x[near] @ x[node]
    among = x[near] @ x[near].T
    chosen, rest = [], []
    for i in range(len(near)):
        if len(chosen) == most:
            break
        if chosen and among[i, chosen].max() > to_node[i]:
            rest.append(i)
        else:
            chosen.append(i)
    return near[chosen + rest[:most - len(chosen)]]


class Graph:
    """Index of one shard."""

    def __init__(self, x: np.ndarray, level: np.ndarray, tables: list[np.ndarray]):
        self.x, self.level, self.tables = x, level, tables

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Nodes come in batches that double the graph at most; a batch searches
        the graph as it stands, and its own nodes among each other exactly."""
        x = lifted(vectors)
        n = len(x)
        level = levels_of(n)
        tables = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        out = cls(x, level, tables)
        at = 0
        while at < n:
            upto = min(n, at + max(64, min(at, 1024)))
            out._insert(np.arange(at, upto))
            at = upto
        return out

    def _insert(self, batch: np.ndarray) -> None:
        entry = np.zeros(len(batch), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            table, members = self.tables[k], batch[self.level[batch] >= k]
            old, here = None, batch
            if batch[0] > 0:
                ids, near = beam_search(self.x, table, self.x[here], entry, BUILD_BEAM if len(members) else 1)
                entry = ids[np.arange(len(here)), near.argmax(axis=1)]
                old = (ids, near)
            if not len(members):
                continue
            pos = np.searchsorted(batch, members)
            own = self.x[members] @ self.x[members].T
            np.fill_diagonal(own, -np.inf)
            inner = np.argsort(-own, axis=1)[:, :BUILD_BEAM]
            touched: dict[int, list[int]] = {}
            for r, node in enumerate(members):
                cand, score = members[inner[r]], own[r, inner[r]]
                if old is not None:
                    cand, score = np.concatenate([cand, old[0][pos[r]]]), np.concatenate([score, old[1][pos[r]]])
                use = score > -np.inf
                cand, score = cand[use], score[use]
                links = diverse(self.x, node, cand[np.argsort(-score, kind="stable")], LINKS)
                table[node, :len(links)] = links
                for other in links.tolist():
                    touched.setdefault(other, []).append(int(node))
            for other, nodes in touched.items():
                now = table[other][table[other] >= 0]
                both = np.unique(np.concatenate([now, np.array(nodes, now.dtype)]))
                both = both[both != other]
                if len(both) > table.shape[1]:
                    both = both[np.argsort(-(self.x[both] @ self.x[other]), kind="stable")]
                    both = diverse(self.x, other, both, table.shape[1])
                table[other] = -1
                table[other, :len(both)] = both

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.concatenate([unit(queries), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        entry = np.zeros(len(q), np.int64)
        for table in self.tables[:0:-1]:
            ids, near = beam_search(self.x, table, q, entry, 4)
            entry = ids[np.arange(len(q)), near.argmax(axis=1)]
        return beam_search(self.x, self.tables[0], q, entry, min(width, max(1, len(self.x))))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """``id, key, dim, norm`` of the vectors that take part; ``key``: their bytes
    as doubles, ``norm``: the class of their norm."""
    def run(batch: pa.RecordBatch):
        ids, keys, dims, norms = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64) + 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                keys.append(x.astype("<f8").tobytes())
                dims.append(len(x))
                norms.append(norm_class(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()),
                                          pa.array(norms, pa.int32())], names=["id", "key", "dim", "norm"])

    return arrow_map(vectors, run, "id long, key binary, dim int, norm int")


def node_rows(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors ``key, dim, norm`` with ``members``, their ``k`` + 1 smallest
    ids: more are never asked for. Equal vectors are ranked in 64 salted parts
    first, so one that holds a third of all rows is dealt out too."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = salted.withColumn("r", first("key", "salt")).where(F.col("r") <= k + 1)
    return (part.withColumn("r", first("key")).where(F.col("r") <= k + 1)
                .groupBy("key", "dim", "norm").agg(F.sort_array(F.collect_list("id")).alias("members")))


def write_graphs(nodes: DataFrame, folder: str, shards: int) -> DataFrame:
    """Build each graph of a shard (one for a class of norms) in one task and
    write it to a file: ``dim, shard, norm, file``. Files are named by their content and moved into place when
    whole, so a lost or repeated task does no harm."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        rows = rows.sort_values("key")
        vectors = np.frombuffer(b"".join(rows["key"]), "<f8").reshape(len(rows), -1)
        graph = Graph.build(vectors)
        buffer = io.BytesIO()
        np.savez(buffer, vectors=vectors, starts=np.cumsum([0, *map(len, rows["members"])]),
                 members=np.concatenate(list(rows["members"])), level=graph.level,
                 **{f"table{i}": t for i, t in enumerate(graph.tables)})
        data = buffer.getvalue()
        dim, shard, norm = (int(rows[c].iloc[0]) for c in ("dim", "shard", "norm"))
        name = f"graph-{dim}-{shard}-{norm}-{xxhash.xxh3_64_hexdigest(data)}.npz"
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(data)
        store.move(draft, f"{root}/{name}")
        return pd.DataFrame({"dim": [dim], "shard": [shard], "norm": [norm], "file": [name]})

    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return sharded.groupBy("dim", "shard", "norm").applyInPandas(build, "dim int, shard int, norm int, file string")


@lru_cache(1)
def loaded(folder: str, name: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's graph from its file; a worker holds one at a time."""
    store, root = filesystem(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        data = np.load(io.BytesIO(f.read()))
    tables = [data[f"table{i}"] for i in range(sum(x.startswith("table") for x in data.files))]
    return Graph(lifted(data["vectors"]), data["level"], tables), data["vectors"], data["starts"], data["members"]


def search_graphs(queries: DataFrame, graphs: DataFrame, folder: str, k: int, beam: int) -> DataFrame:
    """Each shard's ``k`` best rows for each query (``id, key``): ``query_id,
    query, vec_id, score``. Queries go to shards in blocks; a task reads the
    graphs of its blocks from their files one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = np.array(batch.column(2).to_pylist())
            for name in dict.fromkeys(files.tolist()):
                rows = np.flatnonzero(files == name)
                ids = [batch.column(0)[int(r)].as_py() for r in rows]
                keys = [batch.column(1)[int(r)].as_py() for r in rows]
                graph, vectors, starts, members = loaded(folder, name)
                q = np.frombuffer(b"".join(keys), "<f8").reshape(len(rows), -1)
                found, near = graph.search(q, max(beam, k + 1))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, (own, key) in enumerate(zip(ids, keys, strict=True)):
                    nodes = found[i][found[i] >= 0]
                    score = vectors[nodes] @ q[i]
                    best = np.argsort(-score, kind="stable")[:k + 1]
                    hits = sorted((-float(score[b]), int(v)) for b in best
                                  for v in members[starts[nodes[b]]:starts[nodes[b] + 1]] if v != own)[:k]
                    out[0].extend([own] * len(hits))
                    out[1].extend([key] * len(hits))
                    out[2].extend(v for _, v in hits)
                    out[3].extend(-s for s, _ in hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.float64())], names=["query_id", "query", "vec_id", "score"])

    dealt = (queries.join(graphs, "dim").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(64)))
                    .repartition("file", "block").sortWithinPartitions("file").select("id", "key", "file"))
    return dealt.mapInArrow(run, "query_id long, query binary, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            beam: int = SEARCH_BEAM, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` (columns
    as ``vectors``) its ``k`` rows of ``vectors`` of largest inner product that
    the graphs find, not counting rows of its own id; ties go to smaller ids.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers take
    no part, nor do rows without an id; vectors of other lengths are other
    spaces. Rows that repeat an id and its vector count once; an id with
    several vectors is searched for with each. Empty tables give no rows; other
    columns are not looked at. The driver sees one row per graph: shards times
    classes of norms, of which doubles have 540 at most and real tables a few.
    """
    spark = prepare(vectors.sparkSession)
    rows = saved(valid_rows(renamed(vectors, id=id_col, v=vector_col)), "hnsw-rows")
    nodes = saved(node_rows(rows, k), "hnsw-nodes")
    shards = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // shard_nodes))
    folder = scratch_path(spark, "hnsw-graphs")
    files = write_graphs(nodes, folder, shards).collect()
    if not files:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graphs = F.broadcast(spark.createDataFrame(files, "dim int, shard int, norm int, file string").select("dim", "file"))
    asked = valid_rows(renamed(queries, id=id_col, v=vector_col)).distinct()
    found = search_graphs(asked, graphs, folder, k, beam)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
