"""Ranked lexical search of many items at once, by shared partial sums.

A document's score for an item is a sum over the item's terms, so items that
share terms share part of the sum. Items are taken in blocks of bounded size:

1. terms that occur in the same items of the block form one set, an atom; pairs
   of nodes that several items need together become nodes of their own, the most
   frequent first. The result is a graph without cycles in which every shared
   sum is made once (common subexpressions), and each item is a sum of few nodes;
2. documents are read once into postings of the block's terms, from which the
   statistics of the whole corpus follow;
3. each document's accumulators, its sums over the atoms, are written once;
4. they are combined along the graph, for many documents at a time, and each
   task keeps the best of its documents for every item.

Term weights, saturation and length are whole numbers, so any order of sums
gives the same score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.common import arrow_map, prepare, renamed, running_sum, saved

#: Links between items and terms of one block: bounds the driver's part, the
#: broadcast dictionary and the graph (an item with more is a block of its own).
BLOCK_LINKS = 1 << 14
#: Documents combined at a time.
LANES = 512
#: Groups that the tasks' best are ranked in before the last ranking.
SALTS = 64

#: What separates terms, as bytes; A-Z become a-z, bytes of other scripts stay.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in turn: runs of letters and digits, A-Z in lower case."""
    return (text or "").encode().translate(_SPLIT).split()


class Graph:
    """Shared sums of a block of items.

    ``atom_of``: the atom of each term. ``sums``: nodes to be made, in order,
    each of two earlier ones; nodes below ``atoms`` are the atoms. ``parts``:
    the nodes that make up each item.
    """

    def __init__(self, items: list[list[int]], n_terms: int):
        holders: list[list[int]] = [[] for _ in range(n_terms)]
        for i, item in enumerate(items):
            for t in item:
                holders[t].append(i)
        atoms: dict[tuple[int, ...], int] = {}
        self.atom_of = np.array([atoms.setdefault(tuple(h), len(atoms)) for h in holders], np.int32)
        self.atoms = len(atoms)
        parts = [set() for _ in items]
        for held, atom in atoms.items():
            for i in held:
                parts[i].add(atom)
        self.sums: list[tuple[int, int]] = []
        self._share(parts)
        self.parts = [sorted(p) for p in parts]

    def _share(self, parts: list[set[int]]) -> None:
        """Take the pair of nodes that most items need together, until no two do."""
        wanted = Counter(a for p in parts for a in p)
        count: Counter = Counter()
        where: dict[int, set[int]] = {}
        for i, p in enumerate(parts):
            shared = sorted(a for a in p if wanted[a] > 1)
            for k, a in enumerate(shared):
                where.setdefault(a, set()).add(i)
                count.update((a, b) for b in shared[k + 1:])
        heap = [(-n, pair) for pair, n in count.items() if n > 1]
        heapq.heapify(heap)
        while heap:
            n, (a, b) = heapq.heappop(heap)
            if -n != count[a, b]:
                if count[a, b] > 1:
                    heapq.heappush(heap, (-count[a, b], (a, b)))
                continue
            node = self.atoms + len(self.sums)
            self.sums.append((a, b))
            both = where[a] & where[b]
            where[node] = both
            grown: Counter = Counter()
            for i in both:
                parts[i] -= {a, b}
                for x in parts[i]:
                    if x in where:
                        for y in (a, b):
                            count[min(x, y), max(x, y)] -= 1
                        grown[x, node] += 1
                parts[i].add(node)
            count[a, b] = 0
            where[a] -= both
            where[b] -= both
            count.update(grown)
            for pair, k in grown.items():
                if k > 1:
                    heapq.heappush(heap, (-k, pair))

    @property
    def nodes(self) -> int:
        return self.atoms + len(self.sums)


def item_links(items: DataFrame) -> DataFrame:
    """``item_id, term`` for the distinct terms of every item, with ``block``."""
    def run(batch: pa.RecordBatch):
        found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), list(map(len, found)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([t for f in found for t in f], pa.binary())],
                                         names=["item_id", "term"])

    links = saved(arrow_map(items, run, "item_id long, term binary").distinct(), "lexical-links")
    sizes = links.groupBy("item_id").agg(F.count("*").alias("n"))
    placed = running_sum(sizes, [F.col("item_id")], "n", "before", "lexical-items")
    # an item's block is that of its last link
    blocks = placed.select(F.col("item_id").alias("_item"), F.expr(f"(before + n - 1) div {BLOCK_LINKS}").alias("block"))
    return saved(links.join(blocks, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "term", "block"),
                 "lexical-links")


def postings(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: of every document its number of terms, and how
    often it holds each of the terms in ``index``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch):
        find = shared.value.get
        n, flat, tfs, ends = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            found = terms(text)
            n.append(len(found))
            counts = Counter(map(find, found))
            counts.pop(None, None)
            flat += counts.keys()
            tfs += counts.values()
            ends.append(len(flat))
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())),
                                          pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return arrow_map(docs, run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def accumulators(found: DataFrame, graph: Graph, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, nodes, sums``: each document's partial score over each atom of
    which it holds a term."""
    atom_of, atoms = graph.atom_of, graph.atoms

    def run(batch: pa.RecordBatch):
        t, row = _flat(batch.column(2))
        tf = _flat(batch.column(3))[0].astype(np.int64)
        if not len(t):
            return
        m = 10 + (90 * batch.column(1).to_numpy() * n_docs) // n_terms
        part = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        place = row.astype(np.int64) * atoms + atom_of[t]
        order = np.argsort(place, kind="stable")
        place, starts = np.unique(place[order], return_index=True)
        sums = np.add.reduceat(part[order], starts)
        rows, ends = np.unique(place // atoms, return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array((place % atoms).astype(np.int32))),
             pa.ListArray.from_arrays(ends, pa.array(sums))], names=["doc_id", "nodes", "sums"])

    return arrow_map(found, run, "doc_id long, nodes array<int>, sums array<long>")


class Best:
    """The best documents of every item so far: highest score, then smallest id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.ids, self.nulls = list(self.scores), [np.zeros(0, bool)] * n_items
        self.least = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores``: a row for each item."""
        hits = scores >= self.least[:, None]
        for i in np.flatnonzero(hits.any(axis=1)):
            at = np.flatnonzero(hits[i])
            s, d, o = (np.concatenate(x) for x in ((self.scores[i], scores[i, at]), (self.ids[i], ids[at]), (self.nulls[i], nulls[at])))
            best = np.lexsort((d, o, -s))[:self.k]
            self.scores[i], self.ids[i], self.nulls[i] = s[best], d[best], o[best]
            if len(best) == self.k:
                self.least[i] = s[best[-1]]


def best_documents(partial: DataFrame, graph: Graph, item_ids: list[int | None], k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` of every task's documents."""
    parts, sums, atoms, nodes = graph.parts, graph.sums, graph.atoms, graph.nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(parts), k)
        for batch in batches:
            for a in range(0, batch.num_rows, LANES):
                rows = batch.slice(a, LANES)
                node, lane = _flat(rows.column(1))
                made = np.zeros((nodes, rows.num_rows), np.int64)
                made[node, lane] = _flat(rows.column(2))[0]
                for j, (x, y) in enumerate(sums, atoms):
                    np.add(made[x], made[y], out=made[j])
                scores = np.array([made[p].sum(axis=0) for p in parts])
                ids = rows.column(0)
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        at = np.repeat(np.arange(len(parts)), list(map(len, best.ids)))
        ids = pa.array(np.concatenate(best.ids), pa.int64(), mask=np.concatenate(best.nulls))
        salt = pa.array(np.full(len(at), TaskContext.get().partitionId() % SALTS, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([item_ids[i] for i in at], pa.int64()), ids,
                                          pa.array(np.concatenate(best.scores)), salt], names=["item_id", "doc_id", "score", "salt"])

    return partial.mapInArrow(run, "item_id long, doc_id long, score long, salt int")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    With N documents that hold a term, L terms in all and n in this one, a term
    with df documents that occurs tf times adds
    ``floor(1000 ln((2N+2) / (2df+1))) * (10^9 tf div (1000 tf + 8 (10 + 90nN div L)))``.
    Only scores above 0 count; ties go to the smaller id, null ids last. Null or
    empty texts hold no terms; rows that repeat an id are documents of their own;
    items that share an id (null too) are one item with the terms of all. No
    documents or no items give no rows. Other columns are not looked at.
    """
    spark = prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    links = item_links(renamed(items, item_id=item_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("long")))
    blocks = sorted(r["block"] for r in links.select("block").distinct().collect())
    found = [_search_block(src, links.where(F.col("block") == b).collect(), k) for b in blocks]
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame(
        [], "item_id long, doc_id long, score long, salt int")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, links: list, k: int) -> DataFrame:
    """The tasks' best documents for the items of a block."""
    index = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in links}))}
    items: dict[int | None, list[int]] = {}
    for r in links:
        items.setdefault(r["item_id"], []).append(index[bytes(r["term"])])
    graph = Graph(list(items.values()), len(index))
    found = saved(postings(docs, index), "lexical-postings")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r["t"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    partial = saved(accumulators(found, graph, weights, n_docs, n_terms), "lexical-accumulators")
    return saved(best_documents(partial, graph, list(items), k), "lexical-best")
