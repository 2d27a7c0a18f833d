"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves, each quantised with its own codebook; a pair of centroids is a cell. A query walks the
cells in the order of the summed distance of its halves to the two centroids, by a heap over the two sorted lists (the
multi-sequence walk), until the cells hold the wanted share of all vectors. Their entries are ranked again by the exact
Euclidean distance in double precision.

The codebooks, and the share that finds ``recall`` of the true neighbours, are fitted on a bounded sample; every vector is
indexed. Equal vectors are one entry with its smallest identifiers (k + 1 are enough for any query), so that a vector
that a third of the rows share is one entry. Neighbouring cells are joined, and large ones cut, into blocks of about
BLOCK_ROWS entries, and queries into parts of about BLOCK_QUERIES; a group of work is a block and a part of whose queries
at least one walks through the block, and keeps no more than k results of a query. A block goes only to the parts that ask
for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, written
from .learning import bounded_sample

SAMPLE_BOUND = 4096
RECALL = 0.95
MOST_CENTROIDS = 256
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebooks:
    left: np.ndarray
    right: np.ndarray
    share: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return x[:, :h], x[:, h:]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their centroids, but for a constant per row."""
        a, b = self.halves(x)
        return (self.left**2).sum(axis=1) - 2 * a @ self.left.T, (self.right**2).sum(axis=1) - 2 * b @ self.right.T

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, want: float) -> list[int]:
        """Cells with entries, nearest first, until they hold ``want`` entries; a and b are one query's distances."""
        i_of, j_of = a.argsort(kind="stable"), b.argsort(kind="stable")
        heap, seen, out, have = [(a[i_of[0]] + b[j_of[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and have < want:
            _, i, j = heapq.heappop(heap)
            cell = int(i_of[i]) * len(b) + int(j_of[j])
            if size[cell]:
                out.append(cell)
                have += int(size[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[i_of[x]] + b[j_of[y]], x, y))
        return out


def fit(sample: np.ndarray, n: int, k: int, recall: float = RECALL, probes: int = 128) -> Codebooks:
    """Codebooks for n vectors, and the share of entries to walk that finds ``recall`` of the sample's own neighbours."""
    size = int(min(MOST_CENTROIDS, max(2, round((n / 8) ** 0.5)), max(2, len(sample) // 4)))  # about eight entries a cell, as far as codebooks go
    half = max(1, sample.shape[1] // 2)
    books = Codebooks(kmeans(sample[:, :half], size), kmeans(sample[:, half:], size, seed=4) if sample.shape[1] > 1 else np.zeros((1, 0)), 1.0)
    if len(sample) <= k + 1:
        return books
    cells = books.cells(sample)
    held = np.bincount(cells, minlength=len(books.left) * len(books.right))
    a, b = books.distances(sample)
    need = []
    for q in range(0, len(sample), max(1, len(sample) // probes)):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argpartition(d, k - 1)[:k]
        order = books.walk(a[q], b[q], held, np.inf)
        before = dict(zip(order, np.cumsum(held[order])))
        need += [before[c] / len(sample) for c in cells[near].tolist()]
    books.share = float(np.quantile(need, recall))
    return books


def blocks_of(held: np.ndarray, most: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: runs of cells share a block of up to ``most`` entries, a larger cell
    has blocks of its own."""
    first, pieces = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    block, room = 0, most
    for c, n in enumerate(held.tolist()):
        if n > most:
            block += room < most
            first[c], pieces[c] = block, -(-n // most)
            block, room = block + int(pieces[c]), most
        else:
            if n > room:
                block, room = block + 1, most
            first[c], room = block, room - n
    return first, pieces


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, recall: float = RECALL, sample_bound: int = SAMPLE_BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found vectors of another id, by Euclidean distance.

    Nearest first from rank 1, ties to the smaller id; all candidates if there are fewer than k. Vectors or queries that
    are null, zero, or hold a null or non-finite component take no part, nor do null ids or lengths other than the
    commonest. Rows that repeat an id and vector count once; an id with several vectors is ranked with each of them. No
    vectors or no queries: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)  # NaN is above all numbers
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & sound)
    rows, asked = clean(vectors), clean(queries).distinct()
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["d"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    # Only the smallest k + 1 ids of equal vectors can be in a result; the rank limit runs before the exchange too.
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("one", F.element_at("ids", 1)), "vectors")
    n = entries.count()
    sample = bounded_sample(entries, "one", sample_bound).select("one", "v").toArrow().sort_by("one")
    books = fit(_matrix(sample.column("v").combine_chunks(), dim), n, k, recall)
    shared = spark.sparkContext.broadcast(books)  # at most 2 x 256 centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = shared.value.cells(_matrix(b.column("v"), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], names=["cell", "ids", "v"])

    index = written(entries.select("ids", "v").mapInArrow(assign, "cell int, ids array<long>, v array<double>"), "multi-index")
    held = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in index.groupBy("cell").count().collect():  # at most 256 x 256 cells
        held[r["cell"]] = r["count"]
    m = asked.count()
    query_blocks = max(1, -(-m // BLOCK_QUERIES))
    first, pieces = blocks_of(held)
    layout = spark.sparkContext.broadcast((held, first, pieces))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = shared.value
        size, start, own = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            a, c = b_.distances(_matrix(b.column("v"), dim))
            block, cells, at = [], [], []
            for q in range(b.num_rows):
                by_block: dict[int, list[int]] = {}
                for x in b_.walk(a[q], c[q], size, b_.share * size.sum()):
                    for s in range(int(own[x])):
                        by_block.setdefault(int(start[x]) + s, []).append(x)
                block += by_block.keys()
                cells += by_block.values()
                at += [q] * len(by_block)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32())), b.column("part").take(take), b.column("id").take(take), b.column("v").take(take)], names=["block", "cells", "part", "id", "v"])

    parted = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    wide = max(query_blocks, spark.sparkContext.defaultParallelism)  # a walk is dear and a query small: tasks by number, not by bytes
    probes = written(parted.select("part", "id", "v").repartition(wide, "id").mapInArrow(probe, "block int, cells array<int>, part int, id long, v array<double>"), "probes")
    asked_for = written(probes.select("block", "part").distinct(), "asked-for")
    by_cell = spark.createDataFrame([(int(c), int(first[c]), int(pieces[c])) for c in np.flatnonzero(held)], "cell int, first int, pieces int")
    block = (F.col("first") + F.pmod(F.xxhash64("v"), F.col("pieces"))).cast("int")
    placed = written(index.join(F.broadcast(by_cell), "cell").select("cell", block.alias("block"), "ids", "v"), "blocks")  # at most 256 x 256 cells
    dealt = placed.join(asked_for, "block")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v").combine_chunks(), dim), left.column("ids").to_pylist()
            cells, cell_at = np.unique(left.column("cell").to_numpy(), return_inverse=True)
            asked_ = zip(right.column("id").to_pylist(), right.column("cells").to_pylist(), _matrix(right.column("v").combine_chunks(), dim))
            for q, walked, y in asked_:
                rows_ = np.flatnonzero(np.isin(cells, walked)[cell_at])
                d = np.sqrt(((x[rows_] - y) ** 2).sum(axis=1))
                near = np.arange(len(d)) if len(d) <= k + 1 else np.flatnonzero(d <= np.partition(d, k)[k])
                for s, i in sorted((d[e], i) for e in near.tolist() for i in ids[rows_[e]] if i != q)[:k]:
                    out_q.append(q), out_v.append(i), out_s.append(float(s))
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    keys = ["block", "part"]
    found = dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
