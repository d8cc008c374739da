"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a vector's cell is
its pair of nearest centroids. A query visits the cells in descending order of the
summed inner products of its halves with the pair's centroids, found with a heap,
until it has met a share of all distinct vectors; what lies in those cells is
reranked by the exact measure. The share is the smallest that reaches a target
recall against brute force on the sample that the codebooks are fitted on.

Equal vectors are one entry with its smallest ids, so a vector that a third of all
rows hold costs one comparison. Entries and queries meet in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, some


@dataclass
class Index:
    books: list[np.ndarray]  # two arrays (K, dim of the half)
    share: float
    recall: float


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vec)``: rows with an id and a finite non-zero vector of the most common
    length; the others take no part."""
    v = F.col(vector_col)
    inf = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    own = rows.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(finite).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>").alias("vec"))
    sizes = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("vec") == (sizes[0] if sizes else 0))


def classes(own: DataFrame, k: int) -> DataFrame:
    """``(vec, ids)``: distinct vectors with their ``k`` smallest distinct ids. Batches,
    then salts, then vectors are merged, so no group of equal vectors meets whole."""

    def rows(batch: pa.RecordBatch) -> dict:
        found: dict[tuple, set] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(tuple(v), set()).add(i)
        return {"vec": [list(v) for v in found], "ids": [sorted(s)[:k] for s in found.values()]}

    def least(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k).alias("ids"))

    salted = arrow_map(own, ["vec_id", "vec"], "vec array<float>, ids array<long>", rows).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64)))
    return least(least(salted, "vec", "salt"), "vec")


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)


def _book(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, book)
        for k in range(len(book)):
            if (own == k).any():
                book[k] = x[own == k].mean(axis=0)
    return book


def cells(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    h = books[0].shape[1]
    return _nearest(x[:, :h], books[0]) * len(books[1]) + _nearest(x[:, h:], books[1])


def traverse(q: np.ndarray, books: list[np.ndarray]) -> Iterator[int]:
    """Cells in descending order of the summed inner products, by a heap over the two
    halves' sorted lists: a pair enters when its left or upper neighbour has left."""
    h = books[0].shape[1]
    first, second = books[0] @ q[:h], books[1] @ q[h:]
    order = [np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()]
    a, b = first[order[0]].tolist(), second[order[1]].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield order[0][i] * len(b) + order[1][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def fit(sample: np.ndarray, centroids: int, k: int, target: float, rounds: int = 10, seed: int = 3) -> Index:
    """Codebooks of ``sample`` and the share of entries a query must meet for ``target``
    recall of the ``k`` nearest, measured on up to 200 of its vectors."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    books = [_book(x, centroids, rounds, rng) for x in (sample[:, :half], sample[:, half:])]
    own = cells(sample, books)
    counts = np.bincount(own, minlength=len(books[0]) * len(books[1]))
    need = []  # share met until each true neighbour is
    for i in rng.choice(len(sample), min(200, len(sample)), replace=False):
        score = sample @ sample[i]
        score[i] = -np.inf
        order = np.array(list(traverse(sample[i], books)))
        met = np.empty(len(order))
        met[order] = np.cumsum(counts[order]) / len(sample)
        near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        need.append(met[own[near]])
    need = np.sort(np.concatenate(need)) if need else np.ones(0)
    share = float(need[min(len(need) - 1, int(target * len(need)))]) if len(need) else 1.0
    return Index(books, share, float((need <= share).mean()) if len(need) else 1.0)


def search(rows: DataFrame, query_every: int, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 8192, centroids: int = 32, target: float = 0.96, entry_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id
    ``query_every`` divides, among all rows but those with its own id.

    About ``sample_rows`` distinct vectors fit the codebooks. Repeated rows count once; an id with several vectors is a candidate with
    each and a query with the least. Null or unusable vectors take no part; an empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    own = valid(rows, id_col, vector_col)
    entries = cut(classes(own, k + 1))
    chosen = sorted(r[0] for r in some(entries.select("vec"), sample_rows).collect())
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array(chosen, dtype=np.float64)
    size = sample.shape[1]
    index = fit(sample, centroids, k, target)
    books = index.books

    def assign(batch: pa.RecordBatch) -> dict:
        return {"vec": batch.column(0), "ids": batch.column(1), "cell": cells(_matrix(batch.column(0), size), books).astype(np.int32)}

    placed = arrow_map(entries, ["vec", "ids"], "vec array<float>, ids array<long>, cell int", assign)
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, n in placed.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[cell] = n
    # Cells fill blocks of entry_block vectors; a larger cell has several blocks of its own.
    base, parts, block, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c in np.flatnonzero(counts):
        if filled and filled + counts[c] > entry_block:
            block, filled = block + 1, 0
        base[c], parts[c] = block, -(-counts[c] // entry_block)
        filled += counts[c]
        if parts[c] > 1:
            block, filled = block + parts[c], 0
    blocks = int((base + parts).max())
    enough = index.share * counts.sum()
    plan = [(int(b), int(p)) for b, p in zip(base, parts, strict=True)]
    bases, widths = (F.array(*[F.lit(x[i]) for x in plan]) for i in (0, 1))
    cell = F.col("cell") + 1
    held = placed.withColumn("block", F.element_at(bases, cell) + F.pmod(F.xxhash64("vec"), F.element_at(widths, cell)))

    def visit(batch: pa.RecordBatch) -> dict:
        out = []
        for q in _matrix(batch.column(1), size):
            seen, met = np.zeros(len(counts), bool), 0
            for c in traverse(q, books):
                if counts[c]:
                    seen[c] = True
                    met += counts[c]
                    if met >= enough:
                        break
            out.append(np.packbits(seen).tobytes())
        return {"query_id": batch.column(0), "vec": batch.column(1), "seen": out}

    asked = own.filter(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    queries = cut(arrow_map(asked, ["query_id", "vec"], "query_id long, vec array<float>, seen binary", visit))
    q_blocks = max(1, -(-queries.count() // query_block))
    asks = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meets = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        made: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("cell")
            e, own_cell, ids = _matrix(left["vec"], size), left["cell"].to_numpy(), left["ids"].to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(own_cell)) + 1).tolist(), len(own_cell)]
            q_all, seen_all, names = _matrix(right["vec"], size), right["seen"].to_pylist(), right["query_id"].to_pylist()
            for at in range(0, len(names), 256):
                q = q_all[at : at + 256]
                seen = np.unpackbits(np.frombuffer(b"".join(seen_all[at : at + 256]), np.uint8).reshape(len(q), -1), axis=1)
                score = np.full((len(q), len(e)), -np.inf)
                for lo, hi in zip(edges, edges[1:], strict=False):
                    who = np.flatnonzero(seen[:, own_cell[lo]])
                    score[who, lo:hi] = q[who] @ e[lo:hi].T
                floor = np.partition(score, -min(k + 1, len(e)), axis=1)[:, -min(k + 1, len(e))]
                for i, name in enumerate(names[at : at + 256]):
                    close = np.flatnonzero((score[i] >= floor[i] - 1e-9) & (score[i] > -np.inf))
                    exact = (e[close] * q[i]).sum(axis=1)
                    best = sorted((-s, v) for s, c in zip(exact.tolist(), close, strict=True) for v in ids[c] if v != name)[:k]
                    for values, new in zip(made, ([name] * len(best), [v for _, v in best], [-s for s, _ in best]), strict=True):
                        values += new
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "vec_id": pa.array(made[1], pa.int64()), "score": pa.array(made[2], pa.float64())})

    found = meets.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
