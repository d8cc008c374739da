"""Packing tokenized documents into sequences: vector best-fit decreasing.

A sequence has three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths, what block-diagonal attention computes). Pieces are dealt to
shards of about SHARD documents by a hash; inside a shard they go, largest first,
into the open sequence that meets every constraint and has the best score. Each
shard leaves at most a few sequences unfilled, about one in several thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import arrow_map
from .tokens import text_ids, word_tokenizer

SHARD = 8192
#: Rows of a batch that goes back to Spark: a batch with ids stays a few MB.
OUT_ROWS = 512


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: each row's token ids plus ``end_id``,
    cut only where longer than ``capacity``; ``ids`` are packed little-endian 32-bit
    integers. Null texts are empty: one piece that holds ``end_id`` alone."""
    end = np.array([end_id], "<i4").tobytes()

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
        for doc, found in zip(batch.column(0).to_pylist(), text_ids(batch.column(1), path), strict=True):
            ids = bytes(found) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, value in (("doc_id", doc), ("piece", k), ("start", k * capacity), ("length", len(part) // 4), ("ids", part)):
                    out[name].append(value)
        return out

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(base, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids binary", rows, by="text")


def best_fit(length: np.ndarray, capacity: int, most_docs: int, most_attention: int, weights: tuple, score: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (given largest first) by vector best-fit.

    ``score``: ``norm`` takes the bin whose weighted residual norm after placing is
    least, ``dot`` the one whose residuals have the largest weighted dot-product
    with the piece; ties go to the bin opened first.
    """
    need = np.stack([length / capacity, np.full(len(length), 1 / most_docs), length.astype(float) ** 2 / most_attention])
    w = np.array(weights, dtype=float)[:, None]
    least = need[:, -1].copy() if len(length) else None  # the smallest piece left is the last
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    used = np.zeros(len(length), np.int64)
    left, number = np.ones((3, 256)), np.zeros(256, np.int64)  # residuals and numbers of the open bins
    n = opened = 0
    for i in range(len(length)):
        x = need[:, i : i + 1]
        if length[i] < capacity and n:
            free = left[:, :n] - x
            ok = (free > -1e-12).all(axis=0)
            value = (w * free**2).sum(axis=0) if score == "norm" else -(w * x * left[:, :n]).sum(axis=0)
            value[~ok] = np.inf
            j = int(value.argmin())
            if value[j] < np.inf:
                b = number[j]
                bins[i], offset[i] = b, used[b]
                used[b] += length[i]
                left[:, j] -= x[:, 0]
                if (left[:, j] - least < -1e-12).any():  # closed: nothing left fits
                    left[:, j : n - 1], number[j : n - 1] = left[:, j + 1 : n].copy(), number[j + 1 : n].copy()
                    n -= 1
                continue
        bins[i], used[opened] = opened, length[i]
        rest = 1 - x[:, 0]
        if not (rest - least < -1e-12).any():
            if n == left.shape[1]:
                left, number = np.concatenate([left, np.ones_like(left)], axis=1), np.concatenate([number, np.zeros_like(number)])
            left[:, n], number[n] = rest, opened
            n += 1
        opened += 1
    return bins, offset


def appended(held: list[pa.RecordBatch], sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of ``held`` in their order with two more columns, OUT_ROWS at a time; no
    other column is copied, and each batch is let go once its rows are out."""
    at = 0
    while held:
        batch = held.pop(0)
        for start in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(start, OUT_ROWS)
            stop = at + part.num_rows
            yield part.append_column("sequence_id", pa.array(sequence[at:stop])).append_column("offset", pa.array(offset[at:stop]))
            at = stop


def pack(parts: DataFrame, documents: int, capacity: int = 2048, most_docs: int | None = None, most_attention: int | None = None, weights: tuple = (1.0, 1e-3, 1e-3), score: str = "norm") -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; other columns are kept.

    ``documents`` (how many there are) sets the number of shards. Unset capacities
    are those that the token capacity implies. Pieces must be at most ``capacity``.
    """
    most_docs, most_attention = most_docs or capacity, most_attention or capacity**2
    shards = max(1, math.ceil(documents / SHARD))
    schema = parts.schema.add("sequence_id", LongType()).add("offset", LongType())

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_tokenizer.cache_clear()  # all texts are tokenized when a shard is read
        held = [b.drop_columns(["_shard"]) for b in batches]
        light = pa.Table.from_batches([b.select(["length", "doc_id", "piece"]) for b in held])
        order = pc.sort_indices(light, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).to_numpy()
        bins, offset = best_fit(light["length"].to_numpy()[order], capacity, most_docs, most_attention, weights, score)
        back = np.argsort(order)
        yield from appended(held, (bins + (key[0].as_py() << 32))[back], offset[back])
        pa.default_memory_pool().release_unused()  # the worker lives on

    dealt = parts.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(one, schema)
