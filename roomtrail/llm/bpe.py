"""Byte-level BPE by rank files: encoding with segment trees, and decoding.

A tree over a piece's byte positions holds, for each live position, the rank of the
pair it begins with its live right neighbour; every inner place holds the least
``(rank, position)`` below it, so the root is the leftmost pair of least rank. A
merge changes three leaves (the merged position, the position that dies, the left
neighbour) and their ancestors. Short pieces advance side by side in NumPy, one
merge of every piece at a time; long pieces use one tree each.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .tokens import id_lists, packed

NONE = np.int64(1) << 62
#: Pieces up to this many bytes advance side by side; BLOCK of them at a time.
SHORT, BLOCK = 64, 8192
#: The cache of encoded chunks starts anew beyond this many.
CACHE_CHUNKS = 350_000


@functools.cache
def vocabulary(path: str) -> list[bytes]:
    """Tokens by rank; ranks without a token are empty."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Ranks:
    """A rank file: vocabulary, pair ranks and the pieces' encoder."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = {token: rank for rank, token in enumerate(vocabulary(path)) if token}
        self.find = regex.compile(pattern).findall
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    self.pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_short(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Pieces of 2 to ``size`` bytes, ``size`` a power of two."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        token = self.byte[raw]
        place = np.arange(size)
        after = np.broadcast_to(place + 1, (n, size)).copy()  # the live neighbours; ``length`` ends a piece
        before = np.broadcast_to(np.arange(size + 1) - 1, (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NONE)
        rank = self._pair_ranks(token[:, :-1], token[:, 1:])
        there = (place[1:] < length[:, None]) & (rank < NONE)
        tree[:, size : 2 * size - 1] = np.where(there, rank * size + place[:-1], NONE)
        for low in (size >> k for k in range(1, size.bit_length())):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        flat_token, flat_after, flat_before, flat_tree = token.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        live = np.arange(size) < length[:, None]
        flat_live = live.reshape(-1)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = size + leaf
            base = rows * (2 * size)
            flat_tree[base + at] = value
            while at[0] > 1:
                at = at >> 1
                low = base + 2 * at
                flat_tree[base + at] = np.minimum(flat_tree[low], flat_tree[low + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, new = root % size, root // size
            base = rows * size
            right = flat_after[base + at]
            beyond = flat_after[base + right]
            flat_token[base + at] = new
            flat_live[base + right] = False
            flat_after[base + at] = beyond
            flat_before[rows * (size + 1) + beyond] = at
            ends = beyond >= length[rows]
            ranks = self._pair_ranks(new, flat_token[base + np.minimum(beyond, size - 1)])
            put(rows, right, np.full(len(rows), NONE))
            put(rows, at, np.where(ends | (ranks >= NONE), NONE, ranks * size + at))
            left = flat_before[rows * (size + 1) + at]
            has = left >= 0
            if has.any():
                own, left = rows[has], left[has]
                ranks = self._pair_ranks(flat_token[own * size + left], new[has])
                put(own, left, np.where(ranks >= NONE, NONE, ranks * size + left))
            rows = rows[tree[rows, 1] < NONE]
        ids, counts = token[live].tolist(), live.sum(axis=1).tolist()
        out, start = [], 0
        for c in counts:
            out.append(ids[start : start + c])
            start += c
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """One tree for a piece of any length of 2 bytes or more."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none, pairs = 1 << 62, self.pairs
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(token[i] << 32 | token[i + 1])) is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            at = size + leaf
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                value = min(value, other)
                if tree[at] == value:
                    return
                tree[at] = value

        def pair(i: int) -> int:
            j = after[i]
            r = pairs.get(token[i] << 32 | token[j]) if j < n else None
            return none if r is None else r * size + i

        while tree[1] < none:
            new, at = divmod(tree[1], size)
            right = after[at]
            token[at], token[right] = new, -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            put(right, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """A piece that is a token itself is that token; all others are merged."""
        out: list = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > SHORT:
                out[i] = self.encode_long(p)
            elif p:
                sizes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = []
        for size, own in sizes.items():
            for k in range(0, len(own), BLOCK):
                for i, ids in zip(own[k : k + BLOCK], self.encode_short([pieces[j] for j in own[k : k + BLOCK]], size), strict=True):
                    out[i] = ids
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks split by the pattern, each piece of them encoded."""
        found = [[p.encode() for p in self.find(c)] for c in chunks]
        distinct = list({p for f in found for p in f})
        ids = {p: packed(x) for p, x in zip(distinct, self.encode_pieces(distinct), strict=True)}
        return [b"".join([ids[p] for p in f]) for f in found]

    # White space before a single space that does not begin a word: a run crosses the cut.
    _crosses = re.compile(r"\s (?=\s|\Z)").search

    def encode(self, texts: list) -> list[bytes]:
        """Packed ids of each text (null: none). Every match of the pattern that follows
        a space which begins a word starts at that space, so texts are cut there; the
        chunks that the cache lacks are encoded together."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif self._crosses(text):
                cut.append([text])
            else:
                first, *others = text.split(" ")
                cut.append([first, *[" " + c for c in others]])
        cache = self.cache
        new = list({c for chunks in cut for c in chunks if c not in cache})
        if len(cache) + len(new) > CACHE_CHUNKS:
            cache.clear()
            new = list({c for chunks in cut for c in chunks})
        cache.update(zip(new, self._chunks(new), strict=True))
        return [b"".join([cache[c] for c in chunks]) for chunks in cut]


@functools.cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every row's whole text (null: empty)."""

    def rows(batch: pa.RecordBatch) -> dict:
        own = ranks(path, pattern)
        return {"doc_id": batch.column(0), "ids": id_lists(own.encode(batch.column(1).to_pylist()))}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], "doc_id long, ids array<int>", rows, by="text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` with ``bytes``, the ids' concatenated bytes."""
    names = [c for c in encoded.columns if c not in ("doc_id", "ids")]
    if names:
        raise ValueError(f"unexpected columns {names}")

    def rows(batch: pa.RecordBatch) -> dict:
        own = vocabulary(path)
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
        starts = [0, *ends[:-1]] if ends else []
        # one text's ids at a time as Python numbers, which take nine times their bytes
        return {"doc_id": batch.column(0), "ids": lists, "bytes": [b"".join([own[i] for i in flat[s:e].tolist()]) for s, e in zip(starts, ends, strict=True)]}

    return arrow_map(encoded, ["doc_id", "ids"], "doc_id long, ids array<int>, bytes binary", rows)
