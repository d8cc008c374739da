"""Importance resampling towards a target: array-scored weights, a distributed radix sort.

Word runs are hashed into a fixed number of buckets. What raw and target texts hold
per bucket gives an array of gains, a document's weight is the mean gain of its
features, and Gumbel noise of its id turns weights into a sample without replacement.
Rows are ranked by least-significant-digit radix sort: stable counting passes over the
digits of (score, id). In a pass every block of rows counts its digits, prefix sums over
(digit, block) give each pair its global offset, and a row's destination is that offset
plus its place among its block's rows of the same digit. The last destinations are the
ranks.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_STEPS, arrow_map, crc32_sql, cut

#: A-Z lowered, every byte outside words made a space; bytes over 0x7F are parts of words.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of a text that are cut into words at a time.
TEXT_BLOCK = 1 << 20
#: Buckets of features that a worker remembers; the memory starts anew beyond.
KNOWN_FEATURES = 300_000


@dataclass(frozen=True)
class Hashing:
    """Features are all runs of 1 to ``longest`` words, in ``buckets`` buckets."""

    longest: int = 1
    buckets: int = 10_000


class _Buckets(dict):
    """feature -> bucket, remembered in bounded memory."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


@functools.cache
def _known(buckets: int) -> _Buckets:
    """The memory of a worker process."""
    return _Buckets(buckets)


def _word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a bounded part at a time."""
    data, at = (text or "").encode().translate(_WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + TEXT_BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(text: str | None, spec: Hashing, known: _Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features) of each part of a text."""
    last: list[bytes] = []
    for words in _word_blocks(text):
        found = [known[w] for w in words]
        both = last + words
        for size in range(2, spec.longest + 1):  # runs that end in this part
            first = max(0, len(last) - size + 1)
            found += [known[b" ".join(both[i : i + size])] for i in range(first, len(both) - size + 1)]
        last = both[len(both) - spec.longest + 1 :] if spec.longest > 1 else []
        yield len(words), np.array(found, dtype=np.int64)


def bucket_counts(rows: DataFrame, spec: Hashing, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all whole texts of ``rows``. A task gives one row per
    bucket; what reaches the driver is bounded by ``spec.buckets``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(spec.buckets, np.int64), _known(spec.buckets)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), spec, known):
                    total += np.bincount(found, minlength=spec.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    each = rows.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(spec.buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed bucket shares, target over raw."""
    size, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 x a Gumbel variate) of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, spec: Hashing, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` for every row; texts without a
    feature weigh 0. Floors go down, also of negative means."""

    def rows(batch: pa.RecordBatch) -> dict:
        known = _known(spec.buckets)
        out: dict = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "n_features": [], "weight": [], "score": []}
        for i, text in zip(out["doc_id"], batch.column(1), strict=True):
            words = count = total = 0
            for n, found in features(text.as_py(), spec, known):
                words, count, total = words + n, count + len(found), total + int(gain[found].sum())
            weight = total // count if count else 0
            for c, v in (("n_words", words), ("n_features", count), ("weight", weight), ("score", weight + noise(i, seed))):
                out[c].append(v)
        return out

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, ["doc_id", "text"], "doc_id long, n_words long, n_features long, weight long, score long", rows)


# --- the radix sort --------------------------------------------------------------------

#: Rows of a block and bits of a digit: a block's counts are far fewer than its rows.
BLOCK_BITS, DIGIT_BITS = 16, 12


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) by ``keys``: (long column, ascending), most
    significant first; nulls come last. Equal rows get successive ranks.

    Each pass shuffles every row once, by (block, digit), and writes it to a reliable
    checkpoint; the offsets are prefix sums per digit over blocks, and over digits. A
    block has at most 2^``block_bits`` rows, whatever the keys are."""
    ranges = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max)]).first()
    if not ranges["n"]:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    at, plan = F.monotonically_increasing_id(), []
    for column, ascending in reversed(keys):
        low, high = ranges[f"min_{column}"], ranges[f"max_{column}"]
        if low is None:
            continue
        place = F.col(column) - F.lit(low) if ascending else F.lit(high) - F.col(column)
        value, bits = F.coalesce(place, F.lit(high - low + 1)), (high - low + 1).bit_length()
        passes = -(-bits // digit_bits)
        width = -(-bits // passes)
        plan += [F.shiftright(value, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(passes)]
    now = cut(rows.withColumn("_at", at))
    for digit in plan or [F.lit(0)]:
        dealt = now.withColumns({"_block": F.shiftright("_at", block_bits), "_digit": digit})
        counts = dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
        digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
        # 2^digit_bits rows at most
        starts = digits.withColumn("_start", F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).select("_digit", "_start")
        upto = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
        offsets = counts.withColumn("_before", upto).join(F.broadcast(starts), "_digit").select("_digit", "_block", (F.col("_start") + F.col("_before")).alias("_offset"))
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at")) - 1
        moved = dealt.withColumn("_place", place).join(offsets, ["_block", "_digit"])
        now = cut(moved.select(*rows.columns, (F.col("_offset") + F.col("_place")).alias("_at")))
    return now.select(*rows.columns, (F.col("_at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, spec: Hashing | None = None, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Of the rows with ``least_words`` words or more, the ``percent`` per cent (rounded
    down) with the highest scores are drawn; ``rank`` is their order (ties: the smaller
    id, null ids last), null for all other rows. Null texts have no words; repeated ids
    are rows of their own; an empty target gives weights from its smoothed shares. Other
    columns of either table are not read.
    """
    spec = spec or Hashing()
    gain = gains(bucket_counts(docs, spec, text_col), bucket_counts(target, spec, target_col))
    scored = cut(scores(docs, gain, spec, seed, id_col, text_col))
    able = F.col("n_words") >= least_words
    ranked = radix_ranks(scored.filter(able), [("score", False), ("doc_id", True)])
    drawn = scored.filter(able).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Rows that share their id with
    a drawn one are told apart by nothing and come along."""
    drawn = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def oracle(spec: Hashing | None = None, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """DuckDB SQL of :func:`resample` for single words, without ``n_words``: ranks come
    from one sort of all rows. Each distinct word is hashed once."""
    spec = spec or Hashing()
    if spec.longest != 1:
        raise ValueError("the SQL takes single words only")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    counts = "SELECT bucket, sum(n)::BIGINT AS n FROM {0} JOIN hashed USING (word) GROUP BY bucket"
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
own AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM rows_) GROUP BY r, word),
aim AS (SELECT word, count(*) AS n FROM (SELECT unnest({words}) AS word FROM benchmark) GROUP BY word),
hashed AS (SELECT word, {crc32_sql("word")} % {spec.buckets} AS bucket FROM (SELECT word FROM own UNION SELECT word FROM aim) CROSS JOIN {CRC32_STEPS}),
raw AS ({counts.format("own")}), target AS ({counts.format("aim")}),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM raw) AS s, (SELECT coalesce(sum(n), 0) FROM target) AS t),
gain AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(target.n, 0) + 1.0::DOUBLE) * (sums.s + {spec.buckets})::DOUBLE / ((coalesce(raw.n, 0) + 1.0::DOUBLE) * (sums.t + {spec.buckets})::DOUBLE)))::BIGINT AS g
  FROM range({spec.buckets}) every_(b) CROSS JOIN sums LEFT JOIN raw ON raw.bucket = b LEFT JOIN target ON target.bucket = b),
means AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM rows_ LEFT JOIN means USING (r)),
ranked AS (
  SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    count(*) FILTER (n_features >= {least_words}) OVER () AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * {percent} // 100 THEN place END AS rank FROM ranked"""
