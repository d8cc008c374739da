"""Masked pseudo-likelihood scores by a bidirectional window network.

Every word of a text is predicted from the two words on each side. Its probability is
that of its class, given by the network, by the word's share of its class, given by
counts of every distinct word over the whole corpus. Classes come from hashed ids:
frequent ids have classes of their own, the others share one per word ending. The
network is one hidden layer over the classes of the four neighbours, trained in NumPy:
first on a bounded sample, then in one pass over all documents, each partition on its own
from the same start, with the weights averaged by numbers of words.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701

from .common import arrow_map, cut, some

ENDINGS, PER_ENDING = 32, 2048
VOCABULARY = ENDINGS * PER_ENDING
OWN = 32  # frequent ids with a class of their own
CLASSES = OWN + ENDINGS
EDGE = CLASSES  # the class of places beyond a text's ends
WINDOW = (-2, -1, 1, 2)
HIDDEN, BATCH = 24, 4096
#: Most words, of at most SHORT bytes each, whose shares every task holds; the others' shares are joined.
HELD, SHORT = 1 << 16, 64
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 1 << 19
#: Bytes whose words are given ids at a time.
HASHED = 1 << 19
_SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    kind: np.ndarray  # class of every id
    share: np.ndarray  # log share of every id in its class


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n, and to 0 to -n, modulo 2^64."""
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    return made[0], made[1]


def _block_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and first places of the words in some bytes: their last two bytes give the ending,
    a polynomial of all bytes the place within it."""
    edge = np.diff(np.concatenate([[True], _SPACES[data], [True]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(max(HASHED, 1 << int(len(data)).bit_length()))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)], dtype=np.uint64)])
    h = (upto[end] - upto[first]) * inverse[first]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    last = data[end - 1].astype(np.int64) * 37 + data[np.maximum(end - 2, first)]
    return (last % ENDINGS * PER_ENDING + (h % np.uint64(PER_ENDING)).astype(np.int64)).astype(np.int32), first


def _ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and first places of the words of ``data``, a block at a time."""
    whole, at, ids, places = np.frombuffer(data, np.uint8), 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    while at < len(data):
        stop = len(data)
        if at + HASHED < stop:  # a block ends before a space
            further = np.flatnonzero(_SPACES[whole[at + HASHED : at + 2 * HASHED]])
            if not len(further):
                further = np.flatnonzero(_SPACES[whole[at + HASHED :]])
            stop = at + HASHED + int(further[0]) if len(further) else stop
        found, first = _block_ids(whole[at:stop])
        ids.append(found)
        places.append(first + at)
        at = stop
    return np.concatenate(ids), np.concatenate(places)


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words of one text; words are parted by ASCII white space."""
    return _ids((text or "").encode())[0]


def word_ids_of(words: list[bytes]) -> np.ndarray:
    return _ids(b" ".join(words))[0]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, id, n)``: how often each distinct word occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = list(seen)
            ids, counts = word_ids_of(made), pa.array(seen.values(), pa.int64())
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(made, pa.binary()), "id": pa.array(ids), "n": counts})

        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or "").encode().split())
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    own = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, id int, n long")
    return own.groupBy("word").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def id_counts(words: DataFrame) -> np.ndarray:
    """Counts of the ids of ``words(word, id, n)``, as ``count`` gives them."""
    out = np.zeros(VOCABULARY, np.int64)
    for i, n in words.groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def shares(words: DataFrame, v: Vocabulary) -> tuple[DataFrame, np.ndarray]:
    """``(word, n, share)``: log share of each word in its class, and that of an unseen
    word in each class; every word counts once more, all unseen ones of a class as one."""
    sums = words.groupBy("id").agg(F.sum(F.col("n") + 1).alias("n"))
    whole = np.ones(CLASSES)
    for i, n in sums.collect():
        whole[v.kind[i]] += n
    logs = np.log(whole)

    def rows(batch: pa.RecordBatch) -> dict:
        kinds = v.kind[np.asarray(batch.column(1))]
        return {"word": batch.column(0), "n": batch.column(2), "share": np.log(np.asarray(batch.column(2)) + 1.0) - logs[kinds]}

    return arrow_map(words, ["word", "id", "n"], "word binary, n long, share double", rows), -logs


def held(shared: DataFrame) -> dict[bytes, float]:
    """Shares of the most frequent short words, HELD at most."""
    short = shared.filter(F.octet_length("word") <= SHORT).withColumn("step", F.floor(8 * F.log2("n")))
    steps = sorted(((r[0], r[1]) for r in short.groupBy("step").agg(F.count("*")).collect()), reverse=True)
    least, total = None, 0
    for step, n in steps:
        total += n
        if total > HELD:
            break
        least = step
    return {bytes(r[0]): r[1] for r in short.filter(F.col("step") >= least).select("word", "share").collect()} if least is not None else {}


def count(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each id occurs in all texts; at most VOCABULARY sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 256):
                total += np.bincount(np.concatenate([word_ids(t) for t in texts[lo : lo + 256]]), minlength=VOCABULARY)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(there, pa.int32()), "n": pa.array(total[there], pa.int64())})

    own = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "id int, n long")
    out = np.zeros(VOCABULARY, np.int64)
    for i, n in own.groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def vocabulary(counts: np.ndarray) -> Vocabulary:
    kind = OWN + np.arange(VOCABULARY) // PER_ENDING
    top = np.argsort(-counts, kind="stable")[:OWN]
    kind[top] = np.arange(len(top))
    smooth = counts + 1.0
    whole = np.bincount(kind, smooth, minlength=CLASSES)
    return Vocabulary(kind.astype(np.int16), np.log(smooth / whole[kind]))


def start(seed: int = 5) -> list[np.ndarray]:
    """Weights: four tables (CLASSES + 1, HIDDEN), hidden bias, output (HIDDEN, CLASSES), output bias."""
    rng = np.random.default_rng(seed)
    scale = lambda *s: (0.3 * rng.standard_normal(s)).astype(np.float32)
    return [scale(len(WINDOW), CLASSES + 1, HIDDEN), np.zeros(HIDDEN, np.float32), scale(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)]


def windows(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours' classes (4, n) and places of the words in ``kinds``, where texts are
    parted by two EDGE places and the whole begins and ends with two."""
    at = np.flatnonzero(kinds != EDGE)
    return np.stack([kinds[at + d] for d in WINDOW]) if len(at) else np.zeros((len(WINDOW), 0), kinds.dtype), at


def _bounded(w: list[np.ndarray]) -> bool:
    """Whether no logit's exponential can overflow, as hidden values lie within -1 and 1."""
    return bool((np.abs(w[2]).sum(axis=0) + np.abs(w[3])).max() < 80)


def _logits(w: list[np.ndarray], h: np.ndarray, bounded: bool) -> np.ndarray:
    h += w[1]
    np.tanh(h, out=h)
    logits = h @ w[2]
    logits += w[3]
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _forward(w: list[np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.take(w[0][0], near[0], axis=0)
    for k in range(1, len(WINDOW)):
        h += np.take(w[0][k], near[k], axis=0)
    return h, _logits(w, h, _bounded(w))


@functools.cache
def _marks() -> np.ndarray:
    """Zeros in which the neighbours of a batch are marked for a while."""
    return np.zeros((BATCH, CLASSES + 1), np.float32)


def learn(w: list[np.ndarray], near: np.ndarray, target: np.ndarray, state: list[np.ndarray], rate: float) -> None:
    """One step of AdaGrad on a batch of at most BATCH words, in place."""
    n = len(target)
    h, p = _forward(w, near)
    np.exp(p, out=p)
    p *= (1 / (n * p.sum(axis=1, keepdims=True))).astype(np.float32)
    rows = np.arange(n)
    p[rows, target] -= np.float32(1 / n)
    dh = p @ w[2].T
    dh *= 1 - h * h
    tables, hot = np.empty_like(w[0]), _marks()[:n]
    for k in range(len(WINDOW)):
        hot[rows, near[k]] = 1
        tables[k] = hot.T @ dh
        hot[rows, near[k]] = 0
    for x, s, g in zip(w, state, (tables, dh.sum(axis=0), h.T @ p, p.sum(axis=0)), strict=True):
        s += g * g
        x -= rate * g / (np.sqrt(s) + 1e-6)


def texts_to_kinds(texts: list, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with EDGE places around each text, all ids, and each text's number of words."""
    parts = [(t or "").encode() for t in texts]
    ids, places = _ids(b"\n".join(parts))
    ends = np.cumsum([len(x) + 1 for x in parts], dtype=np.int64)
    lengths = np.diff(np.searchsorted(places, ends), prepend=0).astype(np.int64)
    kinds = np.full(len(ids) + 2 * (len(texts) + 1), EDGE, np.int16)
    kinds[np.arange(len(ids)) + 2 * (np.repeat(np.arange(len(texts)), lengths) + 1)] = v.kind[ids]
    return kinds, ids, lengths


def fit(docs: DataFrame, v: Vocabulary, sample_texts: int = 1000, sample_chars: int = 2000, rate: float = 0.1, text_col: str = "text") -> list[np.ndarray]:
    """Weights after the bounded start and one averaged pass over every document."""
    at = F.pmod(F.xxhash64(text_col), F.greatest(F.char_length(text_col) - sample_chars, F.lit(0)) + 1).cast("int") + 1
    known = some(docs.filter(F.col(text_col).isNotNull()).select(text_col), sample_texts)
    chosen = sorted(r[0] for r in known.select(F.substring(F.col(text_col), at, F.lit(sample_chars))).collect())
    w = start()
    kinds, _, _ = texts_to_kinds(chosen, v)
    near, at = windows(kinds)
    target = kinds[at]
    state = [np.zeros_like(x) for x in w]
    order = np.random.default_rng(1).permutation(len(at))
    for i in range(0, len(order), 1024):
        own = order[i : i + 1024]
        learn(w, near[:, own], target[own], state, rate)
    begin, sizes, shapes = [x.copy() for x in w], [x.size for x in w], [x.shape for x in w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marks, words = [x.copy() for x in begin], [x.copy() for x in state], 0
        for b in batches:
            column = b.column(0).to_pylist()
            for lo in range(0, len(column), 256):
                kinds, _, _ = texts_to_kinds(column[lo : lo + 256], v)
                near, at = windows(kinds)
                for i in range(0, len(at), BATCH):
                    learn(own, near[:, i : i + BATCH], kinds[at[i : i + BATCH]], marks, rate)
                words += len(at)
        flat = np.concatenate([x.reshape(-1) for x in own]).astype(np.float64) * words
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)), pa.int32()), "x": pa.array(flat), "n": pa.array(np.full(len(flat), words), pa.int64())})

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "i int, x double, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    flat = np.concatenate([x.reshape(-1) for x in begin]).astype(np.float64)
    for i, x, n in sums.collect():  # one row per weight
        if n:
            flat[i] = x / n
    ends = np.cumsum(sizes)
    return [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def log_probabilities(texts: list, w: list[np.ndarray], v: Vocabulary, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of every word of ``texts``, and each text's number of words; the
    words' log shares of their classes are ``share``, or else those of their ids."""
    kinds, ids, lengths = texts_to_kinds(texts, v)
    near, at = windows(kinds)
    target = kinds[at]
    out = v.share[ids] if share is None else share.copy()
    # Two neighbours at a time: the sums of their rows for all pairs of classes.
    before, after = ((w[0][a][:, None] + w[0][b][None]).reshape(-1, HIDDEN) for a, b in ((0, 1), (2, 3)))
    first, second = (near[a].astype(np.int32) * (CLASSES + 1) + near[b] for a, b in ((0, 1), (2, 3)))
    bounded = _bounded(w)
    for i in range(0, len(at), BATCH):
        h = np.take(before, first[i : i + BATCH], axis=0)
        h += np.take(after, second[i : i + BATCH], axis=0)
        z = _logits(w, h, bounded)
        own = z[np.arange(len(z)), target[i : i + BATCH]]
        np.exp(z, out=z)
        out[i : i + BATCH] += own - np.log(z.sum(axis=1))
    return out, lengths


def score(docs: DataFrame, w: list[np.ndarray], v: Vocabulary, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, pseudo_loglik, per_word)`` for every row; ``per_word`` is 0 for
    texts without words (null texts are empty). ``words`` are the corpus's ``word_counts``.

    Shares of frequent words are held by every task; the other words of a text are
    joined with theirs.
    """
    shared, unseen = shares(words, v)
    shared = cut(shared)
    known = held(shared)

    schema = "doc_id long, n_words long, sum double, rare array<struct<word: binary, kind: int>>"
    target = to_arrow_schema(_parse_datatype_string(schema)).field("rare").type

    def rows(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        split = [(t or "").encode().split() for t in texts]
        share = np.fromiter((known.get(x, 0.0) for own in split for x in own), np.float64, sum(map(len, split)))
        logp, lengths = log_probabilities(texts, w, v, share)
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), logp, minlength=len(lengths))
        words = [x for own in split for x in own]
        away = np.fromiter((x not in known for x in words), bool, len(words))
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(lengths)), lengths), away, minlength=len(lengths)))]).astype(np.int32)
        rare = [x for x, o in zip(words, away.tolist(), strict=True) if o]
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(v.kind[word_ids_of(rare)], pa.int32())], fields=list(target.value_type))
        return {"doc_id": batch.column(0), "n_words": lengths, "sum": sums, "rare": pa.ListArray.from_arrays(pa.array(ends), pairs, type=target)}

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = cut(arrow_map(base, ["doc_id", "text"], schema, rows, by="text").withColumn("row", F.monotonically_increasing_id()))
    rare = made.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.kind")
    named = rare.join(shared.select("word", "share"), "word", "left")
    none = F.element_at(F.array(*[F.lit(float(x)) for x in unseen]), F.col("kind") + 1)
    more = named.groupBy("row").agg(F.sum(F.coalesce("share", none)).alias("more"))
    whole = made.drop("rare").join(more, "row", "left").withColumn("pseudo_loglik", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    return whole.select("doc_id", "n_words", "pseudo_loglik", (F.col("pseudo_loglik") / F.greatest("n_words", F.lit(1))).alias("per_word"))
