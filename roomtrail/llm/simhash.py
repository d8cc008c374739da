"""SimHash fingerprints, links by covering locality-sensitive hashing, near-copies.

A family of ``2**(radius+1) - 1`` bit masks is built from labels ``m(i)`` of the
64 bit places: mask ``v`` keeps the places with odd parity of ``m(i) & v``. Up
to ``radius`` differing places have labels that some ``v`` is orthogonal to, so
two fingerprints within the radius agree under that mask: no pair is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, freed_shuffles, plain, slices, star_edges

BITS = 64
#: Buckets up to this many fingerprints are compared inside one task's memory.
SMALL = 1024
#: SHINGLE_BLOCK shingles of a document are hashed and counted at a time.
SHINGLE_BLOCK = 1 << 16
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """Unsigned masks; every pair within ``radius`` agrees under one of them."""
    top = (1 << (radius + 1)) - 1
    labels = [i % top + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(labels) if bin(m & v).count("1") % 2) for v in range(1, top + 1)]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space."""
    return (text or "").encode().translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int):
    """Blocks of XXH64 (seed 42) of the word shingles, repeats included."""
    import xxhash

    if not words:
        return
    last = max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, last, SHINGLE_BLOCK):
        part = words[at : min(at + SHINGLE_BLOCK, last) + size - 1]
        grams = zip(*(part[i:] for i in range(size)), strict=False) if len(part) >= size else [part]
        yield np.array([digest(join(g), 42) for g in grams], dtype=np.uint64)


def majority(blocks) -> int:
    """Unsigned fingerprint: a bit is set if over half of the hashes have it."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for h in blocks:
        total += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long.

    Null or wordless texts have fingerprint zero. Other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [_signed(majority(shingle_hashes(words_of(t), shingle))) for t in batch.column(1).to_pylist()]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], "doc_id long, fp long", rows)


def _local_labels(fp: np.ndarray, radius: int) -> np.ndarray:
    """Index of the first member of each fingerprint's component in one bucket."""
    u = fp.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(a, b)``: edges that span the components of the distinct fingerprints
    ``fps(fp)`` under links at ``radius`` or fewer bits.

    Buckets with up to SMALL fingerprints are compared in memory and give one edge
    per member. Fingerprints of larger buckets meet at every point halfway to a
    partner (themselves and all ``radius // 2``-bit changes), where at most 65 can
    meet, all linked with each other: exact and linear in the bucket's size.
    """
    if radius > 2:
        raise ValueError("buckets of any size are exact only up to a radius of 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("v", "key"))
    sizes = tables.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(tables.join(sizes, ["v", "key"]))
    buckets = met.filter(F.col("n") <= SMALL).groupBy("v", "key").agg(F.collect_list("fp").alias("members"))

    def inside(batch: pa.RecordBatch) -> dict:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            fp = np.array(sorted(members), dtype=np.int64)
            label = _local_labels(fp, radius)
            moved = np.flatnonzero(label != np.arange(len(fp)))
            a += fp[moved].tolist()
            b += fp[label[moved]].tolist()
        return {"a": a, "b": b}

    near = arrow_map(buckets, ["members"], "a long, b long", inside)
    steps = [0] + ([_signed(1 << i) for i in range(BITS)] if radius == 2 else [])
    large = met.filter(F.col("n") > SMALL).select("fp").distinct()
    halfway = large.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(s)) for s in steps])).alias("z"))
    if radius == 1:  # a neighbour is met at its own place
        halfway = large.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])).alias("z"))
        halfway = halfway.join(large.select(F.col("fp").alias("z")), "z", "left_semi")
        return near.union(halfway.select(F.col("fp").alias("a"), F.col("z").alias("b")))
    met_at = halfway.groupBy("z").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1)
    return near.union(met_at.select(F.explode("m").alias("a"), F.array_min("m").alias("b")))


def components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id reachable (null only if the whole component has null ids). Equal
    ids are rows of their own; an empty table gives an empty result.
    """
    own = cut(fingerprints(docs, shingle, id_col, text_col))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = star_edges(links(fps.select("fp"), radius))
    placed = fps.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near-copies of whole documents -------------------------------------------------

#: Sketch of a document: LANES samples of LANE_SHINGLES shingles each.
LANES, LANE_SHINGLES = 18, 3
#: Bits in which fingerprints of five-word shingles of similarity 0.8 may differ (over six deviations).
WIDE = 18
#: Counters of a text's shingle hashes; their overlap bounds the similarity of two texts from above.
BINS = 256


def _sketch(words: list[bytes], size: int) -> tuple[int, list[int]]:
    """Fingerprint of all shingles and the SimHash of each lane's least shingles."""
    blocks = list(shingle_hashes(words, size))
    if not blocks:
        return 0, []
    fp = majority(blocks)
    h = np.unique(np.concatenate(blocks))
    lanes = []
    for lane in range(LANES):
        x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * lane * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        k = min(LANE_SHINGLES, len(h))
        least = h[np.argpartition(x, k - 1)[:k]]
        lanes.append(_signed(majority([least])))
    return fp, lanes


def _profile(text: str | None, size: int) -> tuple[int, bytes]:
    """Number of distinct shingles, and how many fall into each of BINS counters
    (nothing if one counter passes 255)."""
    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words_of(text), size)]))
    bins = np.bincount((h >> np.uint64(17)).astype(np.int64) % BINS, minlength=BINS)
    return len(h), bins.astype(np.uint8).tobytes() if bins.max() < 256 else b""


def _open_pairs(left: list[dict], right: list[dict], similarity: float) -> set[tuple[int, int]]:
    """Pairs of different groups whose sizes and counters allow ``similarity``; a pair
    that reaches it is never left out."""
    group = np.array([m["root"] for m in right], dtype=np.int64)
    size = np.array([m["size"] for m in right], dtype=np.int64)
    known = np.array([bool(m["bins"]) for m in right], dtype=bool)
    bins = np.frombuffer(b"".join(m["bins"] or bytes(BINS) for m in right), np.uint8).reshape(-1, BINS)
    out = set()
    for m in left:
        need = similarity / (1 + similarity) * (size + m["size"]) - 1e-6
        at = np.flatnonzero((group != m["root"]) & (np.minimum(size, m["size"]) >= need))
        if m["bins"] and len(at):
            shared = np.minimum(bins[at], np.frombuffer(m["bins"], np.uint8)).sum(axis=1, dtype=np.int64)
            at = at[~known[at] | (shared >= need[at])]
        out.update((min(m["node"], x), max(m["node"], x)) for x in (right[j]["node"] for j in at))
    return out


def _jaccard(a: str, b: str, size: int) -> float:
    x, y = (set(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words_of(t), size)]).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(node, digest, group, first, rows, keep)``: one row per distinct text (``digest``
    is its MD5, ``node`` a number) with its group of near-copies, its smallest id, the
    number of rows with that id and text, and whether it is the one that stays.

    Whole-document fingerprints meet under the covering masks (radius 2), and the
    SimHash of each of LANES shingle samples under the mask of radius 0, since
    documents of similarity 0.8 differ in about seven bits as a whole. Pairs link if
    the Jaccard similarity of their shingle sets is ``similarity`` or more. First each
    text of a bucket is compared with the leaders it lies within WIDE bits of, middle
    of the bucket first; then all texts of a bucket that are still in different groups
    are compared with each other, whatever their fingerprints.
    Null texts count as empty; wordless texts are copies of each other only if equal.

    Only numbers meet in buckets. The texts of nodes that share a bucket with another one
    are fetched once and kept; all further steps read those. Each step's shuffle files go
    when it is kept.
    """
    with freed_shuffles(docs.sparkSession):
        return _near_groups(docs, shingle, similarity, id_col, text_col)


def _near_groups(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> dict:
        out: dict = {"digest": [], "doc_id": batch.column(0), "fp": [], "keys": []}
        for t in batch.column(1).to_pylist():
            fp, lanes = _sketch(words_of(t), shingle)
            out["digest"].append(hashlib.md5((t or "").encode()).digest())
            out["fp"].append(_signed(fp))
            out["keys"].append([_signed(fp & m) for m in covering_masks(2)] + lanes if lanes else [])
        return out

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(arrow_map(base, ["doc_id", "text"], "digest binary, doc_id long, fp long, keys array<long>", sketch))
    rows = sketches.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("own"))
    firsts = firsts.select("digest", F.col("own.doc_id").alias("first"), F.col("own.rows").alias("rows"))
    # Equal texts have equal sketches.
    nodes = cut(firsts.join(sketches.select("digest", "fp", "keys").dropDuplicates(["digest"]), "digest").withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("node", F.posexplode("keys").alias("v", "k")).select("node", F.xxhash64("v", "k").alias("key"))
    sizes = places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(places.join(sizes, "key"))
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "digest", "first")
    texts = cut(_first_rows(base.withColumn("digest", _digest(F.col("text"))), wanted, extra=("node",)).select("node", "text"))
    # Large buckets are dealt out at random, in another way in each table.
    place = F.xxhash64("node", "key")
    part = F.pmod(place, F.ceil(F.col("n") / SMALL))
    buckets = met.join(nodes.select("node", "fp"), "node").groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("node", "fp")).alias("members"))

    def lead(batch: pa.RecordBatch) -> dict:
        pairs = set()
        for members in batch.column(0).to_pylist():
            fps = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
            ones = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            middle = np.packbits(2 * ones > len(fps)).view(np.uint64)[0]
            away = np.bitwise_count(fps ^ middle)
            order = sorted(range(len(fps)), key=lambda i: (away[i], members[i]["node"]))
            led: list[int] = []
            for i in order:
                close = np.flatnonzero(np.bitwise_count(fps[led] ^ fps[i]) <= WIDE) if led else []
                own = members[i]["node"]
                pairs.update((min(own, x), max(own, x)) for x in (members[led[j]]["node"] for j in close))
                if not len(close):
                    led.append(i)
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    def verify(batch: pa.RecordBatch) -> dict:
        out: dict = {"a": [], "b": []}
        for piece in slices(batch, "ta"):
            a, b, ta, tb = (piece.column(i).to_pylist() for i in range(4))
            for x, y, s, t in zip(a, b, ta, tb, strict=True):
                if _jaccard(s, t, shingle) >= similarity:
                    out["a"].append(x)
                    out["b"].append(y)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return arrow_map(full, ["a", "b", "ta", "tb"], "a long, b long", verify)

    pairs = cut(arrow_map(buckets, ["members"], "a long, b long", lead).distinct())
    roots = star_edges(verified(pairs))
    # What is still in different groups of a bucket; members of its largest group need not meet each other.
    labelled = met.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key", "root").agg(F.count("*").alias("own")).groupBy("key")
    mixed = mixed.agg(F.max(F.struct("own", "root")).alias("main"), F.sum("own").alias("all")).filter("`all` > main.own")
    members = cut(labelled.join(mixed, "key").select("node", "key", "root", "n", F.col("main.own").alias("largest"), (F.col("root") != F.col("main.root")).alias("other")))

    def profile(batch: pa.RecordBatch) -> dict:
        made = [_profile(t, shingle) for t in batch.column(1).to_pylist()]
        return {"node": batch.column(0), "size": [m[0] for m in made], "bins": [m[1] for m in made]}

    profiles = arrow_map(texts.join(members.select("node").distinct(), "node", "left_semi"), ["node", "text"], "node long, size long, bins binary", profile)
    members = members.join(cut(profiles), "node")
    # Every part of the others meets every part of the bucket.
    others, whole = F.ceil((F.col("n") - F.col("largest")) / SMALL).cast("int"), F.ceil(F.col("n") / SMALL).cast("int")
    rows_of = [F.col(c) for c in ("key", "node", "root", "size", "bins")]
    ours = members.filter("other").select(*rows_of, F.lit(True).alias("first"), F.pmod(place, others).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("j"))
    theirs = members.select(*rows_of, F.lit(False).alias("first"), F.pmod(place, whole).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), others - 1)).alias("i"))
    blocks = ours.unionByName(theirs).groupBy("key", "i", "j").agg(F.collect_list(F.struct("first", "node", "root", "size", "bins")).alias("members"))

    def meet(batch: pa.RecordBatch) -> dict:
        found = set()
        for i in range(batch.num_rows):
            both = batch.column(0).slice(i, 1).to_pylist()[0]
            found |= _open_pairs([m for m in both if m["first"]], [m for m in both if not m["first"]], similarity)
        return {"a": [p[0] for p in found], "b": [p[1] for p in found]}

    left = cut(arrow_map(blocks, ["members"], "a long, b long", meet).distinct().join(pairs, ["a", "b"], "left_anti"))
    roots = star_edges(roots.union(verified(left)))
    placed = nodes.drop("fp", "keys").join(roots.select(F.col("a").alias("node"), F.col("b").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    # The group's row with the smallest id stays (ids before nulls, then by digest).
    best = placed.groupBy("group").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("best"))
    return placed.join(best, "group").select("node", "digest", "group", "first", "rows", (F.col("best.digest") == F.col("digest")).alias("keep"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _first_rows(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", extra: tuple = ()) -> DataFrame:
    """The rows of ``docs(digest, ...)`` that ``nodes(digest, first)`` names, one per digest,
    with the ``extra`` columns of ``nodes``.

    Rows of one digest and id stand for each other. Repeats go before the shuffle by both, which
    also serves the join: ``docs`` is shuffled once, and no key is left with many rows.
    """

    def key(c: Column) -> list[Column]:
        return [F.coalesce(c, F.lit(0)).alias("_id"), c.isNull().alias("_none")]

    single = docs.select("*", *key(F.col(id_col).cast("long"))).dropDuplicates(["digest", "_id", "_none"])
    named = nodes.select("digest", *key(F.col("first")), *extra)
    return single.join(named, ["digest", "_id", "_none"]).select(*docs.columns, *extra)


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-copies: the smallest id's."""
    own, columns = plain(docs)
    own_id, own_text = (own.columns[columns.index(c)] for c in (id_col, text_col))
    keep = near_groups(docs, shingle, similarity, id_col, text_col).filter("keep")
    marked = own.withColumn("digest", _digest(F.col(own_text)))
    return _first_rows(marked, keep, own_id).select(*own.columns).toDF(*columns)
