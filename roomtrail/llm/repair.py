"""Repair of conversation structure at the least cost, ties by the least audit.

A conversation's role initials must read ``(s?(ua)+)?``. Of its rows, blank ones and
repeats are deleted; the others are kept, given another role or deleted, and empty rows
can be inserted. A dynamic program gives the least cost from every (row, state) node.
Among the arcs on least-cost paths the audit (initials of the edits in order) that is
least in ASCII order is found by prefix doubling: nodes are ranked by their audits of
1, 2, 4, ... edits, each rank a pair of ranks of half the length, and the path follows
pointers of doubled length.

Conversations of any length are cut into blocks of at most BLOCK rows. A block is first
summed up as a 4 x 4 matrix of costs from entry to exit state; only these matrices meet
per conversation, and give each block the costs beyond its end. Texts take no part in
this: they are shuffled once, by conversation, and read in order next to their edits.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_STEPS, arrow_map, crc32_sql, cut

#: Rows of a block.
BLOCK = 2048
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an answer.
STATES = 4
ROLES = "sua"
#: state -> state after the initial (row: state, column: s, u, a); -1: not allowed.
NEXT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
#: The role that an insertion or another role gives in each state: u, u, a, u.
GIVEN = np.array([1, 1, 2, 1])
AFTER = NEXT[np.arange(STATES), GIVEN]
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = "DIKR"
FAR = np.int64(1) << 60
SPACE = " \t\n\x0b\x0c\r"


# --- paths ---------------------------------------------------------------------------


def costs(kinds: list[np.ndarray], beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from the four states at the start of each block, and at every place of
    all blocks, one after the other (a block has a place before each item and one after
    the last). ``kinds``: per block (role, truncated, forced) of each item; ``beyond``:
    (blocks, states, goals) costs after its end. All blocks advance together, last items first."""
    sizes = np.array([len(k) for k in kinds], dtype=np.int64)
    places, items = np.cumsum(sizes + 1) - sizes - 1, np.cumsum(sizes) - sizes
    role, cut_off, forced = np.concatenate([np.zeros((0, 3), np.int64), *kinds]).T

    def close(base: np.ndarray) -> np.ndarray:
        """Insertions before what follows."""
        out = base.copy()
        out[:, 2] = np.minimum(base[:, 2], INSERT + base[:, 3])
        out[:, 3] = np.minimum(base[:, 3], INSERT + base[:, 2])
        out[:, 0] = np.minimum(base[:, 0], INSERT + out[:, 2])
        out[:, 1] = np.minimum(base[:, 1], INSERT + out[:, 2])
        return np.minimum(out, FAR)

    now = close(beyond.astype(np.int64))
    dist = np.empty((int(sizes.sum()) + len(kinds), *now.shape[1:]), np.int64)
    dist[places + sizes] = now
    live = np.argsort(-sizes, kind="stable")
    for step in range(int(sizes.max(initial=0))):
        live = live[: np.searchsorted(-sizes[live], -step, "left")]  # blocks with more than ``step`` items
        at = sizes[live] - 1 - step
        i, rest = items[live] + at, now[live]
        taken = rest + np.where(forced[i] > 0, DELETE * forced[i], DELETE)[:, None, None]
        after = NEXT[:, np.minimum(role[i], 2)].T  # (blocks, states)
        held = np.take_along_axis(rest, np.maximum(after, 0)[:, :, None], 1) + cut_off[i][:, None, None]
        held = np.where(((after >= 0) & (role[i] < 3)[:, None])[:, :, None], held, FAR)
        named = rest[:, AFTER] + (REROLE + cut_off[i])[:, None, None]
        free = (forced[i] == 0)[:, None, None]
        now[live] = close(np.where(free, np.minimum(taken, np.minimum(held, named)), taken))
        dist[places[live] + at] = now[live]
    return now, dist


def least_next(nodes: int, src: np.ndarray, letter: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Per node the node after it on the path whose letters are least (-1: the path ends
    there). Arcs ``src -> dst`` form no circle; an audit that ends is less than one that goes on.

    ``rank`` orders nodes by their least audit of ``1, 2, 4, ...`` letters; ``(v, t)`` says
    that ``t`` is reached by such an audit of ``v``."""

    def least(of: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(out, of, value)
        return out

    first = least(src, letter)
    rank = np.unique(np.where(first == np.iinfo(np.int64).max, -1, first), return_inverse=True)[1].astype(np.int64)
    on = letter == first[src]
    v, t = src[on], dst[on]
    while len(v):
        tail = least(v, rank[t])
        on = rank[t] == tail[v]
        v, t = v[on], t[on]
        rank = np.unique(rank * (nodes + 1) + np.where(tail == np.iinfo(np.int64).max, 0, tail + 1), return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((t, v))
        v, t = v[order], t[order]
        begin, end = np.searchsorted(v, t, "left"), np.searchsorted(v, t, "right")
        many = end - begin
        v2, at = np.repeat(v, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        pairs = np.unique(v2 * nodes + t[at])
        v, t = pairs // nodes, pairs % nodes
    key = letter * (nodes + 1) + rank[dst]
    best = key == least(src, key)[src]
    out = np.full(nodes, -1, np.int64)
    out[src[best]] = dst[best]
    return out


def follow(after: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the root, node) of all nodes on the paths from ``roots``, in order, by
    pointers of doubled length."""
    root, step, node = np.arange(len(roots)), np.zeros(len(roots), np.int64), roots.astype(np.int64)
    jump, length = np.append(after, -1), 1  # the place after the last node stands for the end
    while (jump >= 0).any():
        further = jump[node]
        on = further >= 0
        root, step, node = (np.concatenate([a, b[on]]) for a, b in ((root, root), (step, step + length), (node, further)))
        jump, length = jump[jump], length * 2
    order = np.lexsort((step, root))
    return root[order], node[order]


def audits(kinds: list[np.ndarray], beyond: np.ndarray, entries: list[list[int]]) -> list[dict[int, tuple[int, list[str]]]]:
    """Per block and entry state: the exit state and the letters before and at each item
    (one more string for insertions after the last). ``beyond``: (blocks, states)."""
    dist = costs(kinds, beyond[:, :, None])[1][:, :, 0]
    sizes = np.array([len(k) for k in kinds], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    places = len(dist)
    ends = np.zeros(places, bool)
    ends[offset[1:] - 1] = True
    item = np.zeros((places, 3), np.int64)
    item[:, 0] = 3
    if sizes.sum():
        item[~ends] = np.concatenate([k for k in kinds if len(k)])
    role, cut_off, forced = item.T
    goal = np.full((places, STATES), FAR)
    goal[ends] = beyond
    src, letter, dst = [], [], []

    def arcs(ok: np.ndarray, name: str, place: np.ndarray, state: np.ndarray, to_place: np.ndarray, to_state: np.ndarray, cost: np.ndarray) -> None:
        to_place = np.minimum(to_place, places - 1)
        on = ok & (dist[place, state] < FAR) & (dist[to_place, np.maximum(to_state, 0)] + cost == dist[place, state])
        src.append((place * STATES + state)[on])
        dst.append((to_place * STATES + to_state)[on])
        letter.append(np.full(on.sum(), LETTERS.index(name), np.int64))

    every = np.arange(places)
    for q in range(STATES):
        state = np.full(places, q)
        inside = ~ends
        arcs(inside, "D", every, state, every + 1, state, np.where(forced > 0, DELETE * forced, DELETE))
        after = NEXT[q, np.minimum(role, 2)]
        arcs(inside & (forced == 0) & (role < 3) & (after >= 0), "K", every, state, every + 1, after, cut_off)
        arcs(inside & (forced == 0), "R", every, state, every + 1, np.full(places, AFTER[q]), REROLE + cut_off)
        # At a block's end a path leaves where that is as good.
        arcs(~ends | (goal[:, q] > dist[:, q]), "I", every, state, every, np.full(places, AFTER[q]), np.full(places, INSERT))
    nodes = places * STATES
    s, w, d = np.concatenate(src), np.concatenate(letter), np.concatenate(dst)
    after = least_next(nodes, s, w, d)
    used = dict(zip(zip(s.tolist(), d.tolist(), strict=True), w.tolist(), strict=True))
    wanted = [(b, q) for b, qs in enumerate(entries) for q in qs if dist[offset[b], q] < FAR]
    roots = np.array([offset[b] * STATES + q for b, q in wanted], dtype=np.int64)
    of, node = follow(after, roots)
    out: list[dict[int, tuple[int, list[str]]]] = [{} for _ in kinds]
    for i, part in itertools.groupby(zip(of.tolist(), node.tolist(), strict=True), key=lambda x: x[0]):
        b, q = wanted[i]
        path = [n for _, n in part]
        letters = [""] * (int(sizes[b]) + 1)
        for x, y in itertools.pairwise(path):
            at = x // STATES - int(offset[b])
            run = max(1, int(forced[x // STATES])) if used[x, y] == 0 else 1
            letters[at] += LETTERS[used[x, y]] * run
        out[b][q] = (path[-1] % STATES, letters)
    return out


# --- blocks --------------------------------------------------------------------------


def _items(block: dict) -> tuple[np.ndarray, list[int]]:
    """(role, truncated, forced) items of a block's rows, and how many each row has: the
    row itself if it can stay, and the run of its copies that must go."""
    out, each = [], []
    for initial, first, cut_off, copies in zip(block["initial"], block["first"], block["truncated"], block["copies"], strict=True):
        begin = len(out)
        if first:
            out.append((ROLES.find(initial) if initial and initial in ROLES else 3, TRUNCATED * int(cut_off), 0))
        if copies > first:
            out.append((3, 0, copies - first))
        each.append(len(out) - begin)
    return np.array(out, dtype=np.int64).reshape(-1, 3), each


def _summary(block: dict) -> dict:
    """What a block adds to its conversation's counts."""
    turns, rows = block["turn"], list(zip(block["initial"], block["copies"], strict=True))
    known = [t for t in turns if t is not None]
    good = {"su", "ua", "au"}
    illegal = sum(n - 1 for i, n in rows if i + i not in good) + sum(a + b not in good for (a, _), (b, _) in itertools.pairwise(rows))
    blank = sum(n for n, b in zip(block["copies"], block["blank"], strict=True) if b)
    stay = sum(block["first"])
    return {
        "blank": blank, "duplicate": sum(block["copies"]) - blank - stay,
        "truncated": sum(f and t for f, t in zip(block["first"], block["truncated"], strict=True)), "illegal": illegal,
        "least_turn": known[0] if known else None, "most_turn": known[-1] if known else None, "turns": len(set(known)),
        "head": rows[0][0], "tail": rows[-1][0],
    }


#: Columns of a row that blocks hold, in array columns of the same names.
FIELDS = "turn long, role string, digest binary, initial string, blank boolean, first boolean, truncated boolean, copies long"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def faults(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text) of ``rows``, without the text: its
    digest, the number of ``copies``, whether it is blank, whether the ``first`` of them may
    stay (not blank, role and text not seen earlier), and whether its text is cut off."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    blank = last == ""
    marked = rows.select(
        "conv_id", "turn", "role", digest(F.col("text")).alias("digest"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~last.isin(".", "!", "?")).alias("truncated"), (F.lit(1) if copies is None else copies).alias("_n"),
    )
    keys = ["conv_id", "turn", "role", "digest", "initial", "blank", "truncated"]
    one = cut(marked.groupBy(*keys).agg(F.sum("_n").cast("long").alias("copies")))
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = one.groupBy("conv_id", "role", "digest").agg(F.min(known).alias("_first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return one.join(seen, same).withColumn("first", ~F.col("blank") & known.eqNullSafe(F.col("_first"))).select("conv_id", *_NAMES)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def blocks(marked: DataFrame) -> DataFrame:
    """``(conv_id, block, <fields as arrays>)``: the rows of ``marked`` in order (turn,
    nulls first, then role and digest), at most BLOCK of one conversation in each. Block
    numbers ascend within a conversation. A long conversation lies in several partitions."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *_NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("conv_id", pa.int64()), *[(f.name, pa.list_(f.type)) for f in _arrow_fields()]])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])] if ids else []
            cuts = sorted({x for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for x in range(a, b, BLOCK)})
            offsets = pa.array([*cuts, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i + 1).cast(f.type)) for i, f in enumerate(_arrow_fields())]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in cuts], pa.int64()), *lists], schema=target)

    schema = "conv_id long, " + ", ".join(f"{n} array<{t}>" for n, t in (f.split() for f in FIELDS.split(", ")))
    return cut(ranged.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))


def _arrow_fields() -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [pa.field(n, kinds[t]) for n, t in (f.split() for f in FIELDS.split(", "))]


_END = np.array([0, FAR, FAR, 0])


def _later(rows: list[dict]) -> list[list[int]]:
    """Costs after the end of each block of one conversation, from the blocks' matrices."""
    beyond, out = _END, []
    for r in reversed(rows):
        out.append(beyond.tolist())
        beyond = np.minimum(FAR, (np.array(r["matrix"]).reshape(STATES, STATES) + beyond[None, :]).min(axis=1))
    return out[::-1]


def plan(packed: DataFrame) -> DataFrame:
    """``(conv_id, block, beyond, enter, cost)``: per block of ``packed`` the costs after its
    end, the state in which the least path enters it, and the whole conversation's cost.

    Conversations of one block need no shuffle of their blocks. Of the others, matrices
    and exits (four numbers a state) meet per conversation, never their rows."""
    several = packed.groupBy("conv_id").agg(F.count("*").alias("_blocks")).filter("_blocks > 1").select(F.col("conv_id").alias("_c"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    long = cut(packed.join(several, same, "left_semi"))

    def matrix(batch: pa.RecordBatch) -> dict:
        kinds = [_items(b)[0] for b in batch.to_pylist()]
        goals = np.where(np.eye(STATES, dtype=bool), 0, FAR)
        now, _ = costs(kinds, np.repeat(goals[None], len(kinds), 0))
        return {"conv_id": batch.column("conv_id"), "block": batch.column("block"), "matrix": now.reshape(len(kinds), -1).tolist()}

    def back(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        return frame.assign(beyond=_later(frame.to_dict("records")))[["block", "beyond"]]

    sums = arrow_map(long, long.columns, "conv_id long, block long, matrix array<long>", matrix)
    ends = cut(sums.groupBy("conv_id").applyInPandas(back, "block long, beyond array<long>"))

    def exits(batch: pa.RecordBatch) -> dict:
        rows = batch.to_pylist()
        kinds, beyond = [_items(b)[0] for b in rows], np.array([b["beyond"] for b in rows])
        found = audits(kinds, beyond, [list(range(STATES))] * len(rows))
        return {**{c: batch.column(c) for c in ("conv_id", "block", "beyond")}, "leave": [[f[q][0] if q in f else -1 for q in range(STATES)] for f in found], "cost": costs(kinds, beyond[:, :, None])[0][:, 0, 0].tolist()}

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, enter = frame.sort_values("block"), 0, []
        for leave in frame["leave"]:
            enter.append(state)
            state = int(leave[state])
        return frame.assign(enter=enter, cost=int(frame["cost"].iloc[0]))[["block", "beyond", "enter", "cost"]]

    joined = long.join(ends, "block")
    left = arrow_map(joined, joined.columns, "conv_id long, block long, beyond array<long>, leave array<int>, cost long", exits)
    chained = cut(left.groupBy("conv_id").applyInPandas(chain, "block long, beyond array<long>, enter int, cost long"))
    return packed.join(chained, "block", "left")


def edits(planned: DataFrame) -> DataFrame:
    """``(conv_id, block, cost, letters, rows, <counts>)``: per block the edits before and at
    each row and after the last one, its rows' keys, and its counts."""
    counts = "blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns long, head string, tail string"
    schema = f"conv_id long, block long, cost long, letters array<string>, turn array<long>, role array<string>, digest array<binary>, {counts}"

    def solve(batch: pa.RecordBatch) -> dict:
        rows = batch.to_pylist()
        made = [_items(b) for b in rows]
        kinds = [m[0] for m in made]
        beyond = np.array([b["beyond"] or _END.tolist() for b in rows])
        found = audits(kinds, beyond, [[b["enter"] or 0] for b in rows])
        alone = costs(kinds, beyond[:, :, None])[0][:, 0, 0]
        out: dict = {c: batch.column(c) for c in ("conv_id", "block", "turn", "role", "digest")}
        out["cost"] = [int(c) if b["cost"] is None else b["cost"] for b, c in zip(rows, alone, strict=True)]
        out["letters"] = []
        for b, (_, each), f in zip(rows, made, found, strict=True):
            letters, at = f[b["enter"] or 0][1], 0
            mine = []
            for n in each:
                mine.append("".join(letters[at : at + n]))
                at += n
            out["letters"].append([*mine, letters[at]])
        for b in rows:
            for c, v in _summary(b).items():
                out.setdefault(c, []).append(v)
        return out

    return arrow_map(planned, planned.columns, schema, solve)


def audit(found: DataFrame) -> DataFrame:
    """Per conversation ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``
    of the blocks of :func:`edits`. Only a conversation's own audit, which is part of its
    row, comes together."""
    here = found.select(
        "conv_id", "block", "cost", F.array_join("letters", "").alias("audit"), "blank", "duplicate", "truncated", "illegal",
        "least_turn", "most_turn", "turns", "head", "tail",
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    per = here.groupBy("conv_id").agg(
        *sums, F.min("least_turn").alias("_least"), F.max("most_turn").alias("_most"), F.sum("turns").alias("_turns"), F.first("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("block", "audit", "head", "tail", "least_turn", "most_turn"))).alias("_b"),
    )
    pairs = F.arrays_zip(F.expr("slice(_b, 1, greatest(size(_b) - 1, 0))").alias("a"), F.expr("slice(_b, 2, size(_b))").alias("b"))
    joints = F.filter(pairs, lambda p: ~F.concat(p["a"]["tail"], p["b"]["head"]).isin("su", "ua", "au"))
    shared = F.filter(pairs, lambda p: p["a"]["most_turn"] == p["b"]["least_turn"])  # one turn in two blocks
    gaps = F.coalesce(F.col("_most") - F.col("_least") + 1 - (F.col("_turns") - F.size(shared)), F.lit(0).cast("long"))
    return per.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.size(joints)).alias("illegal"), "cost", F.array_join("_b.audit", "").alias("audit"))


# --- the repaired rows ---------------------------------------------------------------


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts and edits side by side: partitions by conversation, in which each row's edits
    come before its copies and a row of its own ends the conversation."""
    last = found.groupBy("conv_id").agg(F.max_by(F.element_at("letters", -1), "block").alias("letters"))
    per_row = F.arrays_zip(F.expr("slice(letters, 1, size(letters) - 1)").alias("letters"), "turn", "role", "digest")
    # Insertions after the last row of a block are those before the next block's first row.
    own = found.select("conv_id", F.inline(per_row))
    none = F.lit(None)
    edited = own.select("conv_id", F.lit(0).alias("part"), "turn", "role", "digest", F.lit(0).alias("kind"), "letters", none.cast("string").alias("text"))
    ended = last.select("conv_id", F.lit(1).alias("part"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.unhex(F.lit("")).alias("digest"), F.lit(0).alias("kind"), "letters", none.cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(0).alias("part"), "turn", "role", digest(F.col("text")).alias("digest"), F.lit(1).alias("kind"), none.cast("string").alias("letters"), "text")
    return edited.unionByName(ended).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest", "kind")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of every repaired row, and (conv_id, None, None) where a
    conversation ends; holds one row at a time."""
    state, waiting = 0, ""
    names = ("system", "user", "assistant")
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                waiting = r["letters"] or ""
                while waiting.startswith("I"):
                    state, given = int(AFTER[state]), int(GIVEN[state])
                    yield r["conv_id"], names[given], ""
                    waiting = waiting[1:]
                if r["part"] == 1:
                    yield r["conv_id"], None, None
                    state, waiting = 0, ""
                continue
            edit = waiting[:1]
            waiting = ""  # a row's other copies go
            if edit == "K":
                state = int(NEXT[state, ROLES.index(r["role"][0])])
                yield r["conv_id"], r["role"], r["text"]
            elif edit == "R":
                state, given = int(AFTER[state]), int(GIVEN[state])
                yield r["conv_id"], names[given], r["text"]


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the rows of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "role", "text"]
        position, held, size = 0, [], 0
        for conv, role, text in _repaired(batches):
            if role is None:
                position = 0
                continue
            held.append((conv, position, role, text))
            position, size = position + 1, size + len(text)
            if size > 1 << 22 or len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, h, strict=True)) for h in held], schema=target)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(names, h, strict=True)) for h in held], schema=target)

    target = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _in_order(rows, found).mapInArrow(run, "conv_id long, position long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` of the repaired rows, joined by line
    feeds. A digest is one pass over a conversation in order; its rows stream through the
    task and are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun, out = hashlib.sha256(), False, []
        for conv, role, text in _repaired(batches):
            if role is None:
                out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                state, begun = hashlib.sha256(), False
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
            else:
                state.update((("\n" if begun else "") + f"{role}:{text}").encode())
                begun = True
        yield pa.RecordBatch.from_pylist(out, schema=target)

    target = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return _in_order(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def normal(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` of ``rows``; null roles and texts are one space."""
    blank = F.lit(" ")
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The edits of each block of the conversations in ``rows(conv_id, turn, role, text)``, as
    :func:`edits` gives them, for :func:`audit`, :func:`repaired` and :func:`repaired_digests`.

    Rows are taken by turn (nulls first, then by role and by the text's digest); ``copies``
    says how often each stands there. Null conversation ids are one conversation. Roles
    other than ``s...``, ``u...``, ``a...`` can not be kept. Texts and roles must not be null
    (see :func:`normal`); further columns are not read; no rows give no edits."""
    return cut(edits(plan(blocks(faults(rows, copies)))))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with ``copies``: by crc32 of ``conv_id:turn``
    modulo 20 a row is gone (0), without text (1), without ``.!?`` (2), there twice (3), the
    user's (4) or as it was. Nulls in the key are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.col("_case")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.withColumn("_case", F.crc32(F.encode(key, "UTF-8")) % 20).filter("_case <> 0")
    return changed.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(case == 3, 2).otherwise(1).alias("copies"))


def oracle() -> str:
    """DuckDB SQL of the damaged, repaired and audited ``conversations``: one recursion from
    the last rows back keeps the least (cost, audit) of each state, which is the whole audit
    as text; the repaired roles then follow from their places."""

    def plus(node: str, cost: str, letter: str) -> str:
        return f"{{'c': {node}.c + {cost}, 'a': '{letter}' || {node}.a}}"

    def least(*nodes: str) -> str:
        return f"list_min([{', '.join(nodes)}])"

    far = f"{{'c': {1 << 40}::BIGINT, 'a': ''}}"
    base = []
    for q in range(STATES):
        drop, name = plus(f"n{q}", str(DELETE), "D"), plus(f"n{AFTER[q]}", f"{REROLE} + cut_off * {TRUNCATED}", "R")
        keep = " ".join(f"WHEN '{r}' THEN {plus(f'n{NEXT[q, i]}', f'cut_off * {TRUNCATED}', 'K')}" for i, r in enumerate(ROLES) if NEXT[q, i] >= 0)
        base.append(f"CASE WHEN gone THEN {drop} ELSE {least(drop, name, f'CASE initial {keep} ELSE {far} END')} END AS b{q}")
    insert = str(INSERT)
    closing = f"{least('b2', plus('b3', insert, 'I'))} AS n2, {least('b3', plus('b2', insert, 'I'))} AS n3"
    opening = f"{least('b0', plus('n2', insert, 'I'))} AS n0, {least('b1', plus('n2', insert, 'I'))} AS n1"
    done = "{'c': 0::BIGINT, 'a': ''}"
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
faulty AS (SELECT *, {crc32_sql("key")} % 20 AS kind FROM given CROSS JOIN {CRC32_STEPS}),
damaged AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty JOIN ids ON ids.conv_id IS NOT DISTINCT FROM faulty.conv_id WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again FROM placed),
items AS (
  SELECT g, i, turn, role, text, initial, blank, again AND NOT blank AS duplicate, blank OR again AS gone,
    (NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z'))::INT AS cut_off,
    lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
counted AS (
  SELECT g, max(i) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, sum(cut_off)::BIGINT AS truncated, count(*) FILTER (illegal) AS illegal
  FROM items GROUP BY g),
path AS (
  SELECT g, size AS left_, {opening.replace('b0', 'e0').replace('b1', 'e1')}, n2, n3
  FROM (SELECT *, {closing} FROM (SELECT g, size, {done} AS e0, {far} AS e1, {far} AS b2, {done} AS b3 FROM counted))
  UNION ALL
  SELECT g, i - 1, {opening}, n2, n3
  FROM (SELECT g, i, b0, b1, {closing} FROM (SELECT path.g, i, {', '.join(base)} FROM path JOIN items ON items.g = path.g AND items.i = path.left_))),
best AS (SELECT g, n0.c AS cost, n0.a AS audit FROM path WHERE left_ = 0),
letters AS (SELECT g, unnest(range(1, length(audit) + 1)) AS spot, unnest(string_split(audit, '')) AS edit FROM best WHERE audit <> ''),
matched AS (SELECT *, CASE WHEN edit <> 'I' THEN count(*) FILTER (edit <> 'I') OVER (PARTITION BY g ORDER BY spot) END AS i FROM letters),
stay AS (
  SELECT m.g, m.edit, items.role, items.text, items.initial, row_number() OVER (PARTITION BY m.g ORDER BY m.spot) AS place
  FROM matched m LEFT JOIN items ON items.g = m.g AND items.i = m.i WHERE m.edit <> 'D'),
named AS (SELECT *, place - (first(edit = 'K' AND initial = 's') OVER (PARTITION BY g ORDER BY place))::INT AS turn_ FROM stay),
texts AS (
  SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN turn_ % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body
  FROM named GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counted USING (g) LEFT JOIN best USING (g) LEFT JOIN texts USING (g)"""
