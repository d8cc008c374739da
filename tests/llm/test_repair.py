"""Conversation repair against a plain dynamic program over costs and audit strings."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import roomtrail.llm.queries  # noqa: F401
from roomtrail.llm import repair
from roomtrail.llm.registry import OPERATIONS

SPACE = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if case == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def brute(rows):
    """What the query returns for one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, kinds, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            count[kind] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    need = ["u", "u", "a", "u"]

    def inserted(best):
        while True:
            new = list(best)
            for q in range(4):
                way = best[STEP[q, need[q]]]
                if way is not None:
                    option = (way[0] + 2, "I" + way[1], [(need[q], "")] + way[2])
                    new[q] = option if new[q] is None or option[:2] < new[q][:2] else new[q]
            if new == best:
                return best
            best = new

    best = inserted([(0, "", []), None, None, (0, "", [])])
    for (_, role, text), kind in zip(reversed(rows), reversed(kinds), strict=True):
        now = [None] * 4
        for q in range(4):
            options = []
            if best[q]:
                options.append((best[q][0] + 3, "D" + best[q][1], best[q][2]))
            if kind not in ("blank", "duplicate"):
                more = int(kind == "truncated")
                to = STEP.get((q, role[:1]))
                if to is not None and best[to]:
                    options.append((best[to][0] + more, "K" + best[to][1], [(role, text)] + best[to][2]))
                to = STEP[q, need[q]]
                if best[to]:
                    options.append((best[to][0] + 2 + more, "R" + best[to][1], [(need[q], text)] + best[to][2]))
            now[q] = min(options, key=lambda o: o[:2]) if options else None
        best = inserted(now)
    cost, audit, made = best[0]
    whole = "\n".join(f"{FULL.get(r, r)}:{t}" for r, t in made)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()), [(FULL.get(r, r), t) for r, t in made]


def odd_rows(n, seed, most=9):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "no end", " end. \t", "", " \n", None, "...", "é?", "long " * 50, "x" * 3000 + "."]
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(0, most)):
            row = (conv if conv % 17 else None, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts))
            out += [row] * rng.choice([1, 1, 1, 1, 2, 3])
    return out


def long_rows(conv, n, seed):
    rng = random.Random(seed)
    return [(conv, t + rng.choice([0, 0, 0, 1]), rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(n)]


def answer(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, letters string, block long")
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = OPERATIONS["op11_conversation_repair"][0](spark, str(tmp_path)).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}, len(got)


@pytest.mark.parametrize("block", [2048, 3])
def test_query_equals_the_plain_program(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd_rows(150, 4) + long_rows(500, 700, 1) + long_rows(501, 40, 2) + [(502, 1, "user", "same.")] * 300
    got, n = answer(spark, rows, tmp_path)
    want = {c: brute(r)[0] for c, r in damage(rows).items()}
    assert n == len(want)
    assert {c: (got[c], w) for c, w in want.items() if got[c] != w} == {}


def test_repaired_rows(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in odd_rows(40, 9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    got = defaultdict(list)
    for r in repair.repaired(frame, repair.repair(frame)).collect():
        got[r.conv_id].append((r.position, r.role, r.text))
    for c, r in by.items():
        made = brute(r)[1]
        assert sorted(got[c]) == [(i, *m) for i, m in enumerate(made)]
        assert "".join(m[0][0] for m in made).removeprefix("s").replace("ua", "") == ""


def test_empty_and_gone(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got, _ = answer(spark, [(gone, 0, "user", "Hi.")], tmp_path)
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert OPERATIONS["op11_conversation_repair"][0](spark, f"{tmp_path}/none").collect() == []


def test_least_paths_of_any_graph():
    """Also where several arcs of a node have the same letter."""
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 14)
        arcs = sorted({(a, rng.randrange(3), rng.randrange(a + 1, n)) for a in range(n - 1) for _ in range(rng.randrange(0, 4))})
        src, letter, dst = (np.array([x[i] for x in arcs], dtype=np.int64) for i in range(3))
        after = repair.least_next(n, src, letter, dst)
        best = {}
        for v in reversed(range(n)):
            best[v] = min(("abc"[w] + best[d] for s, w, d in arcs if s == v), default="")
        letters = defaultdict(set)
        for s, w, d in arcs:
            letters[s, d].add("abc"[w])
        root, node = repair.follow(after, np.arange(n))
        for v in range(n):
            path = node[root == v].tolist()
            assert len(path) == len(best[v]) + 1 and path[0] == v
            assert all(best[v][i] in letters[a, b] for i, (a, b) in enumerate(itertools.pairwise(path)))
