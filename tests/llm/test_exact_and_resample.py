"""Exact dedup and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import roomtrail.llm.queries  # noqa: F401
from roomtrail.llm import exactdedup, resample
from roomtrail.llm.registry import OPERATIONS

SCHEMA = "doc_id long, text string, row string, digest long"
TEXTS = [None, "", "", "a", "A", "a", "b c", "x" * 200_000, "hot", "hot"] + ["hot"] * 40 + [f"own {i}" for i in range(30)] + ["pair", "pair", "é", "e\u0301"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", i) for i, t in enumerate(TEXTS)] + [(5, "a", "again", 0), (None, "a", None, None), (None, "only null", "n", 1), (None, "only null", "n", 2)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def groups(docs):
    by = defaultdict(list)
    for r in docs.collect():
        by[r.text or ""].append(r.doc_id)
    return by


@pytest.mark.parametrize("counters", [8, 64, 4096])  # few texts are broadcast, some, all frequent ones
def test_classes_equal_grouping(docs, counters):
    by = groups(docs)
    got = exactdedup.classes(docs, counters=counters).collect()
    assert len(got) == docs.count()
    want = {hashlib.sha256(t.encode()).digest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}
    stays = Counter()
    for r in got:
        assert (r.keep_id, r.group_size) == want[bytes(r.digest)]
        if r.kept:
            stays[bytes(r.digest)] += 1
            assert r.doc_id == r.keep_id
    assert stays == Counter(want.keys())


@pytest.mark.parametrize("counters", [8, 4096])
def test_drop_copies_keeps_one_whole_row_of_each_text(docs, counters):
    kept = exactdedup.drop_copies(docs, counters=counters)
    assert kept.columns == docs.columns
    by, got = groups(docs), kept.collect()
    assert Counter(r.text or "" for r in got) == Counter(by.keys())
    assert all(r.doc_id == max((i for i in by[r.text or ""] if i is not None), default=None) for r in got)


def test_frequent_texts_are_found_by_the_sketch(spark):
    rows = spark.range(20_000).selectExpr("unhex(sha2(cast(if(id % 4 = 0, 1, id) as string), 256)) AS digest").repartition(7)
    found = {r[0] for r in exactdedup.frequent(rows, 64).collect()}
    assert len(found) <= 64
    assert rows.filter("digest = unhex(sha2('1', 256))").select(exactdedup._item(rows.digest)).first()[0] in found


def test_sketches_with_more_partitions_than_rows(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = spark.range(60).selectExpr("unhex(sha2(cast(id % 3 as string), 256)) AS digest").repartition(30)
        assert exactdedup.frequent(rows, 64).count() == 3
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_exact_dedup_uses_no_python(spark, docs):
    plan = exactdedup.classes(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exactdedup.classes(none).collect() == [] == exactdedup.drop_copies(none).collect()
    assert resample.resample(none, none).collect() == []
    assert {r.weight for r in resample.resample(docs, none).collect()} != set()


# --- resampling ------------------------------------------------------------------------


def brute(docs, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    def found(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(found(t)[1])
    for t in target:
        goal.update(found(t)[1])
    s, t = sum(raw.values()), sum(goal.values())
    out, able = {}, []
    for i, text in docs:
        n, f = found(text)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(f), weight, score)
        if n >= least:
            able.append((-score, i))
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(able)[: len(able) * percent // 100])}
    return {(i, *v, rank.get(i)) for i, v in out.items()}


def test_resampling_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta9", "éa", "été", "x", "THE", "日本"]) + rng.choice(["", ",", "_", "."]) for _ in range(rng.choice([0, 3, 19, 20, 60]))) for _ in range(300)]
    rows = list(enumerate([None, "", "!!", "w " * 400_000, *texts]))
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, rank long, score string").repartition(4)
    target = [None, "", "alpha alpha the X été", "beta9 日本"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, goal)
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()} == brute(rows, target)
    pairs = resample.resample(docs, goal, resample.Hashing(longest=3, buckets=500), percent=40, least_words=5)
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in pairs.collect()} == brute(rows, target, 3, 500, percent=40, least=5)
    drawn = resample.draw(docs, goal, percent=40)
    assert drawn.columns == docs.columns and drawn.count() == len([t for _, t in rows if len(re.findall(r"[^\W_]+", t or "")) >= 20]) * 40 // 100


def test_runs_cross_parts_of_a_long_text(monkeypatch):
    spec, text = resample.Hashing(longest=3, buckets=10**6), " ".join(f"w{i}" for i in range(500))
    whole = [b for _, f in resample.features(text, spec, resample._Buckets(10**6)) for b in f.tolist()]
    monkeypatch.setattr(resample, "TEXT_BLOCK", 40)
    parts = [b for _, f in resample.features(text, spec, resample._Buckets(10**6)) for b in f.tolist()]
    assert Counter(parts) == Counter(whole) and len(whole) == 500 + 499 + 498


@pytest.mark.parametrize("bits", [(3, 4), (12, 16)])
def test_radix_ranks_equal_sorting(spark, bits):
    rng = random.Random(5)
    rows = [(rng.choice([-7, 0, 3, 900, 1 << 40, None]), rng.randrange(-50, 50), i) for i in range(1000)] + [(3, 3, 5000)] * 400
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(6)
    got = sorted(resample.radix_ranks(df, [("a", False), ("b", True)], *bits).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r.a, r.b) for r in got] == [x[:2] for x in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))]
    same = spark.createDataFrame([(None,)] * 40, "a long")
    assert sorted(r["rank"] for r in resample.radix_ranks(same, [("a", True)], 3, 4).collect()) == list(range(1, 41))


def test_queries_return_every_document(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for key in ("op12_importance_resampling", "op13_exact_dedup"):
        assert OPERATIONS[key][0](spark, "/root/testdata/sf0.001").count() == n


def test_resampling_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    goal = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = OPERATIONS["op12_importance_resampling"][0](spark, sf).collect()
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got} == brute(rows, goal)
