"""SQL of the new operators against their queries, on nulls, ties, odd roles and empty tables."""

import duckdb
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from roomtrail.llm import common, queries  # noqa: F401
from roomtrail.llm.registry import OPERATIONS


def same(spark, folder, key, tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        kinds = StructType([StructField(c, LongType() if k == "long" else StringType()) for c, k in columns])
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    run, sql = OPERATIONS[key]
    got = run(spark, str(folder))
    order = sorted(got.columns)
    found = con.execute(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, found))
    return found


def test_checksum_of_bytes():
    import zlib

    texts = ["", "a", "wörter", "日本", "x" * 5000]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS v", [texts])
    got = dict(con.execute(f"SELECT v, {common.crc32_sql('v')} FROM t CROSS JOIN {common.CRC32_STEPS}").fetchall())
    assert got == {t: zlib.crc32(t.encode()) for t in texts}


CONVERSATIONS = [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]


def conversations(n):
    import random

    rng = random.Random(n)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"]
    texts = ["Yes.", "No!", "open", "open ", "", " \t", None, "Why?\n", "Ünder. §", "a.b"]
    out = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 14))]
    return out + [(99, t, "user" if t % 2 else "assistant", f"Line {t % 50}." if t % 7 else "cut off") for t in range(400)]


@pytest.mark.parametrize("rows", [conversations(1), conversations(2), []])
def test_repair(spark, tmp_path, rows):
    found = same(spark, tmp_path, "op11_conversation_repair", {"conversations": (CONVERSATIONS, rows)})
    assert len(found) == len({r[0] for r in rows})


DOCUMENTS, BENCHMARK = [("doc_id", "long"), ("text", "string")], [("item_id", "long"), ("text", "string")]


@pytest.mark.parametrize("target", [[], [(1, "river STONE bridge"), (2, None), (3, "wörter river")]])
def test_resampling(spark, tmp_path, target):
    rows = [(i, " ".join(f"w{i * j % 17}" for j in range(15 + i % 12)) + " River–stone Ünder-9") for i in range(60)]
    rows += [(7, "river " * 30), (7, "river " * 30), (None, "stone " * 25), (100, None), (101, ""), (102, "!?")]
    found = same(spark, tmp_path, "op12_importance_resampling", {"documents": (DOCUMENTS, rows), "benchmark": (BENCHMARK, target)})
    assert len(found) == len(rows)


def test_resampling_of_nothing(spark, tmp_path):
    assert not same(spark, tmp_path, "op12_importance_resampling", {"documents": (DOCUMENTS, []), "benchmark": (BENCHMARK, [])})
