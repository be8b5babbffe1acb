"""Shards: the law of equal numbers, gapless slots, whole rows, and the shuffle against plain Python."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, sharding
from tests.compare import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")
SCHEMA = "doc_id long, text string, slot string, `a.b` int"
ODD = [(None, None, "x", 1), (None, "t", "x", 2), (None, "t", "x", 3), (1, "", "y", 4), (2, "é" * 5000, None, 5)]


def check(found, given, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in given
    )
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n,shards,bucket_rows", [(0, 24, 50), (5, 24, 50), (24, 24, 1), (400, 24, 30), (401, 7, 1000)])
def test_the_law_holds(spark, rows, n, shards, bucket_rows):
    """A third of the rows are copies of one; the rest is odd and ordinary."""
    given = (ODD + [(7, "copy", "z", 0)] * (n // 3) + [(100 + i, f"text {i}", None, i) for i in range(n)])[:n]
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = sharding.shuffle_and_shard(df, shards, bucket_rows=bucket_rows)
    check(found.collect(), given, shards)
    records = Counter(tuple(r.record) for r in found.collect())
    assert records == Counter(given)


def test_the_order_is_the_seeds(spark):
    df = queries.table(spark, FOLDER, "documents")
    order = lambda d, seed: [
        r.doc_id for r in sharding.shuffle_and_shard(d, seed=seed, bucket_rows=40).orderBy("shard", "slot").collect()
    ]
    first = order(df, 1)
    assert first == order(df.repartition(5), 1) and first != order(df, 2)
    assert sorted(first) == sorted(order(df, 2)) and first != sorted(first)


def test_fisher_yates_equals_plain_python(spark):
    df = spark.range(60).select(F.col("id").alias("bucket"), (F.col("id") + 1).cast("int").alias("n"))
    draws = {
        (r.bucket, r.i): r.j
        for r in df.select("bucket", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        .select("bucket", "i", F.pmod(F.xxhash64(F.lit(3), "bucket", "i"), F.col("i").cast("long") + 1).alias("j"))
        .collect()
    }
    for r in df.withColumn("p", sharding.fisher_yates(F.col("n"), 3, F.col("bucket"))).collect():
        want = []
        for i in range(r.n):
            j = draws[r.bucket, i]
            want.append(i)
            want[i], want[j] = want[j], i
        assert r.p == want and sorted(r.p) == list(range(r.n))


def test_places_are_uniform(spark):
    """Each element is about as often in each place."""
    df = spark.range(20_000).select(F.col("id").alias("bucket"))
    found = df.select(F.posexplode(sharding.fisher_yates(F.lit(5), 9, F.col("bucket")))).groupBy("pos", "col").count().collect()
    assert len(found) == 25 and all(abs(r["count"] - 4000) < 400 for r in found)


def test_query_and_native_plan(spark):
    found = queries.op12_sharding(spark, FOLDER)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    given = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    rows = found.collect()
    check(rows, given, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_files_hold_the_shards_in_order(spark, rows, tmp_path):
    given = [(i, f"text {i}", "own", i) for i in range(200)]
    df = spark.createDataFrame(given, SCHEMA)
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(df, path, 6)
    back = spark.read.parquet(path)
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_and_shard(df, 6).collect()}
    assert {r.record.doc_id: (r.shard, r.slot) for r in back.collect()} == want
    assert sorted(tuple(r.record) for r in back.collect()) == given
