import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import bucketing


def table(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.lognormvariate(1.5, 0.9), rng.randint(1, 60)) for i in range(n)], "id long, d double, v long")


@pytest.mark.parametrize(("error", "buckets"), [(0.01, 10), (0.03, 8), (0.001, 3)])
def test_bounds_are_within_the_error(spark, error, buckets):
    df = table(spark, 3000)
    ends = bucketing.bounds(bucketing.sketch(df, "d", error), buckets, error)
    lengths = sorted(r["d"] for r in df.collect())
    total, seen, exact = sum(lengths), 0.0, []
    for x in lengths:
        seen += x
        while len(exact) < buckets - 1 and seen >= total * (len(exact) + 1) / buckets:
            exact.append(x)
    assert len(ends) == len(exact) == buckets - 1
    assert all(abs(a - b) <= error * b * 1.0001 for a, b in zip(ends, exact, strict=True))
    shares = [r["s"] / total for r in df.groupBy(bucketing.bucket(F.col("d"), ends).alias("b")).agg(F.sum("d").alias("s")).collect()]
    assert len(shares) == buckets and max(shares) < 1 / buckets + 3 * error


def test_sketches_add_up(spark):
    df = table(spark, 500).withColumn("d", F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 50 == 8, 0).otherwise(F.col("d")))
    rows = lambda s: sorted((r["bin"], r["n"], round(r["total"], 6)) for r in s.collect())
    parts = [bucketing.sketch(df.where(F.col("id") % 3 == i), "d") for i in range(3)]
    assert rows(bucketing.merged(*parts)) == rows(bucketing.sketch(df, "d"))
    assert sum(r[1] for r in rows(bucketing.merged(*parts))) == 480
    assert bucketing.bounds(bucketing.sketch(df.limit(0), "d"), 5) == []


def sequential(rows, limit, ends, seed, shards, drop_last, padded):
    """The plain loop of each shard: one open batch a bucket."""
    lines = defaultdict(list)
    for i, d, v in rows:
        h = hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
        shard = int(hashlib.md5(f"shard|{h}".encode()).hexdigest()[:8], 16) % shards
        lines[shard].append((h, i, d, v))
    out = []
    for shard, line in lines.items():
        open_, number, step = defaultdict(list), defaultdict(int), 0

        def close(b):
            nonlocal step
            out.extend((shard, b, number[b], step, p, i) for p, (i, _) in enumerate(open_[b]))
            number[b] += 1
            step += 1
            open_[b] = []

        for _, i, d, v in sorted(line):
            b = sum(d > e for e in ends)
            after = [x for _, x in open_[b]] + [v]
            if open_[b] and (max(after) * len(after) if padded else sum(after)) > limit:
                close(b)
            open_[b].append((i, v))
        for b in sorted(open_) if not drop_last else ():
            close(b)
    return sorted(out)


@pytest.mark.parametrize(("shards", "drop_last", "padded"), [(1, False, False), (3, True, False), (4, False, True)])
def test_batches_equal_the_plain_loop(spark, shards, drop_last, padded):
    df = table(spark, 700)
    ends = bucketing.bounds(bucketing.sketch(df, "d"), 6)
    got = bucketing.dynamic_batches(df, "id", "d", "v", 150, ends, 9, shards, drop_last, padded).collect()
    want = sequential([tuple(r) for r in df.collect()], 150, ends, 9, shards, drop_last, padded)
    assert sorted((r["shard"], r["bucket"], r["batch_id"], r["step"], r["place"], r["id"]) for r in got) == want
    assert drop_last or len(got) == 700


def test_odd_rows_and_padding(spark):
    df = spark.createDataFrame([(None, 1.0, 10), (None, 1.0, 10), (1, None, 5), (2, 0.0, None), (3, 9.0, 900), (3, 9.0, 900), (4, 2.0, 50)], "id long, d double, v long")
    got = bucketing.dynamic_batches(df, "id", "d", "v", 100, [1.5, 5.0], 1, 2).cache()
    rows = got.collect()
    assert len(rows) == 7 and {r["bucket"] for r in rows if r["d"] is None} == {0}
    sizes = defaultdict(list)
    for r in rows:
        sizes[r["shard"], r["bucket"], r["batch_id"]].append(r["v"] or 0)
    assert all(sum(x) <= 100 or len(x) == 1 for x in sizes.values())
    report = {r["bucket"]: r for r in bucketing.padding(got.na.fill(0.0, ["d"]), "d").collect()}
    assert sum(r["rows"] for r in report.values()) == 7 and report[2]["waste"] == 0.0
    assert bucketing.dynamic_batches(df.limit(0), "id", "d", "v", 100, [], 1).count() == 0


def test_buckets_of_equal_length_waste_less_than_none(spark):
    df = table(spark, 2000)
    ends = bucketing.bounds(bucketing.sketch(df, "d"), 20)
    lost = lambda e: bucketing.padding(bucketing.dynamic_batches(df, "id", "d", "v", 300, e, 2), "d").agg((1 - F.sum("used") / F.sum("padded")).alias("w")).first()["w"]
    assert lost(ends) < 0.25 < lost([])
