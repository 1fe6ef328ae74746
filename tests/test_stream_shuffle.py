import json
import os
from collections import defaultdict
from itertools import count

import pytest
from pyspark.sql import functions as F

from tessera.streaming import progress, shuffle

CLOCK = count(1_700_000_000)
SCHEMA = "epoch long, pos long, shard int, text string, n double"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    at = folder / f"{name}.json"
    at.write_text("\n".join(json.dumps(dict(zip(("epoch", "pos", "shard", "text", "n"), r, strict=True))) for r in rows))
    os.utime(at, (next(CLOCK),) * 2)  # the source reads files in order of time


def epochs(first, last, n):
    return [(e, p, None, f"é{p}\n", p / 2) for e in range(first, last) for p in range(n)]


def run(spark, source, out, checkpoint, size, shards):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    mixed = shuffle.buffered_shuffle(stream, 7, size, shards)
    query = mixed.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return sorted((r["shard"], r["epoch"], r["place"], r["text"], r["n"]) for r in spark.read.parquet(str(out)).collect())


def model(rows, size, shards):
    """The plain loop over all rows of a shard."""
    out, lines = [], defaultdict(list)
    for e, p, s, text, n in rows:
        lines[s if p is None else p % shards].append((e, -1 if p is None else p, text, n))
    for shard, line in lines.items():
        held, epoch, seen, place = [], None, 0, 0
        for e, p, text, n in sorted(line, key=lambda x: x[:2]):
            if e != epoch:
                for i in sorted(range(len(held)), key=lambda i: (shuffle.draw(7, shard, epoch, "rest", i), i)):
                    out.append((shard, epoch, place, *held[i]))
                    place += 1
                held, epoch, seen, place = [], e, 0, 0
            if p < 0:
                continue
            if len(held) < size:
                held.append((text, n))
            else:
                i = shuffle.draw(7, shard, e, seen) % size
                out.append((shard, e, place, *held[i]))
                held[i], place = (text, n), place + 1
            seen += 1
    return sorted(out)


def test_equals_the_loop_and_survives_a_restart(spark, tmp_path):
    rows = epochs(0, 3, 40)
    ends = [(3, None, s, None, None) for s in range(2)]
    for i in range(0, len(rows), 25):
        put(tmp_path / "all", f"{i:04d}", rows[i : i + 25])
    put(tmp_path / "all", "9999", ends)
    want = model(rows + ends, 6, 2)
    assert run(spark, tmp_path / "all", tmp_path / "o1", tmp_path / "c1", 6, 2) == want
    # the same in two runs: the second goes on from the first one's checkpoint, in the middle of an epoch
    put(tmp_path / "part", "a", rows[:50])
    first = run(spark, tmp_path / "part", tmp_path / "o2", tmp_path / "c2", 6, 2)
    assert 0 < len(first) < 50
    put(tmp_path / "part", "b", rows[50:])
    put(tmp_path / "part", "c", ends)
    assert run(spark, tmp_path / "part", tmp_path / "o2", tmp_path / "c2", 6, 2) == want
    orders = [[x[3] for x in want if x[0] == 0 and x[1] == e] for e in range(3)]
    assert all(sorted(o) == sorted(orders[0]) for o in orders) and len({tuple(o) for o in orders}) == 3
    assert len(want) == 120


def test_buffer_of_one_keeps_the_order_and_late_epochs_fail():
    b = shuffle.Buffer(1, 0, 1)
    out = [x for i in range(5) for x in b.push(0, str(i))] + list(b.push(1, None))
    assert [x[2] for x in out] == ["0", "1", "2", "3", "4"]
    with pytest.raises(ValueError, match="after epoch"):
        list(b.push(0, "x"))


def test_endless_repeats_the_table(spark, tmp_path):
    rows = spark.range(7).select(F.concat(F.lit("d"), "id").alias("d"))
    stream = shuffle.endless(spark, rows, ["d"], per_trigger=10, partitions=2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(600):
            query.awaitTermination(1)
            if (query.lastProgress or {}).get("batchId", 0) >= 2:
                break
    finally:
        query.stop()
    got = sorted((r["epoch"], r["pos"], r["d"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert len(got) >= 20
    assert got == [(i // 7, i % 7, f"d{i % 7}") for i in range(len(got))]


def test_progress_equals_the_sink_after_a_failure(spark, tmp_path):
    for k in range(4):
        put(tmp_path / "in", str(k), epochs(k, k + 1, 10 + k))
    paths = [str(tmp_path / x) for x in ("out", "check", "progress")]
    failed = []

    def unlucky(batch):
        if len(failed) < 1 and batch.where("epoch = 2").count():
            failed.append(1)
            raise RuntimeError("lost")
        return batch.where("pos > 0")

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = progress.write(stream, unlucky, *paths, metrics={"n": F.sum("n")}, name="test")
        try:
            query.awaitTermination(300)
        finally:
            spark.streams.removeListener(query.listener)

    with pytest.raises(Exception, match="lost"):
        start()
    sink = lambda: spark.read.parquet(paths[0])
    assert progress.table(spark, paths[2]).agg(F.sum("rows")).first()[0] == sink().count()
    start()
    rows = progress.table(spark, paths[2]).orderBy("batch").collect()
    assert sink().count() == sum(9 + k for k in range(4)) == rows[-1]["so_far"]
    assert [r["rows"] for r in rows] == [r["count"] for r in sink().groupBy("batch").count().orderBy("batch").collect()]
    assert sum(r["metrics"]["n"] for r in rows) == sink().agg(F.sum("n")).first()[0]
    reported = progress.engine(spark, paths[2]).collect()
    assert reported and {r["batch"] for r in reported} <= set(range(4)) and all(r["input_rows"] >= 10 for r in reported)
