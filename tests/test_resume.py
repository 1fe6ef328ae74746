import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import resume


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('layout')}"
    rows = spark.range(600).select(F.when(F.col("id") % 5 != 0, F.col("id") % 5).alias("bucket"), F.floor(F.col("id") / 35).alias("batch_id"), F.col("id").alias("place"), F.concat(F.lit("d"), "id").alias("d"))
    index = resume.write_epochs(rows, ["bucket", "batch_id"], "place", path, 3, range(1, 4), per_part=7)
    return path, rows.cache(), index.cache()


def order(rows, epoch):
    """Batches in the epoch's order, by the plain rule."""
    batches = {}
    for r in rows.collect():
        batches.setdefault((r["bucket"], r["batch_id"]), []).append((r["place"], r["d"]))
    name = lambda k: hashlib.md5("|".join(["3", str(epoch), *("null" if x is None else str(x) for x in k)]).encode()).hexdigest()
    return [[d for _, d in sorted(batches[k])] for k in sorted(batches, key=name)]


def read(df):
    return [(r["epoch"], r["step"], r["d"]) for r in sorted(df.collect(), key=lambda r: (r["epoch"], r["step"], r["place"]))]


def test_every_epoch_is_whole_and_drawn_anew(spark, layout):
    path, rows, _ = layout
    want = [(e, s, d) for e in (1, 2, 3) for s, b in enumerate(order(rows, e)) for d in b]
    assert read(resume.read_from(spark, path, 0)) == want
    assert len(want) == 1800 and order(rows, 1) != order(rows, 2)


@pytest.mark.parametrize(("epoch", "step"), [(1, 0), (1, 1), (2, 6), (2, 7), (2, 20), (3, 10_000), (4, 0)])
def test_head_and_tail_are_the_whole(spark, layout, epoch, step):
    path, _, _ = layout
    whole = read(resume.read_from(spark, path, 1))
    tail = read(resume.read_from(spark, path, epoch, step))
    assert [x for x in whole if (x[0], x[1]) < (epoch, step)] + tail == whole


def test_what_lies_before_is_not_read(spark, layout):
    path, _, index = layout
    whole, tail = resume.read_from(spark, path, 1), resume.read_from(spark, path, 3, 30)
    assert resume.pruned(tail)
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    parts = {(r["epoch"], r["part"]) for r in index.where("epoch = 3 AND step >= 28").collect()}
    assert len(files(tail)) == len(parts) < len(files(whole)) / 4
    assert "step" in tail._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_index_gives_rows_and_places(spark, layout):
    path, rows, index = layout
    for epoch in (1, 3):
        at = 0
        for step, batch in enumerate(order(rows, epoch)):
            r = index.where((F.col("epoch") == epoch) & (F.col("step") == step)).first() if step % 9 == 0 else None
            if r:
                assert (r["epoch_row"], r["n_rows"], r["part"]) == (at, len(batch), step // 7)
                assert resume.locate(spark, path, epoch, at) == (step, 0)
                assert resume.locate(spark, path, epoch, at + len(batch) - 1) == (step, len(batch) - 1)
            at += len(batch)
    assert resume.locate(spark, path, 1, 600)[1] == 0 and resume.locate(spark, path, 9, 5) == (0, 0)
    starts = index.where("epoch = 2").select("part", "part_row", "n_rows", "step").orderBy("step").collect()
    for a, b in zip(starts, starts[1:]):
        assert b["part_row"] == (a["part_row"] + a["n_rows"] if a["part"] == b["part"] else 0)


def test_no_batches(spark, tmp_path):
    none = spark.createDataFrame([], "bucket long, batch_id long, place long")
    assert resume.write_epochs(none, ["bucket", "batch_id"], "place", f"file://{tmp_path}", 1, range(1)).count() == 0
