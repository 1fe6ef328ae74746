import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mask

LENGTHS = [3, 0, 7, 1, None, 12, 5]


def square(lengths):
    """The plain quadratic mask."""
    ids = np.repeat(np.arange(len(lengths)), [n or 0 for n in lengths])
    at = np.arange(len(ids))
    return (at[None, :] <= at[:, None]) & (ids[None, :] == ids[:, None])


@pytest.fixture(scope="module")
def packed(spark):
    return mask.segments(spark.createDataFrame(list(enumerate(LENGTHS)), "s long, length int"), "s").cache()


def filled(rows, shape, block=None):
    out = np.zeros(shape, bool)
    for r in rows:
        if block is None or r["block"] == block:
            assert not out[r["q"], r["k_from"] : r["k_to"] + 1].any()
            out[r["q"], r["k_from"] : r["k_to"] + 1] = True
    return out


@pytest.mark.parametrize("width", [1, 4, 5, 4096])
def test_intervals_equal_the_square(packed, width):
    want = square(LENGTHS)
    got = mask.intervals(packed, width).collect()
    assert len(got) == len(want)
    assert (filled(got, want.shape) == want).all()


@pytest.mark.parametrize("width", [1, 4, 5, 4096])
def test_blocks_equal_the_square(spark, packed, width):
    want, rng = square(LENGTHS), random.Random(width)
    blocks = [(b, *sorted(rng.sample(range(40), 2)), *sorted(rng.sample(range(40), 2))) for b in range(30)] + [(30, 0, 27, 0, 27), (31, 5, 5, 5, 5), (32, 9, 3, 0, 4), (33, -4, 2, -3, 1), (34, 100, 200, 0, 50), (35, 0, 27, 0, 27)]
    df = spark.createDataFrame(blocks, "block long, q_from long, q_to long, k_from long, k_to long")
    runs = mask.expand(packed, df, width)
    rows = runs.collect()
    for b, qa, qb, ka, kb in blocks:
        inside = np.zeros_like(want)
        inside[max(qa, 0) : max(qb + 1, 0), max(ka, 0) : max(kb + 1, 0)] = True
        assert (filled(rows, want.shape, b) == (want & inside)).all()
    dense = mask.additive(runs, df.where("block in (30, 31)")).collect()
    full = np.array([r["mask"] for r in sorted((r for r in dense if r["block"] == 30), key=lambda r: r["q"])])
    assert ((full == 0) == want).all() and (full[~want] == -np.inf).all()
    assert [r["mask"] for r in dense if r["block"] == 31] == [[0.0]]


@pytest.mark.parametrize("side", [1, 3, 4, 8, 100])
def test_tiles_equal_the_square(spark, packed, side):
    want = square(LENGTHS)
    n = -(-len(want) // side)
    counts = {(i, j): int(want[i * side : (i + 1) * side, j * side : (j + 1) * side].sum()) for i in range(n) for j in range(n)}
    got = {(r["q_tile"], r["k_tile"]): r["allowed"] for r in mask.tiles(packed, side).collect()}
    assert got == {t: c for t, c in counts.items() if c}


def test_plans_have_no_nested_loop(spark, packed):
    blocks = spark.range(100).select(F.col("id").alias("block"), (F.col("id") * 5).alias("q_from"), (F.col("id") * 5 + 9).alias("q_to"), F.lit(0).cast("long").alias("k_from"), F.lit(500).cast("long").alias("k_to"))
    for df in (mask.expand(packed, blocks, 8), mask.intervals(packed, 8), mask.tiles(packed, 8), mask.additive(mask.expand(packed, blocks, 8), blocks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_sequences(spark):
    none = mask.segments(spark.createDataFrame([(1, 0), (None, None)], "s long, length int"), "s")
    assert mask.intervals(none).count() == 0 and mask.tiles(none, 4).count() == 0
