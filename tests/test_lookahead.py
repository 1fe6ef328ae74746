import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle

from tessera.operators import lookahead

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def prepare(row):
    if row["text"] is None:
        return None
    if len(row["text"]) % 7 == 3:
        raise ValueError("bad length")
    return row["text"].upper()


def make():
    return lambda prompts: [(f"{p}/{len(prompts)}", "stop") for p in prompts]


def sequential(rows, outer, size):
    """(position -> micro, place, response, error) of the plain loop: fill up, generate, flush at the end of an outer batch."""
    out = {}
    for start in range(0, len(rows), outer):
        ready = []
        for p, (_, text) in enumerate(rows[start : start + outer], start):
            if text is None:
                out[p] = (None, None, None, "no prompt")
            elif len(text) % 7 == 3:
                out[p] = (None, None, None, "ValueError: bad length")
            else:
                ready.append((p, text.upper()))
        for m in range(0, len(ready), size):
            some = ready[m : m + size]
            out |= {p: (m // size, i, f"{t}/{len(some)}", None) for i, (p, t) in enumerate(some)}
    return out


def inputs(n):
    return [(None if i % 13 == 5 else f"id{i % 50}", None if i % 17 == 4 else "x" * (i * i % 23)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, k, t, "s") for i, (k, t) in enumerate(rows)], "n long, key string, text string, status string")


def found(df):
    rows = df.collect()
    got = {r["position"]: (r["micro"], r["place"], r["response"], r["error"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize(("n", "outer", "size"), [(100, 30, 8), (64, 64, 64), (31, 7, 1), (1, 5, 3), (0, 5, 3)])
def test_batches_equal_the_sequential_loop(spark, tmp_path, n, outer, size):
    rows = inputs(n)
    got = lookahead.generate_into(table(spark, rows), "key", ["n"], f"file://{tmp_path}/out", prepare, make, outer, size, wave=2)
    assert found(got) == sequential(rows, outer, size)


def test_a_killed_run_goes_on(spark, tmp_path):
    rows, path = inputs(200), f"file://{tmp_path}/out"
    rows[150] = ("id", "boom")
    df, want = table(spark, rows), sequential(rows, 20, 8)

    def failing():
        def model(prompts):
            if "BOOM" in prompts:
                raise RuntimeError("the machine is gone")
            return make()(prompts)

        return model

    with pytest.raises(Exception, match="the machine is gone"):
        lookahead.generate_into(df, "key", ["n"], path, prepare, failing, 20, 8, wave=1)
    left = spark.read.parquet(path)
    assert sorted(r["position"] for r in left.collect()) == list(range(140))
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def model(prompts):
            calls.add(len(prompts))
            return make()(prompts)

        return model

    got = lookahead.generate_into(df, "key", ["n"], path, prepare, counting, 20, 8, wave=3)
    assert found(got) == want
    assert calls.value == sum(p >= 140 and x[3] is None for p, x in want.items())
    again = lookahead.generate_into(df, "key", ["n"], path, prepare, counting, 20, 8, wave=3)
    assert found(again) == want and calls.value == sum(p >= 140 and x[3] is None for p, x in want.items())


def test_look_ahead_is_bounded_and_ordered():
    running, most, lock = 0, 0, threading.Lock()

    def slow(row):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (row["i"] % 3))
        with lock:
            running -= 1
        return str(row["i"])

    taken = 0

    def source():
        nonlocal taken
        for i in range(100):
            taken += 1
            yield i // 25, i, {"i": i}

    with ThreadPoolExecutor(4) as pool:
        feed = lookahead.Feed(source(), slow, 10, pool)
        seen = []
        for k, (outer, piece, prompt, error) in enumerate(feed):
            assert taken <= k + 10  # never further ahead
            seen.append((outer, piece, prompt, error))
    assert seen == [(i // 25, i, str(i), None) for i in range(100)]
    assert feed.most == 10 and 1 < most <= 4


def test_status_of_rows(spark, tmp_path):
    got = lookahead.generate_into(table(spark, inputs(60)), "key", ["n"], f"file://{tmp_path}/out", prepare, make, 30, 8)
    assert set(got.columns) == {"n", "key", "text", "position", "outer", "micro", "place", "response", "finish_reason", "error", "status"}
    assert {(r["status"], r["error"] is None) for r in got.collect()} == {("ok", True), ("failed", False)}
    assert sorted(p.name for p in (tmp_path / "out").glob("status=*")) == ["status=failed", "status=ok"]


def test_a_job_reads_its_rows_only(spark, tmp_path, monkeypatch):
    generate, plans = lookahead.generate, []

    def noted(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return generate(df, *more)

    monkeypatch.setattr(lookahead, "generate", noted)
    got = lookahead.generate_into(table(spark, inputs(100)), "key", ["n"], f"file://{tmp_path}/out", prepare, make, 10, 4, wave=3)
    assert got.count() == 100 and got.columns.count(lookahead.WAVE) == 0
    assert len(plans) == 4 and all(lookahead.WAVE in p.split("PartitionFilters: [")[1].split("]")[0] for p in plans)
