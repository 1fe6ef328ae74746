import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import manifests, splittable


def record(i, rng):
    return {"id": f"é{i}", "duration": i / 3 if i % 7 else None, "n": i if i % 5 else None, "recording": {"sources": [{"source": f"a{i}.wav", "more": 1}]}, "supervisions": [{"text": "x" * rng.randint(0, 60), "custom": {"answer": None, "k": "v\n"}}] * (i % 3), "unknown": {"a": [1]}}


SCHEMA = manifests.CUT + ", n long"


def raw(records):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files whose members end anywhere, at line ends, and with no line feed at the end; blank lines."""
    at, rng = tmp_path_factory.mktemp("manifests"), random.Random(6)
    text = raw(record(i, rng) for i in range(200))
    cuts = sorted(rng.sample(range(len(text)), 40))
    (at / "a.jsonl.gz").write_bytes(b"".join(gzip.compress(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])))
    lines = [raw([record(i, rng)]) for i in range(200, 300)]
    (at / "b.jsonl.gz").write_bytes(b"".join(gzip.compress(b"".join(lines[i : i + 9])) for i in range(0, 100, 9)))
    (at / "c.jsonl.gz").write_bytes(gzip.compress(b"\n \n" + raw([record(300, rng)])) + gzip.compress(b"") + gzip.compress(raw([record(301, rng)]).strip()))
    return at


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("split", [1, 300, 2000, 1 << 30])
def test_rows_equal_the_plain_reader(spark, folder, split):
    want = rows(spark.read.schema(SCHEMA).json(str(folder)))
    df = splittable.read(spark, str(folder), SCHEMA, split)
    assert rows(df) == want and len(want) == 302
    parts = df.rdd.getNumPartitions()
    assert parts == 3 if split == 1 << 30 else parts > 10 or split == 2000


def test_index(spark, folder):
    found = splittable.index(spark, str(folder)).orderBy("path", "at").collect()
    assert len(found) == 41 + 12 + 3
    b = [r for r in found if r["path"].endswith("b.jsonl.gz")]
    assert all(r["whole"] for r in b) and b[0]["at"] == 0
    assert all(x["at"] + x["size"] == y["at"] for x, y in zip(b, b[1:]))
    (folder.parent / "cut.gz").write_bytes(gzip.compress(b"x" * 1000)[:-9])
    with pytest.raises(Exception, match="cut short"):
        splittable.index(spark, str(folder.parent / "cut.gz")).collect()


@pytest.mark.parametrize("condition", ["id = 'é17'", "n > 250", "n <=> null", "n is null and duration > 30", "id in ('é1', 'é299', 'x')", "n >= 10 and n < 20", "id is not null and not n = 5", "duration <= 2.0"])
def test_filters_are_pushed_and_right(spark, folder, condition):
    want = rows(spark.read.schema(SCHEMA).json(str(folder)).where(condition))
    got = splittable.read(spark, str(folder), SCHEMA, 2000).where(condition)
    assert rows(got) == want and len(want) < 302
    plan = got._jdf.queryExecution().executedPlan().toString()
    if "duration" not in condition and "not n" not in condition:
        assert " Filter " not in plan and "+- Filter" not in plan


def test_written_files_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.lit("id"), "id").alias("id"), (F.col("id") / 2).alias("duration"), F.col("id").alias("n")).coalesce(1)
    splittable.write(df, str(tmp_path), 5000)
    assert [p.name for p in tmp_path.glob("*.gz")] == ["part-00000.jsonl.gz"]
    got = splittable.read(spark, str(tmp_path), "id string, duration double, n long", 4000)
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.json(str(tmp_path)).count() == 3000
