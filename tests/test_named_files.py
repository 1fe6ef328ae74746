import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import named_files, scratch


def files(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_a_row_is_a_file_and_others_stay(spark, tmp_path):
    (tmp_path / "other.txt").write_text("stays")
    (tmp_path / "f3").write_text("goes")
    df = spark.range(50).select(F.concat(F.lit("f"), "id").alias("n"), F.when(F.col("id") != 7, F.concat(F.lit("é\n"), "id")).alias("t")).repartition(5)
    named_files.write(df, str(tmp_path), "n", "t")
    want = {f"f{i}": f"é\n{i}" if i != 7 else "" for i in range(50)}
    assert files(tmp_path) == want | {"other.txt": "stays"}
    assert {r["name"]: bytes(r["content"]).decode() for r in named_files.read(spark, str(tmp_path)).collect()} == {k: t for k, t in want.items() if t} | {"other.txt": "stays"}
    named_files.write(df.limit(0), str(tmp_path), "n", "t")
    assert len(files(tmp_path)) == 51
    named_files.write(df.where("n = 'f1'"), str(tmp_path), "n", "t", overwrite=True)
    assert files(tmp_path) == {"f1": "é\n1"}


def test_lines_are_sorted_in_one_file(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 3).alias("n"), (-F.col("id")).alias("o"), F.col("id").cast("string").alias("t")).repartition(7)
    none = spark.createDataFrame([("empty", 1, None)], "n string, o long, t string")
    named_files.write(df.unionByName(none), str(tmp_path), "n", "t", ["o"])
    assert files(tmp_path) == {f"n{k}": "".join(f"{i}\n" for i in range(2999, -1, -1) if i % 3 == k) for k in range(3)} | {"empty": ""}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "f1").write_text("as it was")
    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("midway"))).otherwise("x")
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id").alias("n"), bad.alias("t"))
    with pytest.raises(Exception, match="midway"):
        named_files.write(df, str(tmp_path), "n", "t")
    assert files(tmp_path) == {"f1": "as it was"}


@pytest.mark.parametrize("names", [["a", "a"], ["a/b"], [".."], [None], [""]])
def test_bad_names_leave_nothing(spark, tmp_path, names):
    for parts in (1, 2):
        df = spark.createDataFrame([(n, "x") for n in names], "n string, t string").repartition(parts)
        with pytest.raises(Exception, match="no name of a file|written twice|two tasks"):
            named_files.write(df, str(tmp_path), "n", "t")
        assert files(tmp_path) == {}


def test_two_tasks_with_one_name(spark, tmp_path):
    df = spark.range(0, 2, 1, 2).select(F.lit("same").alias("n"), F.col("id").cast("string").alias("t"))
    with pytest.raises(Exception, match="two tasks"):
        named_files.write(df, str(tmp_path), "n", "t")
    assert files(tmp_path) == {}


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"f{i}").write_text(str(i))
    got = named_files.read(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert {r["name"]: bytes(r["content"]).decode() for r in got.collect()} == {f"f{i}": str(i) for i in range(1500)}


def test_a_commit_holds_few_names(tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "HELD", 500, raising=False)
    (tmp_path / "old").write_text("goes")
    (tmp_path / "0-7").write_text("goes")
    writer = named_files.NamedFilesWriter(f"file://{tmp_path}", False, True)
    done = [writer.write((f"{k}-{i}", "x") for i in range(2500)) for k in range(4)]
    tracemalloc.start()
    writer.commit(done)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert files(tmp_path) == {f"{k}-{i}": "x" for k in range(4) for i in range(2500)}
    assert most < 1 << 20


def test_names_of_two_tasks_are_found_in_each_part(tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "HELD", 4, raising=False)
    (tmp_path / "stays").write_text("as it was")
    for both in range(20):
        writer = named_files.NamedFilesWriter(f"file://{tmp_path}", False, True)
        done = [writer.write((f"{k}{i}" if i != both else f"é\n{i}", "x") for i in range(20)) for k in "ab"]
        with pytest.raises(ValueError, match="two tasks"):
            writer.commit(done)
        assert files(tmp_path) == {"stays": "as it was"}


def test_reading_lists_no_files_in_the_driver(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    df = spark.range(300).select(F.concat(F.lit("f"), "id").alias("n"), F.repeat(F.lit("é"), F.col("id").cast("int") * 100).alias("t"))
    named_files.write(df, str(folder), "n", "t")
    for name in ("_hidden", "_k=1", ".hidden", "x._COPYING_", "z.gz", "é\n ü"):
        (folder / name).write_bytes(b"\x00\xff")
    (folder / "below").mkdir()
    (folder / "below" / "f1").write_text("not of this folder")
    got = named_files.read(spark, str(folder))
    assert got.inputFiles() == []
    want = {f"f{i}": ("é" * 100 * i).encode() for i in range(1, 300)} | {n: b"\x00\xff" for n in ("_k=1", "z.gz", "é\n ü")}
    assert {r["name"]: bytes(r["content"]) for r in got.collect()} == want


def test_scratch_folders_go_entry_by_entry(spark):
    made = scratch.path(spark, "a folder")
    named_files.write(spark.range(50).select(F.col("id").cast("string").alias("n"), F.lit("x").alias("t")), f"{made}/below", "n", "t")
    scratch.path(spark, "never made")
    local = named_files.qualified(spark, made).removeprefix("file://")
    assert len(files(Path(local, "below"))) == 50
    scratch.clear(spark)
    assert not Path(local).exists()
