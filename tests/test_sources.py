import json

import pytest

from tessera.sources import manifests
from tessera.streaming import records


def test_manifest_round_trip(spark, tmp_path):
    rows = [
        ("c1", 1.5, {"sources": [{"source": "a.wav"}]}, [{"text": "t", "custom": {"answer": "x"}}], None),
        ("c2", 0.5, None, [], {"k": "v"}),
    ]
    cuts = spark.createDataFrame(rows, manifests.CUT)
    manifests.write_manifest(cuts, str(tmp_path / "m"))
    back = manifests.read_manifest(spark, str(tmp_path / "m"), partitions=2)
    assert sorted(map(str, back.collect())) == sorted(map(str, cuts.collect()))
    assert [r["num_samples"] for r in manifests.resample(back, 16000).orderBy("id").collect()] == [24000, 8000]


def test_captions(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"idx": 1, "caption": "a", "path": "p"}\n\n   \n{"idx": "x"}\n{"idx": "n", "caption": null}\n')
    got = {r["idx"]: r["caption"] for r in manifests.read_captions(spark, str(f)).collect()}
    assert got == {"1": "a", "x": "", "n": None}
    raw = {r["idx"]: json.loads(r["raw"]) for r in manifests.read_captions(spark, str(f)).collect()}
    assert raw["1"]["path"] == "p"


def test_malformed_captions(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"idx": 1, "caption": "a"}\n{broken\n')
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        manifests.read_captions(spark, str(f)).collect()
    got = manifests.read_captions(spark, str(f), permissive=True).collect()
    assert sorted((r["idx"], r["caption"]) for r in got if r["idx"]) == [("1", "a")]
    assert len(got) == 2


def test_registry(spark, tmp_path):
    (tmp_path / "train.yaml").write_text("- hours: 10\n  manifest: m.jsonl.gz\n  weights: 1\n")
    (tmp_path / "test.yaml").write_text("- name: a\n  manifest: x\n- manifest: y\n")
    assert list(manifests.read_registry(spark, str(tmp_path / "train.yaml")).first()) == [10.0, "m.jsonl.gz", 1.0]
    assert [r["name"] for r in manifests.read_registry(spark, str(tmp_path / "test.yaml")).collect()] == ["a", "valid"]


def test_records_and_lines(spark, tmp_path):
    raw = '{"idx": "b", "z": 1.50, "caption": "é\\n", "a": [1, {"k": null}]}'
    df = spark.createDataFrame([("a", '{"idx": "a"}', "1", 0), ("b", raw, "old", 1), ("b", raw, "日\"", 2), ("c", "{}", None, 3)], "idx string, raw string, response string, p int")
    manifests.write_records(df, str(tmp_path / "out"), order="p")
    got = {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "out").iterdir()}
    want = {"a.json": {"idx": "a", "response": "1"}, "b.json": {**json.loads(raw), "response": '日"'}, "c.json": {}}
    assert got == {k: json.dumps(x, ensure_ascii=False, indent=2) for k, x in want.items()}
    res = spark.createDataFrame([("b", " x ", "y"), ("a", "h", " r")], "cut_id string, hyp string, ref string")
    assert [r["line"] for r in manifests.result_lines(res).collect()] == ["a | h | r", "b | x | y"]
    assert manifests.accuracy_line(1, 8) == "Accuracy: 12.50% (1/8)"
    assert manifests.accuracy_line(0, 0) == "Accuracy: 0.00% (0/0)"


def test_waveforms(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.raw").write_bytes(bytes([1, 2, 3]))
    got = manifests.read_waveforms(spark, str(tmp_path / "w"), lambda raw: [float(b) for b in raw]).first()
    assert got["samples"] == [1.0, 2.0, 3.0]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps({"idx": str(i), "caption": "c" * i}) + "\n")
    df = records.stream(spark, str(src), "idx string, caption string")
    q = records.write_batches(df, lambda b: b.selectExpr("idx", "length(caption) AS n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r["idx"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("0", 0), ("1", 1), ("2", 2)]


def test_exported(spark, tmp_path):
    calls = []
    with pytest.raises(FileNotFoundError):
        manifests.exported(spark, str(tmp_path / "out"), str(tmp_path / "hf"), lambda *a: calls.append(a))
    (tmp_path / "hf").mkdir()
    (tmp_path / "hf" / "config.json").write_text("{}")

    def export(source, folder):
        calls.append((source, folder))
        (tmp_path / "out").mkdir()
        (tmp_path / "out" / "model.safetensors").write_text("")

    assert [manifests.exported(spark, str(tmp_path / "out"), str(tmp_path / "hf"), export) for _ in range(2)] == [True, False]
    assert len(calls) == 1


def test_collection_and_evaluation_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.plans import paths

    assert manifests.collection(spark, [("c", 1.0, None, [], None)] * 2).count() == 2
    rows = [("a", "a b", " Train. ", "train"), ("a", "a", "x", "y"), ("a", "a", "x", " b"), ("gone", "3", "q", "q"), ("a", None, None, "r")]
    res = spark.createDataFrame(rows + [("big", f"{i:03d}", "no" if i else "yes", "yes") for i in range(800)], "test_set string, cut_id string, hyp string, ref string")
    sets = spark.createDataFrame([("a",), ("none",), ("big",)], "test_set string")
    paths.write_evaluation(paths.evaluate(res, sets, F.lit("")), str(tmp_path / "e"))
    got = {p.name: p.read_text() for p in (tmp_path / "e").iterdir()}
    assert sorted(got) == sorted(f"{k}-{s}.txt" for k in ("accuracy", "qa_results") for s in ("a", "none", "big"))
    assert got["qa_results-a.txt"] == " |  | r\na | x | b\na | x | y\na b | Train. | train\n"  # as tuples sort, not as lines do
    assert got["accuracy-a.txt"] == "Accuracy: 25.00% (1/4)\n"
    assert got["accuracy-none.txt"] == "Accuracy: 0.00% (0/0)\n" and got["qa_results-none.txt"] == ""
    assert got["accuracy-big.txt"] == "Accuracy: 0.12% (1/800)\n"  # 0.125, half to even
