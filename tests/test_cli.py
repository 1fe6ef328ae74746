import gzip
import json

import pytest

from tessera import cli


def test_options_from_command_line_environment_and_defaults():
    env = {"TESSERA_SOURCE": "a", "TESSERA_TARGET": "b", "TESSERA_LIMIT": "600", "TESSERA_SPLIT": "yes"}
    o = cli.options(["batches", "--target", "c", "--buckets", "3"], env)
    assert (o.source, o.target, o.limit, o.buckets, o.rate) == ("a", "c", 600.0, 3, 12.5)
    assert cli.options(["prepare"], env).split is True and cli.options(["prepare", "--no-split"], env).split is False
    with pytest.raises(SystemExit):
        cli.options(["prepare", "--source", "x"], {})
    with pytest.raises(ValueError, match="module:function"):
        cli._hook("nothing")


def test_steps_end_to_end(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    cuts = [{"id": f"c{i:02d}", "duration": 1.0 + i / 4, "recording": {"sources": [{"source": "a.wav"}]}, "supervisions": [{"text": f"Hello, world {i}!", "custom": {}}]} for i in range(20)]
    lines = [json.dumps(c).encode() + b"\n" for c in cuts]
    (tmp_path / "cuts.jsonl.gz").write_bytes(b"".join(gzip.compress(b"".join(lines[i : i + 5])) for i in range(0, 20, 5)))
    plain = cli.main(["prepare", "--source", at("cuts.jsonl.gz"), "--target", at("p1"), "--system", "Be brief."], spark).orderBy("id").collect()
    split = cli.main(["prepare", "--source", at("cuts.jsonl.gz"), "--target", at("p2"), "--system", "Be brief.", "--split"], spark).orderBy("id").collect()
    assert plain == split and len(plain) == 20 and "hello world 3" in plain[3]["rendered_conversation"]
    batches = cli.main(["batches", "--source", at("p1"), "--target", at("b"), "--limit", "200", "--buckets", "2", "--shards", "1"], spark).collect()
    assert len(batches) == 20 and {r["bucket"] for r in batches} == {0, 1}

    (tmp_path / "captions.jsonl").write_text("".join(json.dumps({"idx": f"i{i % 9}", "caption": f"text {i}", "more": i}) + "\n" for i in range(10)))
    out = cli.main(["generate", "--source", at("captions.jsonl"), "--target", at("g"), "--outer", "4", "--size", "2", "--records"], spark)
    assert out.count() == 10 and {r["status"] for r in out.collect()} == {"ok"}
    records = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "g" / "records").iterdir()}
    assert sorted(records) == [f"i{i}" for i in range(9)] and records["i3"]["more"] == 3 and "response" in records["i3"]

    spark.createDataFrame([("t", "1", "x", "x")], "test_set string, cut_id string, hyp string, ref string").write.parquet(at("results"))
    (tmp_path / "sets.yaml").write_text("- name: t\n  manifest: m\n")
    cli.main(["evaluate", "--source", at("results"), "--target", at("e"), "--sets", at("sets.yaml"), "--suffix", "iter-5"], spark)
    assert (tmp_path / "e" / "accuracy-t-iter-5.txt").read_text() == "Accuracy: 100.00% (1/1)\n"
