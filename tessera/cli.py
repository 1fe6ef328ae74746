"""Entry points for ``spark-submit``: the steps of preparation, generation, batching and evaluation.

Every option may also come from the environment (``--source`` from ``TESSERA_SOURCE`` and so on); the
command line wins. Places are paths that Spark reads.

    python -m tessera.cli prepare --source cuts.jsonl.gz --target prepared --system "Be brief."
    python -m tessera.cli generate --source captions.jsonl --target out --hook package.module:make
    python -m tessera.cli batches --source prepared --target batches --limit 4000 --buckets 30
    python -m tessera.cli evaluate --source results --target folder --sets sets.yaml --suffix iter-300000
"""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lengths
from tessera.operators import bucketing, chat, generate, guards, lookahead
from tessera.plans import paths
from tessera.sources import manifests, named_files, splittable


def _hook(name: str):
    """``module:function`` that makes a batch generator; ``echo`` is the deterministic stand-in."""
    if name == "echo":
        return generate.echo()
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"a hook is module:function, not {name!r}")
    return getattr(importlib.import_module(module), function)


def prepare(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    cuts = splittable.read(spark, o.source, manifests.CUT) if o.split else manifests.read_manifest(spark, o.source)
    manifests.write_manifest(paths.prepare_cuts(cuts, o.instruction or None, o.system or None), o.target)
    return spark.read.schema(manifests.PREPARED).json(o.target)


def _caption_prompt(row: dict) -> str:
    return row["prompt"]


def make_responses(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Responses of all captions under ``target``/rows; with ``--records`` also a JSON file a record."""
    captions = manifests.read_captions(spark, o.source)
    rows = captions.withColumn("prompt", chat.generation_prompt(F.col("caption")))
    done = lookahead.generate_into(rows, "idx", ["idx", "raw"], f"{o.target}/rows", _caption_prompt, _hook(o.hook), o.outer, o.size)
    if o.records:
        good = done.where("status = 'ok'")
        text = F.when(F.col("finish_reason") == "length", F.concat("response", F.lit("<|truncated|>"))).otherwise(F.col("response"))
        manifests.write_records(good.select("idx", "raw", text.alias("response"), "position"), f"{o.target}/records", order="position")
    return done


def make_batches(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    cuts = spark.read.schema(manifests.PREPARED).json(o.source)
    kept = guards.filter_duration(cuts, o.shortest, o.longest)
    sized = kept.select("id", "duration", (lengths.estimated_audio_tokens(F.col("duration"), o.rate) + F.col("num_text_tokens")).alias("num_tokens"))
    ends = bucketing.bounds(bucketing.sketch(sized, "duration"), o.buckets)
    bucketing.dynamic_batches(sized, "id", "duration", "num_tokens", o.limit, ends, o.seed, o.shards).write.mode("overwrite").parquet(o.target)
    return spark.read.parquet(o.target)


def evaluate(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    sets = manifests.read_registry(spark, o.sets).select(F.col("name").alias("test_set"))
    paths.write_evaluation(paths.evaluate(spark.read.parquet(o.source), sets, F.lit(o.suffix)), o.target)
    return named_files.read(spark, o.target)


STEPS = {
    "prepare": (prepare, {"instruction": "", "system": "", "split": False}),
    "generate": (make_responses, {"hook": "echo", "outer": 2048, "size": 32, "records": False}),
    "batches": (make_batches, {"limit": 4000.0, "buckets": 30, "seed": 0, "shards": 8, "rate": 12.5, "shortest": 0.5, "longest": 30.0}),
    "evaluate": (evaluate, {"sets": "", "suffix": ""}),
}


def options(args: Sequence[str], env: Mapping[str, str] = os.environ) -> argparse.Namespace:
    """Options of a step: the command line, else the environment, else the defaults."""
    parser = argparse.ArgumentParser(prog="tessera.cli")
    steps = parser.add_subparsers(dest="step", required=True)
    for name, (_, defaults) in STEPS.items():
        step = steps.add_parser(name)
        for key, usual in {"source": None, "target": None, **defaults}.items():
            given = env.get(f"TESSERA_{key.upper()}")
            if isinstance(usual, bool):
                step.add_argument(f"--{key}", action=argparse.BooleanOptionalAction, default=usual if given is None else given.lower() in ("1", "true", "yes"))
            else:
                kind = str if usual is None else type(usual)
                step.add_argument(f"--{key}", type=kind, default=usual if given is None else kind(given), required=usual is None and given is None)
    return parser.parse_args(args)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    import sys

    chosen = options(sys.argv[1:] if args is None else args)
    return STEPS[chosen.step][0](spark or SparkSession.builder.appName(f"tessera {chosen.step}").getOrCreate(), chosen)


if __name__ == "__main__":
    main()
