"""Whole paths put together from the operators: preparation, processor call, training data, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lengths, text as tx
from tessera.operators import align, batching, chat, guards, hooks, metrics
from tessera.sources import manifests, named_files, scratch


def prepare_cuts(cuts: DataFrame, instruction: str | None = None, system: str | None = None) -> DataFrame:
    """Cuts with conversation, rendered_conversation and num_text_tokens.

    The response is the normalized answer or text of the first supervision.
    """
    first = F.get("supervisions", F.lit(0))
    response = tx.normalize_text(chat.response_of(first["custom"], first["text"]))
    source = F.get(F.col("recording.sources"), F.lit(0))["source"]
    out = cuts.withColumn("conversation", chat.build_conversation(source, response, F.lit(instruction), F.lit(system)))
    out = out.withColumn("rendered_conversation", chat.render(F.col("conversation")))
    return out.withColumn("num_text_tokens", tx.token_count(F.col("rendered_conversation")))


def prepare_manifest(spark: SparkSession, source: str, target: str, instruction: str | None = None, system: str | None = None, partitions: int | None = None) -> DataFrame:
    """Read a manifest, prepare its cuts, write them and return what was written."""
    manifests.write_manifest(prepare_cuts(manifests.read_manifest(spark, source, partitions), instruction, system), target)
    return spark.read.schema(manifests.PREPARED).json(target)


def process(texts: DataFrame, key: str, text: str | None, audio: DataFrame | None = None, features: DataFrame | None = None, encoder: str = "whisper", downsample: int = 4, labels: bool = True) -> DataFrame:
    """Rows (key, pos, token, labelled) of a batch of chat texts, placeholders expanded.

    ``audio`` and ``features`` are (ordinal, frames) tables of the clips in text order, 0-based; only
    one may be given, and the texts must be. Without both every placeholder stays one token.
    """
    guards.check_inputs(text, audio, features)
    clips = features if audio is None else audio
    if clips is not None:
        n = clips.select("ordinal", lengths.audio_tokens(F.col("frames"), encoder, downsample).alias("n"))
        texts = align.expand_placeholders(texts, n, key, text)
        text = "expanded"
    tokens = texts.select(key, F.posexplode(tx.tokens(F.col(text))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    return align.label_spans(tokens, key, tx.BEGIN, tx.END, ["assistant"]) if labels else tokens


def train_batches(cuts: DataFrame, limit: float, buckets: int, seed: int, weight: str = "weight", key: str = "doc_id", rate: float = 12.5, low: float = 0.5, high: float = 30.0, drop_last: bool = True) -> DataFrame:
    """Cuts of several sources mixed by weight, held to a duration range and batched by tokens.

    Returns bucket, run, batch_id, the cut's rank in the mix and its tokens.
    """
    cuts = scratch.materialize(cuts.select(key, "source", "duration", weight, "num_text_tokens"), "cuts")  # the mix reads them several times
    mixed = batching.weighted_mux(cuts, "source", weight, key).withColumn("rank", F.col("rank").cast("long"))
    kept = guards.filter_duration(mixed, low, high)
    sized = kept.select("rank", "duration", (lengths.estimated_audio_tokens(F.col("duration"), rate) + F.col("num_text_tokens")).alias("num_tokens"))
    return batching.bounded_batches(sized, "rank", "duration", "num_tokens", limit, buckets, seed, drop_last)


def evaluate(results: DataFrame, test_sets: DataFrame, suffix: Column) -> DataFrame:
    """Lines of the files of an evaluation: (file, cut_id, hyp, ref, line), accuracy lines without the middle three.

    ``results``: test_set, cut_id, hyp, ref. A test set without results has an empty result file (a null
    line) and an accuracy. Scores are gathered by the driver, one row a test set of the registry, and
    shown as Python rounds them.
    """
    sets = test_sets.select("test_set").distinct()
    hyp, ref = tx.py_strip(F.col("hyp")).alias("hyp"), tx.py_strip(F.col("ref")).alias("ref")
    rows = results.select("test_set", "cut_id", hyp, ref, F.lit(True).alias("_there")).join(sets, "test_set", "right")
    line = F.when(F.col("_there"), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in ("cut_id", "hyp", "ref")]))
    rows = rows.select(hooks.result_name(F.col("test_set"), suffix).alias("file"), "cut_id", "hyp", "ref", line.alias("line"))
    scores = [(r["test_set"], manifests.accuracy_line(r["correct"], r["total"])) for r in metrics.qa_accuracy(results, sets).collect()]
    shown = results.sparkSession.createDataFrame(scores, "test_set string, line string")
    none = F.lit(None).cast("string")
    shown = shown.select(hooks.result_name(F.col("test_set"), suffix, "accuracy").alias("file"), none.alias("cut_id"), none.alias("hyp"), none.alias("ref"), "line")
    return rows.unionByName(shown)


def write_evaluation(files: DataFrame, folder: str) -> None:
    """One file a name, its lines by cut_id, hyp and ref in code-point order; all files or none."""
    named_files.write(files, folder, "file", "line", ["cut_id", "hyp", "ref"])
