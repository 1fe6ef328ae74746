"""JSON-lines manifests, caption lists, registries and result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.checkpoints import WEIGHT_FILES
from tessera.sources import named_files

CUT = (
    "id string, duration double, recording struct<sources:array<struct<source:string>>>, "
    "supervisions array<struct<text:string,custom:map<string,string>>>, custom map<string,string>"
)
PREPARED = CUT + (
    ", conversation array<struct<role:string,parts:array<struct<type:string,audio:string,text:string>>>>, "
    "rendered_conversation string, num_text_tokens long"
)
TRAIN_REGISTRY = "hours double, manifest string, weights double"
TEST_REGISTRY = "name string, manifest string"


def read_manifest(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Cuts of a ``jsonl`` or ``jsonl.gz`` manifest; gzip isn't splittable, so rows may be dealt anew."""
    cuts = spark.read.schema(CUT).json(path)
    return cuts.repartition(partitions) if partitions else cuts


def write_manifest(cuts: DataFrame, path: str, compress: bool = True) -> None:
    cuts.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "true").json(path)


def collection(spark: SparkSession, rows: list, schema: str = CUT) -> DataFrame:
    """A table of records that the driver holds; of repeated ids all stay."""
    return spark.createDataFrame(rows, schema)


def exported(spark: SparkSession, folder: str, source: str, export: Callable[[str, str], None]) -> bool:
    """Call ``export(source, folder)`` unless ``folder`` holds weights; true if it was called.

    A missing ``source`` raises. Only file names are looked at.
    """
    if _names(spark, folder) & set(WEIGHT_FILES):
        return False
    if not _names(spark, source):
        raise FileNotFoundError(f"{source} is missing or empty; train first")
    export(source, folder)
    return True


def _names(spark: SparkSession, folder: str) -> set[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


def read_captions(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """idx, caption ('' where the field is missing, null where it is null) and the raw line.

    Blank lines are skipped; a malformed one fails the read, or with ``permissive`` gives a row
    whose idx and caption are null. Unknown fields live on in ``raw``.
    """
    lines = spark.read.text(path).withColumn("raw", F.trim(F.regexp_replace("value", r"^\s+|\s+\z", ""))).where("raw <> ''").drop("value")
    parsed = lines.withColumn("v", F.try_parse_json("raw") if permissive else F.parse_json("raw"))
    keys = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    caption = F.when(F.col("v").isNotNull() & ~F.coalesce(F.map_contains_key(keys, F.lit("caption")), F.lit(False)), F.lit("")).otherwise(F.try_variant_get("v", "$.caption", "string"))
    return parsed.select(F.try_variant_get("v", "$.idx", "string").alias("idx"), caption.alias("caption"), "raw")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Dataset list in YAML (small, read by the driver): manifest with weights, or with a name."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = yaml.safe_load(text) or []
    if rows and "weights" in rows[0]:
        return spark.createDataFrame([(float(r["hours"]), r["manifest"], float(r["weights"])) for r in rows], TRAIN_REGISTRY)
    return spark.createDataFrame([(r.get("name", "valid"), r["manifest"]) for r in rows], TEST_REGISTRY)


def resample(cuts: DataFrame, rate: int) -> DataFrame:
    """Sampling rate and the number of samples that follows from the duration."""
    return cuts.withColumns({"sampling_rate": F.lit(rate), "num_samples": F.rint(F.col("duration") * rate).cast("long")})


def write_records(df: DataFrame, path: str, key: str = "idx", order: str | None = None, raw: str = "raw") -> None:
    """``<key>.json`` a record: the ``raw`` JSON object with the other columns as further fields, indented.

    Of rows with one key the last in ``order`` is written; without ``order`` keys must be unique.
    All files come into being together, or none.
    """
    from tessera.operators.generate import last_by_key

    if order is not None:
        df = last_by_key(df, key, order).drop(order)
    added = [c for c in df.columns if c not in (key, raw)]
    named_files.write(named_files.records(df, raw, added, key), path, "name", "content")


def result_lines(results: DataFrame) -> DataFrame:
    """``id | hyp | ref`` lines, sorted by the three in code-point order, stripped."""
    from tessera.functions.text import py_strip

    rows = results.select("cut_id", py_strip(F.col("hyp")).alias("hyp"), py_strip(F.col("ref")).alias("ref"))
    return rows.orderBy("cut_id", "hyp", "ref").select(F.concat_ws(" | ", "cut_id", "hyp", "ref").alias("line"))


def accuracy_line(correct: int, total: int) -> str:
    """Summary line of a test set."""
    return f"Accuracy: {correct / total * 100 if total else 0.0:.2f}% ({correct}/{total})"


def read_waveforms(spark: SparkSession, path: str, decode) -> DataFrame:
    """path and samples (channel 0); ``decode`` turns the bytes of a file into a float array."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for f in frames:
            yield f.assign(samples=[decode(x) for x in f["content"]])[["path", "samples"]]

    return files.mapInPandas(run, "path string, samples array<float>")


def model_type(raw: str = "value"):
    """``model_type`` of a raw JSON config; '' where it is missing."""
    return F.coalesce(F.get_json_object(raw, "$.model_type"), F.lit(""))
