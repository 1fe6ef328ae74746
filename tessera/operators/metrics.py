"""Scores and training metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import tolerant_match
from tessera.operators import ordering


def qa_accuracy(results: DataFrame, test_sets: DataFrame, test_set: str = "test_set", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """correct, total and accuracy in percent for every test set; a set without rows has 0.0."""
    scored = results.groupBy(test_set).agg(F.sum(tolerant_match(F.col(hyp), F.col(ref)).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))
    out = test_sets.select(test_set).distinct().join(scored, test_set, "left").na.fill(0, ["correct", "total"])
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total") * 100).otherwise(F.lit(0.0)))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def token_accuracy(rows: DataFrame, sequence: str, pos: str, predicted: str, label: str, ignore: int = -100) -> DataFrame:
    """Share of positions whose prediction is the next label; ignored labels don't count; 0 if none."""
    following = F.lead(label).over(Window.partitionBy(sequence).orderBy(pos))
    scored = rows.withColumn("_next", following)
    valid = F.col("_next").isNotNull() & (F.col("_next") != ignore)
    out = scored.groupBy(sequence).agg(F.sum((valid & (F.col(predicted) == F.col("_next"))).cast("long")).alias("correct"), F.sum(valid.cast("long")).alias("total"))
    out = out.na.fill(0, ["correct", "total"])
    return out.withColumn("acc", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


def weighted_metrics(rows: DataFrame, name: str, value: str, samples: str) -> DataFrame:
    """Mean of each metric, weighted by samples."""
    return rows.groupBy(name).agg((F.sum(F.col(value) * F.col(samples)) / F.sum(samples)).alias(value))


def param_summary(params: DataFrame, frozen: list[str]) -> DataFrame:
    """Total and trainable elements by module (the first part of a name); frozen ones by dotted prefix."""
    is_frozen = F.lit(False)
    for prefix in frozen:
        is_frozen = is_frozen | (F.col("name") == prefix) | F.col("name").startswith(prefix + ".")
    free = F.col("requires_grad") & ~is_frozen
    return params.groupBy(F.substring_index("name", ".", 1).alias("module")).agg(F.sum("numel").alias("total"), F.coalesce(F.sum(F.when(free, F.col("numel"))), F.lit(0)).alias("trainable"))


def ema(rows: DataFrame, name: str, step: str, value: str, decay: float = 0.9999, period: int = 100) -> DataFrame:
    """avg = decay * avg + (1 - decay) * value over the steps that are multiples of ``period``, not 0.

    The first kept value starts the average. In closed form, value i of n weighs
    (1 - decay) * decay^(n-i), the first decay^(n-1); so a sum by group replaces the ordered fold.
    """
    kept = rows.where((F.col(step) % period == 0) & (F.col(step) > 0))
    kept = ordering.running(kept, "_i", ordering.id_bucket(step), [step], within=[name])
    n = kept.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.when(F.col("_i") == 1, F.pow(F.lit(decay), F.col("_n") - 1)).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("_n") - F.col("_i")))
    return ordering.with_totals(kept, n, [name]).groupBy(name).agg(F.sum(F.col(value) * weight).alias("ema"))


def accumulation_windows(rows: DataFrame, name: str, step: str, value: str, every: int) -> DataFrame:
    """Sum of value / every over each run of ``every`` steps of a name; the last run may be short."""
    placed = ordering.position(rows, "_p", ordering.id_bucket(step), [step], within=[name])
    return placed.groupBy(name, F.floor(F.col("_p") / every).cast("long").alias("window")).agg((F.sum(value) / every).alias("loss"))


def clip_norm(rows: DataFrame, group: str, value: str, threshold: float = 1.0) -> DataFrame:
    """Scale the values of a group so that their norm is at most the threshold."""
    norm = rows.groupBy(group).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    scale = F.least(F.lit(1.0), F.lit(threshold) / (F.col("_norm") + 1e-6))
    return ordering.with_totals(rows, norm, [group]).withColumn(value, F.col(value) * scale).drop("_norm")


def estimated_batches(rows: DataFrame, size: int) -> DataFrame:
    """Rows div size plus one, which is one too many for exact multiples."""
    return rows.agg((F.floor(F.count(F.lit(1)) / size) + 1).cast("long").alias("n"))


def with_progress(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The rows, and the number of them that an action has passed through (``.get["rows"]`` afterwards)."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def progress(rows: DataFrame, batch: str, every: int = 50) -> DataFrame:
    """Records up to and with each ``every``-th batch (0-based), as a log shows them."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    return ordering.running(sizes, "cuts", None, [batch], value=F.col("_n")).where(F.col(batch) % every == 0).select(batch, "cuts")
