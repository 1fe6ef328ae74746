"""Checkpoint listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files that hold weights.
WEIGHT_FILES = ("model.safetensors", "model.safetensors.index.json", "pytorch_model.bin", "pytorch_model.bin.index.json")


def has_weights(files: Column) -> Column:
    return F.exists(files, lambda f: f.isin(*WEIGHT_FILES))


def resolve(df: DataFrame, exp_dir: str) -> DataFrame:
    """Add path and label from filename (absolute or under ``exp_dir``), else iter, else epoch."""
    d = F.lit(exp_dir + "/")
    named = F.col("filename").isNotNull() & (F.col("filename") != "")
    base = F.substring_index("filename", "/", -1)
    stem = F.when(base.rlike(r".\.[^.]*\z"), F.regexp_replace(base, r"\.[^.]*\z", "")).otherwise(base)
    it, ep = F.coalesce(F.col("iter"), F.lit(0)), F.coalesce(F.col("epoch"), F.lit(0))
    none = F.raise_error(F.lit("give a filename, an iteration or an epoch")).cast("string")
    path = F.when(named & F.col("filename").startswith("/"), F.col("filename")).when(named, F.concat(d, "filename"))
    path = path.when(it > 0, F.concat(d, F.lit("checkpoint-"), it.cast("string"), F.lit(".pt"))).when(ep > 0, F.concat(d, F.lit("epoch-"), ep.cast("string"), F.lit(".pt"))).otherwise(none)
    label = F.when(named, stem).when(it > 0, F.concat(F.lit("iter-"), it.cast("string"))).when(ep > 0, F.concat(F.lit("epoch-"), ep.cast("string"))).otherwise(none)
    return df.withColumns({"path": path, "label": label})


def keep_last(df: DataFrame, group: str, step: str, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(step)))).where(F.col("_r") <= k).drop("_r")


def strip_key_prefix(df: DataFrame, group: str, key: str, prefix: str = "module.") -> DataFrame:
    """If any key of a group has the prefix, every key of it loses as many characters."""
    any_ = F.bool_or(F.col(key).startswith(prefix)).over(Window.partitionBy(group))
    return df.withColumn(key, F.when(any_, F.expr(f"substring({key}, {len(prefix) + 1})")).otherwise(F.col(key)))


def strip_map_prefix(state: Column, prefix: str = "module.") -> Column:
    """The same on the keys of a map."""
    cut = F.transform_keys(state, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
    return F.when(F.exists(F.map_keys(state), lambda k: k.startswith(prefix)), cut).otherwise(state)


def ordered_distinct(*lists: Column) -> Column:
    """Union of arrays in order of first appearance."""
    return F.array_distinct(F.concat(*lists))
