"""Batch generation hook: prompts in, responses out, through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Generator = Callable[[list[str]], list[tuple[str, str]]]


def generate(df: DataFrame, prompt: str, make: Callable[[], Generator], batch: int = 32) -> DataFrame:
    """Add response and finish_reason. ``make`` runs once a task and gives the batch generator.

    Micro-batches hold at most ``batch`` prompts; the tail of a task is a batch of its own.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "response string, finish_reason string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or make()
            out: list[tuple[str, str]] = []
            prompts = frame[prompt].tolist()
            for i in range(0, len(prompts), batch):
                out += model(prompts[i : i + batch])
            yield frame.assign(response=[x for x, _ in out], finish_reason=[y for _, y in out])

    return df.mapInPandas(run, schema)


def echo(limit: int = 64) -> Callable[[], Generator]:
    """Deterministic stand-in: the prompt's last characters, cut by length beyond ``limit``."""

    def make() -> Generator:
        return lambda prompts: [(p[-limit:], "length" if len(p) > limit else "stop") for p in prompts]

    return make


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key that of the highest position, as a later write replaces a file.

    A maximum over structs is combined before the shuffle, so a hot key is no hot task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    top = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_m"))
    return top.select(key, *[F.col(f"_m.{c}").alias(c) for c in [order, *rest]])


def first_rows(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= k).drop("_r")
