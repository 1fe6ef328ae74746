"""Places for outside code: tokenizers, feature extractors and transforms, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenize(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[int]]]], name: str = "input_ids", batch: int = 1024, kind: str = "array<int>") -> DataFrame:
    """Add token ids from a batch tokenizer that ``make`` loads once a task; null text has none."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for frame in frames:
            encode = encode or make()
            texts, out = ["" if t is None else t for t in frame[text]], []
            for i in range(0, len(texts), batch):
                out += encode(texts[i : i + batch])
            yield frame.assign(**{name: out})

    return df.mapInPandas(run, schema)


def decode(df: DataFrame, ids: str, make: Callable[[], Callable[[list[list[int]]], list[str]]], name: str = "text", batch: int = 1024) -> DataFrame:
    """Add the texts of token ids from a batch decoder that ``make`` loads once a task; null ids give ''."""
    return tokenize(df, ids, lambda: _listed(make()), name, batch, "string")


def _listed(f: Callable) -> Callable:
    return lambda rows: f([list(r) for r in rows])


def extract_features(df: DataFrame, samples: str, make: Callable[[], Callable[[list], tuple[list, list[int]]]]) -> DataFrame:
    """Add ``features`` (frames of floats, padded to the batch) and ``feature_len`` (true frames)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "features array<array<float>>, feature_len long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = None
        for frame in frames:
            extract = extract or make()
            features, lengths = extract(frame[samples].tolist())
            yield frame.assign(features=features, feature_len=lengths)

    return df.mapInPandas(run, schema)


def apply_all(df: DataFrame, transforms: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Transforms in list order."""
    for f in transforms:
        df = df.transform(f)
    return df


def register_token(tokens: Column, token: str) -> Column:
    """Special tokens with ``token`` appended, unless it is there."""
    return F.when(F.array_contains(tokens, token), tokens).otherwise(F.concat(tokens, F.array(F.lit(token))))


def top_k(scores: Column, k: int | Column) -> Column:
    """The k best as array<struct<score, place>>, equal scores by place (0-based)."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("minus"), i.cast("long").alias("place")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(best, lambda p: F.struct((-p["minus"]).alias("score"), p["place"].alias("place")))


def top_p(scores: Column, p: float, temperature: float = 1.0, k: int | None = None) -> Column:
    """The best scores whose softmax chances at ``temperature`` first add up to ``p``, as :func:`top_k`.

    With ``k`` the chances are those among the k best. The best score always stays.
    """
    best = top_k(scores, F.size(scores) if k is None else k)
    weights = F.transform(best, lambda b: F.exp((b["score"] - F.get(best, F.lit(0))["score"]) / temperature))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    walk = lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["n"] + F.when((a["n"] == 0) | (a["sum"] < p * total), 1).otherwise(0)).alias("n"))
    return F.slice(best, 1, F.aggregate(weights, start, walk)["n"])


def merge(left: Column, right: Column) -> Column:
    """Union of two maps; where both have a key, the value is that of ``right``."""
    only = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.coalesce(F.map_concat(only, right), left, right)


def result_name(test_set: Column, suffix: Column, kind: str = "qa_results") -> Column:
    """File name of a result; the suffix follows a dash where there is one."""
    tail = F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(F.lit("-"), suffix)).otherwise(F.lit(""))
    return F.concat(F.lit(kind + "-"), test_set, tail, F.lit(".txt"))


def freeze(modules: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """(prefixes to freeze, names without a module), so that a missing one can be warned of."""
    there = [m for m in modules if any(k == m or k.startswith(m + ".") for k in known)]
    return there, [m for m in modules if m not in there]


#: Names of number types; any other name stands for the widest.
DTYPES = {"fp16": "float16", "bf16": "bfloat16"}


def number_type(name: str = "fp16") -> str:
    return DTYPES.get(name, "float32")


def decode_options(method: str, max_new_tokens: int = 200, beams: int = 4) -> dict[str, object]:
    """Options of a generation pass: one beam for greedy search, else ``beams``; never sampled."""
    return {"max_new_tokens": max_new_tokens, "num_beams": 1 if method == "greedy_search" else beams, "do_sample": False}


def resolve_config(config: Column, default: str) -> Column:
    """A map of settings whose ``model_type`` is ``default`` where it is missing; a null map is empty.

    The caller's other settings stay; a ``model_type`` that is there but null is kept.
    """
    given = F.coalesce(config, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return merge(F.create_map(F.lit("model_type"), F.lit(default)), given)
