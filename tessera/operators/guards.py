"""Filters and checks of required fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_duration(df: DataFrame, low: float = 0.5, high: float = 30.0, column: str = "duration") -> DataFrame:
    """Both ends belong to the range."""
    return df.where(F.col(column).between(low, high))


def split_failed(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rejects); a null verdict is a failure."""
    bad = F.coalesce(failed, F.lit(True))
    return df.where(~bad), df.where(bad)


def require(df: DataFrame, id_column: str, *fields: str) -> DataFrame:
    """Raise, with the row's id, where a field is null."""
    checks = {f: F.when(F.col(f).isNotNull(), F.col(f)).otherwise(F.raise_error(F.concat(F.lit(f"{f} is missing in "), F.col(id_column).cast("string"))).cast(df.schema[f].dataType)) for f in fields}
    return df.withColumns(checks)


def has_required(*fields: str) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f).isNotNull()
    return out


def check_inputs(text: object, audio: object = None, features: object = None) -> None:
    """Raise unless there is text, and audio or features, not both."""
    if text is None:
        raise ValueError("text is required")
    if audio is not None and features is not None:
        raise ValueError("give audio or features, not both")


def contains_any(texts: DataFrame, items: DataFrame, text: str, item_text: str, key: str | None = None) -> DataFrame:
    """Pairs of a text and an item that it contains, by a hash join.

    A word inside an item (not its first or last) stands between white space in every text that
    contains the item; the longest such word is the join key. Items of fewer than three words have
    none; their key is their first characters, which meet the runs of as many characters in a text.
    With ``key``, a unique column of the texts, only it and the words are joined, and the whole texts
    of the hits come afterwards.
    """
    words = F.split(F.col(item_text), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w), w.alias("w"))))["w"]
    keyed = items.withColumn("_key", longest)
    few = keyed.where("_key IS NULL")
    out = _meet(texts, keyed.where("_key IS NOT NULL"), F.split(F.col(text), r"\s+"), text, item_text, key)
    shortest = few.agg(F.min(F.char_length(item_text)).alias("n")).first()["n"]
    if shortest is None:
        return out
    runs = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{min(shortest, 3)}}}))"), F.lit(1))
    return out.unionByName(_meet(texts, few.withColumn("_key", F.left(F.col(item_text), F.lit(min(shortest, 3)))), runs, text, item_text, key))


def _meet(texts: DataFrame, keyed: DataFrame, pieces: Column, text: str, item_text: str, key: str | None) -> DataFrame:
    """Texts and items that share a piece, and then all of the item."""
    rows = texts.select(key or "*", F.explode(F.array_distinct(pieces)).alias("_piece"))
    met = rows.join(keyed, F.col("_piece") == F.col("_key")).drop("_piece", "_key")
    return (met.join(texts, key) if key else met).where(F.contains(F.col(text), F.col(item_text))).select(*texts.columns, *[c for c in keyed.columns if c != "_key"])
