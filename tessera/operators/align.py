"""Alignment of placeholders, tokens and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import AUDIO
from tessera.operators import ordering


def placeholder_count(text: Column, placeholder: str = AUDIO) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(placeholder), F.lit("")))) / len(placeholder)).cast("long")


def expand_placeholders(texts: DataFrame, lengths: DataFrame, key: str, text: str, placeholder: str = AUDIO) -> DataFrame:
    """Each placeholder, over all texts in key order, takes the next length and becomes that many.

    ``lengths``: (ordinal, n), 0-based. A length below 1 counts as 1, as does a missing one. Returns
    key and ``expanded``. The ordinals come from a bucketed running sum.
    """
    rows = texts.select(key, text).withColumn("_n", placeholder_count(F.col(text), placeholder))
    rows = ordering.running(rows, "_start", None, [key], value=F.col("_n"), inclusive=False)
    parts = rows.select(key, "_start", F.posexplode(F.split(F.col(text), _quoted(placeholder), -1)).alias("i", "part"))
    parts = parts.withColumn("ordinal", F.when(F.col("i") > 0, F.col("_start") + F.col("i") - 1))
    parts = parts.join(lengths, "ordinal", "left")
    copies = F.when(F.col("i") == 0, F.lit("")).otherwise(F.repeat(F.lit(placeholder), F.greatest(F.coalesce(F.col("n"), F.lit(1)), F.lit(1)).cast("int")))
    parts = parts.select(key, F.struct("i", F.concat(copies, F.col("part")).alias("s")).alias("p"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("expanded"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def merge_audio(tokens: DataFrame, audio: DataFrame, sequence: str, placeholder: str = AUDIO) -> DataFrame:
    """The k-th placeholder of a sequence takes its k-th audio row; later ones keep the text.

    ``tokens``: sequence, pos, token; ``audio``: sequence, k, value. Adds ``value`` (null: text).
    """
    order = Window.partitionBy(sequence).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("token") == placeholder
    ranked = tokens.withColumn("k", F.when(mark, F.sum(mark.cast("long")).over(order) - 1))
    return ranked.join(audio, [sequence, "k"], "left")


def causal_pairs(tokens: DataFrame, segment: str) -> DataFrame:
    """Number of allowed (query, key) pairs of the block-diagonal causal mask, a segment."""
    n = F.count(F.lit(1))
    return tokens.groupBy(segment).agg((n * (n + 1) / 2).cast("long").alias("allowed_pairs"))


def next_marker(marker: Column, sequence: str, pos: str = "pos") -> Column:
    """Position of the nearest marker at or after each position."""
    ahead = Window.partitionBy(sequence).orderBy(pos).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.min(F.when(marker, F.col(pos))).over(ahead)


def pack(tokens: DataFrame, mask: Column, sequence: str, pos: str = "pos") -> DataFrame:
    """Kept tokens end to end: packed_pos over all, position_id from 0 in each sequence."""
    kept = tokens.where(mask)
    first = ordering.running(kept.groupBy(sequence).agg(F.count(F.lit(1)).alias("_n")), "_first", None, [sequence], value=F.col("_n"), inclusive=False)
    kept = kept.withColumn("position_id", F.row_number().over(Window.partitionBy(sequence).orderBy(pos)).cast("long") - 1)
    return ordering.with_totals(kept, first.select(sequence, "_first"), [sequence]).withColumn("packed_pos", F.col("_first") + F.col("position_id")).drop("_first")


def pad(values: Column, width: Column, fill: Column, left: bool = False) -> Column:
    """An array padded to ``width``."""
    more = F.array_repeat(fill, F.greatest(width - F.size(values), F.lit(0)).cast("int"))
    return F.concat(more, values) if left else F.concat(values, more)


def unpad(values: Column, length: Column) -> Column:
    """The first ``length`` frames of a padded array."""
    return F.slice(values, 1, length)


def concat_frames(frames: DataFrame, rate: int, sequence: str = "seq_id", t: str = "t", vec: str = "vec") -> DataFrame:
    """Join each ``rate`` frames to one; a rest at the end is dropped."""
    g = frames.groupBy(sequence, F.floor(F.col(t) / rate).cast("long").alias("_t")).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(vec).alias("v")))).alias("_f"))
    g = g.where(F.size("_f") == rate)
    return g.select(sequence, F.col("_t").alias(t), F.flatten(F.transform("_f", lambda f: f["v"])).alias(vec))


def concat_frames_array(frames: Column, rate: int) -> Column:
    """The same over an array of frames."""
    n = F.floor(F.size(frames) / rate).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(F.slice(frames, i * rate + 1, rate)))).otherwise(F.slice(frames, 1, 0))


def transpose(matrix: Column) -> Column:
    """Rows become columns; all rows are as long as the first."""
    width = F.size(matrix[0])
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(matrix, lambda row: row[j]))


def label_spans(tokens: DataFrame, sequence: str, begin: str, end: str, header: list[str], token: str = "token", pos: str = "pos") -> DataFrame:
    """Add ``labelled``: true from after an assistant header to the first end marker, inclusive.

    Without an end marker a span runs to the end of the row. Two windows: the header test looks
    ahead, and the mask compares with the widest span that is open.
    """
    order = Window.partitionBy(sequence).orderBy(pos)
    test = F.col(token) == begin
    for i, h in enumerate(header, 1):
        test = test & F.coalesce(F.lead(token, i).over(order) == h, F.lit(False))
    rows = tokens.withColumns({"_start": test, "_end": next_marker(F.col(token) == end, sequence, pos), "_last": F.max(pos).over(Window.partitionBy(sequence))})
    # a header token is no end marker, so the marker after the begin marker is that after the header
    rows = rows.withColumn("_from", F.when(F.col("_start"), F.col(pos) + len(header) + 1))
    rows = rows.withColumn("_to", F.when(F.col("_start"), F.coalesce(F.col("_end"), F.col("_last"))))
    # of spans with one end the first covers the others, so the widest of the latest end decides;
    # a header inside an open span thus belongs to it
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.max(F.when(F.col("_start"), F.struct(F.col("_to").alias("to"), (-F.col("_from")).alias("minus")))).over(so_far)
    inside = (F.col(pos) >= -span["minus"]) & (F.col(pos) <= span["to"])
    return rows.withColumn("labelled", F.coalesce(inside, F.lit(False))).drop("_start", "_end", "_last", "_from", "_to")
