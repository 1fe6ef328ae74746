"""Queries over masks, look-ahead generation, dynamic buckets and named files, with their SQL twins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import signals as sg
from tessera.operators import bucketing, generate, lookahead, mask, ordering, resume, signals
from tessera.plans import paths, views as v
from tessera.plans.catalogue import _MATCH, query
from tessera.plans.views import sql_strip, with_views
from tessera.sources import manifests, named_files, scratch, splittable
from tessera.streaming import progress, shuffle

SIDE, OUTER, MICRO = 128, 40, 8

# --- the mask of packed sequences ----------------------------------------------------------------

_SEGMENTS = "lens AS (SELECT seq_id, count(*) AS n FROM tokens GROUP BY seq_id), segs AS (SELECT seq_id, n, CAST(sum(n) OVER (ORDER BY seq_id) - n AS BIGINT) AS first FROM lens)"


def _segments(spark, sf):
    return mask.segments(v.tokens(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("length")), "seq_id")


@query(with_views("tokens", more=_SEGMENTS, body="SELECT seq_id AS segment, first + i AS q, first AS k_from, first + i AS k_to FROM (SELECT *, unnest(range(n)) AS i FROM segs)"))
def mask_intervals(spark, sf):
    return mask.intervals(_segments(spark, sf))


@query(
    with_views(
        "tokens",
        more=_SEGMENTS,
        body=f"SELECT (first + i) // {SIDE} AS q_tile, (first + j) // {SIDE} AS k_tile, count(*) AS allowed FROM (SELECT first, i, unnest(range(i + 1)) AS j FROM (SELECT first, unnest(range(n)) AS i FROM segs)) GROUP BY 1, 2",
    )
)
def mask_tiles(spark, sf):
    return mask.tiles(_segments(spark, sf), SIDE)


@query(
    with_views(
        "tokens",
        more=_SEGMENTS + ", q AS (SELECT first, first + i AS q FROM (SELECT first, unnest(range(n)) AS i FROM segs)), blocks AS (SELECT seq_id AS block, first + n - 16 AS q_from, first + n + 15 AS q_to, first + n - 40 AS k_from, first + n + 7 AS k_to FROM segs)",
        body="SELECT block, q, greatest(first, k_from) AS k_from, least(q, k_to) AS k_to FROM q JOIN blocks ON q BETWEEN q_from AND q_to WHERE greatest(first, k_from) <= least(q, k_to)",
    )
)
def mask_query_blocks(spark, sf):
    """Blocks of 32 queries by 48 keys across the end of every sequence."""
    packed = _segments(spark, sf)
    end = F.col("last") + 1
    blocks = packed.select(F.col("segment").alias("block"), (end - 16).alias("q_from"), (end + 15).alias("q_to"), (end - 40).alias("k_from"), (end + 7).alias("k_to"))
    return mask.expand(packed, blocks, 256)


# --- generation ----------------------------------------------------------------------------------


def _prompt(row: dict) -> str:
    if len(row["caption"]) % 7 == 3:
        raise ValueError("unfit")
    return row["caption"]


@query(
    f"""WITH placed AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p, length(text) % 7 = 3 AS bad FROM documents),
    ready AS (SELECT doc_id, text, p // {OUTER} AS outer_id, row_number() OVER (PARTITION BY p // {OUTER} ORDER BY p) - 1 AS r FROM placed WHERE NOT bad)
    SELECT CAST(doc_id AS VARCHAR) AS idx, CAST(outer_id AS BIGINT) AS outer_id, CAST(r // {MICRO} AS BIGINT) AS micro, CAST(r % {MICRO} AS BIGINT) AS place, md5(right(text, 64)) AS response_md5, CASE WHEN length(text) > 64 THEN 'length' ELSE 'stop' END AS finish_reason, 'ok' AS status FROM ready
    UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(p // {OUTER} AS BIGINT), NULL, NULL, NULL, NULL, 'failed' FROM placed WHERE bad"""
)
def generate_look_ahead(spark, sf):
    """Every caption through the look-ahead loop into a sink, rows that can't be prepared apart."""
    rows = v.captions(spark, sf).select("doc_id", "idx", "caption")
    out = lookahead.generate_into(rows, "idx", ["doc_id"], scratch.path(spark, "generated"), _prompt, generate.echo(64), OUTER, MICRO)
    return out.select("idx", F.col("outer").alias("outer_id"), "micro", "place", F.md5("response").alias("response_md5"), "finish_reason", "status")


# --- buckets and batches -------------------------------------------------------------------------

_RATIO = repr(math.log((1 + bucketing.ERROR) / (1 - bucketing.ERROR)))
_BINS = f"bins AS (SELECT CAST(ceil(ln(duration) / CAST('{_RATIO}' AS DOUBLE)) AS INTEGER) AS bin, count(*) AS n, sum(duration) AS total FROM cuts WHERE duration > 0 GROUP BY 1)"
_ENDS = f"""{_BINS}, risen AS (SELECT bin, sum(total) OVER (ORDER BY bin) AS seen, sum(total) OVER () AS every FROM bins),
    ends AS (SELECT DISTINCT 2 * pow(CAST('{(1 + bucketing.ERROR) / (1 - bucketing.ERROR)!r}' AS DOUBLE), min(bin)) / (CAST('{(1 + bucketing.ERROR) / (1 - bucketing.ERROR)!r}' AS DOUBLE) + 1) AS e FROM risen, (SELECT unnest(range(1, 10)) AS share) WHERE seen >= every * share / 10 GROUP BY share)"""


def _ends(spark, sf):
    return bucketing.bounds(bucketing.sketch(v.cuts(spark, sf), "duration"), 10)


@query(with_views("cuts", more=_BINS, body="SELECT bin, n, round(total, 2) AS total FROM bins"))
def length_sketch(spark, sf):
    return bucketing.sketch(v.cuts(spark, sf), "duration").withColumn("total", F.round("total", 2))


@query(
    with_views(
        "cuts",
        recursive=True,
        more=f"""{_ENDS},
        placed AS (SELECT doc_id, mel_frames AS val, md5('5|' || CAST(doc_id AS VARCHAR)) AS h, (SELECT count(*) FROM ends WHERE duration > e) AS bucket FROM cuts),
        dealt AS (SELECT *, CAST(('0x' || substr(md5('shard|' || h), 1, 8)) AS BIGINT) % 4 AS shard FROM placed),
        lined AS (SELECT *, row_number() OVER (PARTITION BY shard, bucket ORDER BY h, doc_id) AS o FROM dealt),
        fold AS (SELECT shard, bucket, o, doc_id, val, CAST(0 AS BIGINT) AS batch_id, val AS held FROM lined WHERE o = 1
        UNION ALL SELECT l.shard, l.bucket, l.o, l.doc_id, l.val, CASE WHEN f.held + l.val <= 12000 THEN f.batch_id ELSE f.batch_id + 1 END, CASE WHEN f.held + l.val <= 12000 THEN f.held + l.val ELSE l.val END FROM fold f JOIN lined l ON l.shard = f.shard AND l.bucket = f.bucket AND l.o = f.o + 1)""",
        body="SELECT CAST(shard AS INTEGER) AS shard, CAST(bucket AS BIGINT) AS bucket, batch_id, doc_id FROM fold",
    )
)
def dynamic_batches(spark, sf):
    """Batches of at most 120 seconds in ten buckets of equal total duration, four consumers."""
    ends = _ends(spark, sf)
    return bucketing.dynamic_batches(v.cuts(spark, sf), "doc_id", "duration", "mel_frames", 12_000, ends, 5, 4).select("shard", "bucket", "batch_id", "doc_id")


@query(
    with_views(
        "cuts",
        recursive=True,
        more=f"""{_ENDS},
        placed AS (SELECT doc_id, mel_frames AS val, md5('5|' || CAST(doc_id AS VARCHAR)) AS h, (SELECT count(*) FROM ends WHERE duration > e) AS bucket FROM cuts),
        lined AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id) AS o FROM placed),
        fold AS (SELECT bucket, o, val, CAST(0 AS BIGINT) AS batch_id, val AS held FROM lined WHERE o = 1
        UNION ALL SELECT l.bucket, l.o, l.val, CASE WHEN f.held + l.val <= 12000 THEN f.batch_id ELSE f.batch_id + 1 END, CASE WHEN f.held + l.val <= 12000 THEN f.held + l.val ELSE l.val END FROM fold f JOIN lined l ON l.bucket = f.bucket AND l.o = f.o + 1),
        sizes AS (SELECT bucket, batch_id, count(*) AS n, sum(val) AS used, max(val) AS widest FROM fold GROUP BY 1, 2)""",
        body="SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(used) AS BIGINT) AS used, CAST(sum(n * widest) AS BIGINT) AS padded, round(1 - CAST(sum(used) AS DOUBLE) / sum(n * widest), 6) AS waste FROM sizes GROUP BY 1",
    )
)
def batch_padding(spark, sf):
    """What padding the batches of one consumer wastes, by bucket."""
    rows = bucketing.dynamic_batches(v.cuts(spark, sf), "doc_id", "duration", "mel_frames", 12_000, _ends(spark, sf), 5, 1)
    return bucketing.padding(rows, "mel_frames").withColumn("waste", F.round("waste", 6))


_STEPS = _ENDS + """,
        placed AS (SELECT doc_id, mel_frames AS val, md5('5|' || CAST(doc_id AS VARCHAR)) AS h, (SELECT count(*) FROM ends WHERE duration > e) AS bucket FROM cuts),
        lined AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id) AS o FROM placed),
        fold AS (SELECT bucket, o, doc_id, val, CAST(0 AS BIGINT) AS batch_id, val AS held FROM lined WHERE o = 1
        UNION ALL SELECT l.bucket, l.o, l.doc_id, l.val, CASE WHEN f.held + l.val <= 12000 THEN f.batch_id ELSE f.batch_id + 1 END, CASE WHEN f.held + l.val <= 12000 THEN f.held + l.val ELSE l.val END FROM fold f JOIN lined l ON l.bucket = f.bucket AND l.o = f.o + 1),
        steps AS (SELECT epoch, bucket, batch_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('3|' || epoch || '|' || bucket || '|' || batch_id), bucket, batch_id) - 1 AS step FROM (SELECT DISTINCT bucket, batch_id FROM fold) CROSS JOIN (VALUES (1), (2)) t(epoch))"""


@query(with_views("cuts", recursive=True, more=_STEPS, body="SELECT CAST(epoch AS INTEGER) AS epoch, CAST(step AS BIGINT) AS step, doc_id FROM fold JOIN steps USING (bucket, batch_id) WHERE epoch > 1 OR step >= 5"))
def resume_from(spark, sf):
    """Two epochs of one consumer's batches, read on from step 5 of the first."""
    rows = bucketing.dynamic_batches(v.cuts(spark, sf), "doc_id", "duration", "mel_frames", 12_000, _ends(spark, sf), 5, 1)
    path = scratch.path(spark, "epochs")
    resume.write_epochs(scratch.materialize(rows.select("bucket", "batch_id", "place", "doc_id"), "batches"), ["bucket", "batch_id"], "place", path, 3, range(1, 3), per_part=50)
    return resume.read_from(spark, path, 1, 5).select("epoch", "step", "doc_id")


# --- streams -------------------------------------------------------------------------------------


def _stream(spark, rows, epochs, ends):
    """A file stream of the rows, once an epoch, one epoch after the other."""
    folder = scratch.path(spark, "stream")
    for epoch in range(epochs):
        rows.select(F.lit(epoch).cast("long").alias("epoch"), "*").write.mode("append").parquet(folder)
    if ends is not None:
        shuffle.epoch_end(spark, rows.select(F.lit(0).cast("long").alias("epoch"), "*"), epochs, ends).write.mode("append").parquet(folder)
    schema = "epoch long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", shard int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


@query("SELECT CAST(e AS BIGINT) AS epoch, CAST((row_number() OVER (PARTITION BY e ORDER BY doc_id) - 1) % 4 AS INTEGER) AS shard, doc_id, n_chars FROM documents CROSS JOIN (VALUES (0), (1)) t(e)")
def buffered_shuffle(spark, sf):
    """Two epochs of the documents through a buffer of 50 rows a shard; every epoch comes out whole."""
    rows = ordering.position(v.table(spark, sf, "documents").select("doc_id", "n_chars"), "pos", None, ["doc_id"]).withColumn("pos", F.col("pos").cast("long"))
    out = scratch.path(spark, "shuffled")
    mixed = shuffle.buffered_shuffle(_stream(spark, rows, 2, 4), 7, 50, 4)
    mixed.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(mixed.schema).parquet(out).select("epoch", "shard", "doc_id", "n_chars")


@query("SELECT CAST(3 * count(*) AS BIGINT) AS rows, CAST(3 * sum(n_chars) AS DOUBLE) AS chars FROM documents")
def stream_progress(spark, sf):
    """Totals of the progress table of a stream that writes the documents three times."""
    rows = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    folder = scratch.path(spark, "progress")
    stream = _stream(spark, rows, 3, None).drop("shard")
    query_ = progress.write(stream, lambda batch: batch, scratch.path(spark, "written"), scratch.path(spark, "offsets"), folder, {"chars": F.sum("n_chars")}, name="documents")
    query_.awaitTermination()
    spark.streams.removeListener(query_.listener)
    return progress.table(spark, folder).agg(F.sum("rows").alias("rows"), F.sum(F.col("metrics")["chars"]).alias("chars"))


# --- named files ---------------------------------------------------------------------------------


@query(
    """SELECT CAST(doc_id AS VARCHAR) || '.json' AS name, md5('{' || chr(10) || '  "idx": "' || CAST(doc_id AS VARCHAR) || '",' || chr(10) || '  "caption": ' || CAST(to_json(text) AS VARCHAR) || ',' || chr(10) || '  "response": ' || CAST(to_json(right(text, 20)) AS VARCHAR) || chr(10) || '}') AS content_md5 FROM documents"""
)
def record_files(spark, sf):
    """One JSON file a caption, of repeated ones the last; every tenth is written twice."""
    rows = v.captions(spark, sf).select("idx", F.to_json(F.struct("idx", "caption")).alias("raw"), F.right("caption", F.lit(20)).alias("response"), F.col("doc_id").alias("p"))
    again = rows.where("p % 10 = 0").withColumns({"response": F.lit("earlier"), "p": F.col("p") - 1_000_000})
    folder = scratch.path(spark, "records")
    manifests.write_records(rows.unionByName(again), folder, order="p")
    return named_files.read(spark, folder).select("name", F.md5("content").alias("content_md5"))


@query(
    with_views(
        "qa_results",
        more=f"sets AS (SELECT * FROM (VALUES ('set0'), ('set1'), ('set2'), ('empty')) t(test_set)), scores AS (SELECT test_set, count(*) FILTER (WHERE {_MATCH}) AS correct, count(*) AS total FROM qa_results GROUP BY test_set)",
        body=f"SELECT 'qa_results-' || test_set || '.txt' AS name, md5(string_agg(id || ' | ' || {sql_strip('hyp')} || ' | ' || {sql_strip('ref')} || chr(10), '' ORDER BY id, {sql_strip('hyp')}, {sql_strip('ref')})) AS content_md5 FROM qa_results JOIN sets USING (test_set) GROUP BY test_set UNION ALL SELECT 'accuracy-' || test_set || '.txt', md5(printf('Accuracy: %.2f%% (%d/%d)', CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / total * 100 ELSE CAST(0 AS DOUBLE) END, CAST(coalesce(correct, 0) AS BIGINT), CAST(coalesce(total, 0) AS BIGINT)) || chr(10)) FROM sets LEFT JOIN scores USING (test_set)",
    )
)
def qa_evaluation_files(spark, sf):
    """The files of an evaluation as they lie in the folder."""
    sets = spark.createDataFrame([("set0",), ("set1",), ("set2",), ("empty",)], "test_set string")
    folder = scratch.path(spark, "evaluation")
    paths.write_evaluation(paths.evaluate(v.qa_results(spark, sf).withColumnRenamed("id", "cut_id"), sets, F.lit("")), folder)
    return named_files.read(spark, folder).select("name", F.md5("content").alias("content_md5"))


# --- manifests, waveforms and features -----------------------------------------------------------


@query(with_views("cuts", body="SELECT id, CAST(mel_frames AS BIGINT) AS mel_frames, md5(text) AS text_md5 FROM cuts WHERE mel_frames > 500"))
def split_manifest(spark, sf):
    """Cuts written as gzip of small members, read by many tasks, the condition tried by the source."""
    folder = scratch.path(spark, "manifest")
    splittable.write(v.cuts(spark, sf).select("id", "mel_frames", "text"), folder, 100_000)
    rows = splittable.read(spark, folder, "id string, mel_frames long, text string", 200_000).where("mel_frames > 500")
    return rows.select("id", "mel_frames", F.md5("text").alias("text_md5"))


_RATE, _FFT, _HOP, _BANDS = 6400, 16, 4, 5
#: Frames, windows, a plain Fourier transform and triangular filters over the samples of each vector.
_MEL_SQL = f"""WITH samples AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    lens AS (SELECT vec_id, count(*) AS n FROM samples GROUP BY 1),
    frames AS (SELECT vec_id, unnest(range((n + {_HOP} // 2) // {_HOP})) AS t FROM lens),
    cut AS (SELECT f.vec_id, f.t, s.i - ({_HOP} // 2 + f.t * {_HOP} - {_FFT} // 2) AS j, s.x FROM frames f JOIN samples s ON s.vec_id = f.vec_id AND s.i BETWEEN {_HOP} // 2 + f.t * {_HOP} - {_FFT} // 2 AND {_HOP} // 2 + f.t * {_HOP} - {_FFT} // 2 + {_FFT} - 1),
    bins AS (SELECT unnest(range({_FFT} // 2 + 1)) AS k),
    power AS (SELECT vec_id, t, k, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {_FFT})) * cos(2 * pi() * k * j / {_FFT})), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {_FFT})) * sin(2 * pi() * k * j / {_FFT})), 2) AS p FROM cut CROSS JOIN bins GROUP BY 1, 2, 3),
    edges AS (SELECT i, 700 * (pow(10, i * (2595 * log10(1 + {_RATE} / 2.0::DOUBLE / 700)) / ({_BANDS} + 1) / 2595) - 1) AS e FROM (SELECT unnest(range({_BANDS} + 2)) AS i)),
    weights AS (SELECT a.i AS band, k, greatest(0, least((k * {_RATE} / {_FFT}::DOUBLE - a.e) / (b.e - a.e), (c.e - k * {_RATE} / {_FFT}::DOUBLE) / (c.e - b.e))) AS w FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2 CROSS JOIN bins)
    SELECT vec_id, CAST(t AS BIGINT) AS t, CAST(band AS BIGINT) AS band, round(ln(greatest(sum(w * p), 1e-10)), 5) AS energy FROM power JOIN weights USING (k) GROUP BY 1, 2, 3"""


@query(_MEL_SQL)
def log_mel_features(spark, sf):
    """Log-mel energies of the embeddings, taken as waveforms."""
    rows = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = signals.log_mel(rows, "x", _RATE, _FFT, _HOP, _BANDS).select("vec_id", F.posexplode("features").alias("t", "f"))
    out = out.select("vec_id", "t", F.posexplode("f").alias("band", "e"))
    return out.select("vec_id", F.col("t").cast("long").alias("t"), F.col("band").cast("long").alias("band"), F.round("e", 5).alias("energy"))


_HALF = sg.CROSSINGS * 3


def _wav(df):
    """vec_id and a 16-bit file of the vector at 6,400 a second; every tenth is cut short."""

    def run(batches):
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), [sg.encode_wav(np.rint(np.array(x, float) * 4096) / 32768, 6400) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[:70] if i % 10 == 3 else r for i, r in zip(ids, raws, strict=True)], pa.binary())], names=["vec_id", "content"])

    return df.mapInArrow(run, "vec_id long, content binary")


@query(
    f"""WITH samples AS (SELECT vec_id, greatest(-32768, least(32767, round_even(unnest(embedding)::DOUBLE * 4096, 0))) / 32768 AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE vec_id % 10 <> 3),
    places AS (SELECT vec_id, unnest(range(CAST(ceil(count(*) * 3 / 2.0) AS BIGINT))) AS m FROM samples GROUP BY vec_id),
    taps AS (SELECT p.vec_id, p.m, s.x, p.m * 2 - s.k * 3 AS t FROM places p JOIN samples s ON s.vec_id = p.vec_id AND abs(p.m * 2 - s.k * 3) <= {_HALF})
    SELECT vec_id, CAST(m AS BIGINT) AS place, round(sum(x * (CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 3) / (pi() * t / 3) END) * (0.5 + 0.5 * cos(pi() * t / {_HALF}))) + 3e-8, 7) + 0.0 AS sample, CAST(NULL AS VARCHAR) AS error FROM taps GROUP BY 1, 2
    UNION ALL SELECT vec_id, NULL, NULL, 'chunk b''data'' is cut short' FROM embeddings WHERE vec_id % 10 = 3"""
)
def waveforms(spark, sf):
    """WAV files decoded and resampled from 6,400 to 9,600 a second; files that are cut short say so.

    Samples are shown on a decimal grid moved by 3e-8, which no 16-bit value meets halfway.
    """
    files = _wav(v.table(spark, sf, "embeddings").select("vec_id", "embedding"))
    read = signals.decode(files, target=9600)
    return read.select("vec_id", F.posexplode_outer("samples").alias("place", "x"), "error").select("vec_id", F.col("place").cast("long").alias("place"), (F.round(F.col("x") + 3e-8, 7) + F.lit(0.0)).alias("sample"), "error")
