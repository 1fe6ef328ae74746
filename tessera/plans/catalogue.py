"""Every query by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lengths, text as tx
from tessera.operators import align, batching, chat, checkpoints, generate, guards, hooks, metrics as mt, ordering
from tessera.plans import paths, views as v
from tessera.plans.views import sql_answer, sql_normalize, sql_strip, sql_tokens, sql_turn, with_views
from tessera.sources import manifests, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CAPTION_LIMIT = 50
BATCH = 8
RATE = 12.5


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def _long(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


def _double(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


# --- sources -----------------------------------------------------------------------------------


@query(with_views("cuts", body="SELECT id, duration, CAST(mel_frames AS BIGINT) AS mel_frames FROM cuts"))
def manifest_scan(spark, sf):
    return v.cuts(spark, sf).select("id", "duration", F.col("mel_frames").cast("long").alias("mel_frames"))


@query(with_views("captions", body=f"SELECT idx, {_long('length(caption)')} AS caption_len FROM captions WHERE {sql_strip('caption')} <> ''"))
def scp_scan(spark, sf):
    rows = v.captions(spark, sf).where(tx.py_strip(F.col("caption")) != "")
    return rows.select("idx", F.char_length("caption").cast("long").alias("caption_len"))


@query("SELECT source AS name, CAST(1 + length(source) - length(replace(source, '1', '')) AS DOUBLE) AS weight FROM documents GROUP BY source")
def dataset_registry(spark, sf):
    rows = v.table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return rows.withColumn("weight", (1 + F.char_length("name") - F.char_length(F.replace("name", F.lit("1"), F.lit("")))).cast("double"))


@query(with_views("cuts", body="SELECT id, CAST(16000 AS INTEGER) AS sampling_rate, CAST(mel_frames * 160 AS BIGINT) AS num_samples FROM cuts"))
def resample_meta(spark, sf):
    return manifests.resample(v.cuts(spark, sf), 16000).select("id", "sampling_rate", "num_samples")


_LISTED = ["config.json", "model.safetensors", "notes.txt", "pytorch_model.bin.index.json", "tokenizer.json", "model.safetensors.bak"]


@query(f"SELECT event_id AS dir, len(list_filter(list_slice({_LISTED}, 1 + user_id % 6, user_id % 6 + event_id % 4), lambda f: f IN ('model.safetensors', 'pytorch_model.bin.index.json'))) > 0 AS has_weights FROM events")
def weights_present(spark, sf):
    """A listing of up to three files an event."""
    files = F.slice(F.array(*[F.lit(x) for x in _LISTED]), (F.col("user_id") % 6 + 1).cast("int"), (F.col("event_id") % 4).cast("int"))
    return v.table(spark, sf, "events").select(F.col("event_id").alias("dir"), checkpoints.has_weights(files).alias("has_weights"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def peek_json_field(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query(
    with_views(
        "captions",
        body="SELECT idx, md5(response) AS response_md5 FROM (SELECT idx, arg_max(response, p) AS response FROM (SELECT idx, doc_id AS p, caption AS response FROM captions UNION ALL SELECT idx, doc_id + 1000000000 AS p, caption || ' again' AS response FROM captions WHERE doc_id % 10 = 0) GROUP BY idx)",
    )
)
def generation_sink_dedup(spark, sf):
    rows = v.captions(spark, sf).select("idx", F.col("doc_id").alias("p"), F.md5("caption").alias("response_md5"), "caption")
    again = rows.where("p % 10 = 0").select("idx", (F.col("p") + 1_000_000_000).alias("p"), F.md5(F.concat("caption", F.lit(" again"))).alias("response_md5"))
    return generate.last_by_key(rows.drop("caption").unionByName(again), "idx", "p").select("idx", "response_md5")


# --- conversation and text ---------------------------------------------------------------------


@query("SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, text AS response FROM conversations WHERE turn = 0")
def response_field(spark, sf):
    s = F.col("supervisions")[0]
    return v.cuts_nested(spark, sf).select("id", chat.response_of(s["custom"], s["text"]).alias("response"))


@query("SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, turn, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 2 = 1 THEN reverse(text) ELSE text END AS response FROM conversations")
def response_field_all(spark, sf):
    rows = v.cuts_nested(spark, sf).select("id", F.posexplode("supervisions").alias("turn", "s"))
    return rows.select("id", F.col("turn").cast("long").alias("turn"), chat.response_of(F.col("s.custom"), F.col("s.text")).alias("response"))


@query(f"SELECT doc_id, {sql_normalize('text')} AS norm FROM documents")
def normalize_response(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))


_SYSTEM, _ASK = "You transcribe speech.", "Please transcribe."
_BUILT = f"""(CASE WHEN doc_id % 2 = 0 THEN {sql_turn("'system'", f"'{_SYSTEM}'")} ELSE '' END) || {sql_turn("'user'", f"'{tx.AUDIO}' || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE '{_ASK}' END)")} || {sql_turn("'assistant'", sql_normalize("text"))}"""


def _built(spark, sf):
    """Cuts with rendered conversations: a system prompt on even ids, an instruction on most."""
    d = F.col("doc_id")
    conv = chat.build_conversation(F.col("source"), tx.normalize_text(F.col("text")), F.when(d % 3 == 0, F.lit("")).otherwise(F.lit(_ASK)), F.when(d % 2 == 0, F.lit(_SYSTEM)))
    return v.cuts(spark, sf).select("id", "duration", chat.render(conv).alias("rendered"))


@query(with_views("cuts", body=f"SELECT id, {_BUILT} AS rendered FROM cuts"))
def build_conversation(spark, sf):
    return _built(spark, sf).select("id", "rendered")


@query(with_views("qa_pairs", body=f"""SELECT id, {sql_turn("'system'", f"'{chat.QA_SYSTEM}'")} || {sql_turn("'user'", f"'{tx.AUDIO}' || question")} || {sql_turn("'assistant'", sql_strip("answer"))} AS rendered FROM qa_pairs"""))
def build_qa_conversation(spark, sf):
    conv = chat.build_qa_conversation(F.col("id"), F.col("question"), F.col("answer"))
    return v.qa_pairs(spark, sf).select("id", chat.render(conv).alias("rendered"))


@query(with_views("rendered", body="SELECT conv_id, rendered FROM rendered"))
def render_conversation(spark, sf):
    return v.rendered(spark, sf)


@query(f"SELECT conv_id, turn, (CASE WHEN role = 'user' THEN '{tx.AUDIO} ' ELSE '' END) || text AS content FROM conversations")
def normalize_conversation_parts(spark, sf):
    rows = v.table(spark, sf, "conversations")
    parts = F.when(F.col("role") == "user", F.array(chat.audio_part(F.lit("a.wav")), chat.text_part(F.col("text")))).otherwise(F.array(chat.text_part(F.col("text"))))
    conv = F.array(F.struct(F.col("role").alias("role"), parts.alias("parts")))
    return rows.select("conv_id", "turn", chat.normalize_parts(conv)[0]["content"].alias("content"))


def _sql_truncated(limit: int) -> str:
    t = sql_tokens("caption")
    return f"(CASE WHEN len({t}) > {limit} THEN array_to_string(({t})[1:{limit}], ' ') ELSE caption END)"


@query(with_views("captions", body=f"""SELECT idx, {sql_turn("'system'", f"'{chat.GENERATION_SYSTEM}'")} || {sql_turn("'user'", _sql_truncated(7500))} || '{tx.BEGIN}assistant' || chr(10) AS prompt FROM captions"""))
def generation_prompt(spark, sf):
    return v.captions(spark, sf).select("idx", chat.generation_prompt(tx.truncate_tokens(F.col("caption"), 7500)).alias("prompt"))


_HEAD = f"('{tx.BEGIN}assistant' || chr(10))"


@query(
    with_views(
        "rendered",
        body=f"SELECT conv_id, CASE WHEN contains(rendered, {_HEAD}) THEN left(rendered, length(rendered) - strpos(reverse(rendered), reverse({_HEAD})) + 1) ELSE rendered || {_HEAD} END AS prompt FROM rendered",
    )
)
def strip_last_assistant(spark, sf):
    return v.rendered(spark, sf).select("conv_id", chat.strip_last_assistant(F.col("rendered")).alias("prompt"))


@query(with_views("rendered", body=f"SELECT conv_id, {_long('len(' + sql_tokens(sql_strip('rendered')) + ')')} AS num_text_tokens FROM rendered"))
def text_token_count(spark, sf):
    return v.rendered(spark, sf).select("conv_id", tx.token_count(F.col("rendered")).alias("num_text_tokens"))


_N_TOKENS = f"len({sql_tokens('caption')})"


@query(with_views("captions", body=f"SELECT idx, {_long(_N_TOKENS)} AS n_before, {_long(f'least({_N_TOKENS}, {CAPTION_LIMIT})')} AS n_after FROM captions"))
def truncate_prompt(spark, sf):
    cut = tx.truncate_tokens(F.col("caption"), CAPTION_LIMIT)
    count = lambda c: F.regexp_count(c, F.lit(tx.TOKEN)).cast("long")
    return v.captions(spark, sf).select("idx", count(F.col("caption")).alias("n_before"), count(cut).alias("n_after"))


@query(with_views("cuts", body=f"SELECT id, md5(rendered) AS rendered_md5, {_long('len(' + sql_tokens(sql_strip('rendered')) + ')')} AS num_text_tokens FROM (SELECT id, {_BUILT} AS rendered FROM cuts)"))
def prepare_manifest(spark, sf):
    return _built(spark, sf).select("id", F.md5("rendered").alias("rendered_md5"), tx.token_count(F.col("rendered")).alias("num_text_tokens"))


_TOKENS_SQL = f"CAST(round_even(CAST(duration * {RATE} AS DOUBLE), 0) AS BIGINT) + CAST(len({sql_tokens(sql_strip('text'))}) AS BIGINT)"


def _sized(spark, sf):
    return guards.filter_duration(v.cuts(spark, sf)).select("id", "doc_id", "duration", (lengths.estimated_audio_tokens(F.col("duration"), RATE) + tx.token_count(F.col("text"))).alias("num_tokens"))


@query(with_views("cuts", body=f"SELECT id, {_TOKENS_SQL} AS num_tokens FROM cuts"))
def estimate_cut_tokens(spark, sf):
    n = lengths.estimated_audio_tokens(F.col("duration"), RATE) + tx.token_count(F.col("text"))
    return v.cuts(spark, sf).select("id", n.alias("num_tokens"))


_HALF = "(({} - 1) >> 1) + 1"
_W = _HALF.format("mel_frames")
_Q25 = f"((({_W}) - 2) >> 1) + 1"
_Q3 = f"({_HALF.format('(' + _HALF.format('(' + _HALF.format('(mel_frames % 100)') + ')') + ')')} + (mel_frames // 100) * 13)"


@query(with_views("cuts", body=f"SELECT id, {_long(_W)} AS n FROM cuts"))
def encoder_len_whisper(spark, sf):
    return v.cuts(spark, sf).select("id", lengths.whisper(F.col("mel_frames")).cast("long").alias("n"))


@query(with_views("cuts", body=f"SELECT id, {_long(_Q25)} AS n FROM cuts"))
def encoder_len_q25(spark, sf):
    return v.cuts(spark, sf).select("id", lengths.audio_v25(F.col("mel_frames")).cast("long").alias("n"))


@query(with_views("cuts", body=f"SELECT id, {_long(_Q3)} AS n FROM cuts"))
def encoder_len_q3(spark, sf):
    return v.cuts(spark, sf).select("id", lengths.audio_v3(F.col("mel_frames")).cast("long").alias("n"))


_ENCODERS = [(e, ds) for e in lengths.ENCODERS for ds in (2, 4, 5)]


@query(
    with_views(
        "cuts",
        body=f"SELECT id, encoder, {_long('ds')} AS ds, {_long(f'(CASE encoder WHEN {chr(39)}whisper{chr(39)} THEN {_W} WHEN {chr(39)}qwen2_5_omni_audio_encoder{chr(39)} THEN {_Q25} ELSE {_Q3} END) // ds')} AS n FROM cuts CROSS JOIN (VALUES {', '.join(f'({chr(39)}{e}{chr(39)}, {d})' for e, d in _ENCODERS)}) e(encoder, ds)",
    )
)
def audio_token_length(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("encoder"), F.lit(d).cast("long").alias("ds")) for e, d in _ENCODERS]))
    rows = v.cuts(spark, sf).select("id", "mel_frames", each.alias("e")).select("id", "mel_frames", "e.encoder", "e.ds")
    return rows.select("id", "encoder", "ds", lengths.audio_tokens_by_name(F.col("mel_frames"), F.col("encoder"), F.col("ds")).alias("n"))


@query(with_views("qa_results", body=f"SELECT id, CASE WHEN length(hyp) > 200 THEN hyp || '{tx.TRUNCATED}' ELSE hyp END AS text FROM qa_results"))
def mark_truncated(spark, sf):
    reason = F.when(F.char_length("hyp") > 200, F.lit("length")).otherwise(F.lit("stop"))
    return v.qa_results(spark, sf).select("id", tx.mark_truncated(F.col("hyp"), reason).alias("text"))


_ANSWERS = [("x1", "Train."), ("x2", "Train . ."), ("x3", "..."), ("x4", " A\t b "), ("x5", ""), ("x6", " NBSP  x 　"), ("x7", "train.\n")]


def _sql_str(s: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")" if s else "''"


@query(with_views("qa_results", body=f"SELECT id, {sql_answer('s')} AS norm FROM (SELECT id, hyp AS s FROM qa_results UNION ALL SELECT * FROM (VALUES {', '.join(f'({chr(39)}{i}{chr(39)}, {_sql_str(s)})' for i, s in _ANSWERS)}) e(id, s))"))
def normalize_answer(spark, sf):
    rows = v.qa_results(spark, sf).select("id", F.col("hyp").alias("s")).unionByName(spark.createDataFrame(_ANSWERS, "id string, s string"))
    return rows.select("id", tx.normalize_answer(F.col("s")).alias("norm"))


_SCRIPTS = [
    ("vi", "Ti\u1ebfng Vi\u1ec7t (bỏ) r\u1ea5t \u0110\u1eb9p!"),
    ("el", "\u039a\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1, \u1fbc\u03b4\u03b7\u03c2"),
    ("nfd", "e\u0301lan vital, na\u0308ive [x]"),
    ("ru", "\u0401\u043b\u043a\u0430 \u0439 \u0456\u0457"),
    ("ko", "\ud55c\uad6d\uc5b4 - \ub9d0"),
    ("hi", "\u0939\u093f\u0928\u094d\u0926\u0940"),
    ("cjk", "\u6771\u4eac\u3002\u304c\u30d1"),
    ("ascii", "  Plain, (gone) TEXT-1 "),
]


@query(f"SELECT id, {sql_normalize('s')} AS norm FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text AS s FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({chr(39)}{i}{chr(39)}, {_sql_str(s)})' for i, s in _SCRIPTS)}) e(id, s))")
def normalize_scripts(spark, sf):
    rows = v.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("s")).unionByName(spark.createDataFrame(_SCRIPTS, "id string, s string"))
    return rows.select("id", tx.normalize_text(F.col("s")).alias("norm"))


_KEY_SQL = "SELECT doc_id // 4 AS g, CASE WHEN doc_id % 11 = 0 THEN 'module.' ELSE '' END || lang || '.module.' || CAST(doc_id AS VARCHAR) AS key FROM documents"


@query(f"SELECT g, CASE WHEN bool_or(starts_with(key, 'module.')) OVER (PARTITION BY g) THEN substr(key, 8) ELSE key END AS key FROM ({_KEY_SQL})")
def strip_key_prefix(spark, sf):
    """Keys named after documents, four a group; every eleventh has the prefix."""
    key = F.concat(F.when(F.col("doc_id") % 11 == 0, "module.").otherwise(""), "lang", F.lit(".module."), F.col("doc_id").cast("string"))
    rows = v.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("g"), key.alias("key"))
    return checkpoints.strip_key_prefix(rows, "g", "key")


@query(
    """WITH named AS (SELECT doc_id, unnest([lang, source, source, 'n' || CAST(n_chars % 3 AS VARCHAR), lang, 'n' || CAST(n_chars % 2 AS VARCHAR)]) AS key, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i FROM documents)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS INTEGER) AS place, key FROM named GROUP BY doc_id, key"""
)
def ordered_distinct(spark, sf):
    """Three lists of names a document, joined in order of first appearance."""
    n = lambda k: F.concat(F.lit("n"), (F.col("n_chars") % k).cast("string"))
    lists = [F.array("lang", "source"), F.array(F.col("source"), n(3)), F.array(F.col("lang"), n(2))]
    return v.table(spark, sf, "documents").select("doc_id", F.posexplode(checkpoints.ordered_distinct(*lists)).alias("place", "key"))


# --- filters and matching ----------------------------------------------------------------------


@query(with_views("cuts", body="SELECT id, duration FROM cuts WHERE duration BETWEEN 0.5 AND 30.0"))
def filter_duration(spark, sf):
    return guards.filter_duration(v.cuts(spark, sf)).select("id", "duration")


@query(with_views("captions", body=f"SELECT CASE WHEN length(caption) >= 20 THEN 'kept' ELSE 'rejected' END AS status, {_long('count(*)')} AS n FROM captions GROUP BY 1"))
def drop_failed(spark, sf):
    kept, rejected = guards.split_failed(v.captions(spark, sf), F.char_length("caption") < 20)
    count = lambda df, s: df.groupBy(F.lit(s).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return count(kept, "kept").unionByName(count(rejected, "rejected"))


@query(f"SELECT CASE WHEN quality IS NOT NULL THEN 'ok' ELSE 'missing' END AS status, {_long('count(*)')} AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def guard_required(spark, sf):
    rows = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy(F.when(guards.has_required("quality"), "ok").otherwise("missing").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_MATCH = f"({sql_answer('ref')} <> '' AND contains({sql_answer('hyp')}, {sql_answer('ref')}))"


@query(with_views("qa_results", body=f"SELECT id, {_MATCH} AS matched FROM qa_results"))
def qa_match(spark, sf):
    return v.qa_results(spark, sf).select("id", tx.tolerant_match(F.col("hyp"), F.col("ref")).alias("matched"))


@query(
    with_views(
        "qa_results",
        body=f"SELECT s.test_set, {_long('coalesce(correct, 0)')} AS correct, {_long('coalesce(total, 0)')} AS total, round(CASE WHEN total > 0 THEN {_double('correct')} / total * 100 ELSE CAST(0 AS DOUBLE) END, 6) AS accuracy FROM (VALUES ('set0'), ('set1'), ('set2'), ('empty')) s(test_set) LEFT JOIN (SELECT test_set, count(*) FILTER (WHERE {_MATCH}) AS correct, count(*) AS total FROM qa_results GROUP BY test_set) r ON r.test_set = s.test_set",
    )
)
def qa_accuracy(spark, sf):
    sets = spark.createDataFrame([("set0",), ("set1",), ("set2",), ("empty",)], "test_set string")
    return mt.qa_accuracy(v.qa_results(spark, sf), sets).withColumn("accuracy", F.round("accuracy", 6))


@query(with_views("qa_results", body=f"SELECT id || ' | ' || {sql_strip('hyp')} || ' | ' || {sql_strip('ref')} AS line FROM qa_results"))
def qa_result_lines(spark, sf):
    return manifests.result_lines(v.qa_results(spark, sf).withColumnRenamed("id", "cut_id"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contains(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc"))
    return guards.contains_any(docs, v.table(spark, sf, "benchmark"), "doc", "text", "doc_id").select("doc_id", "item_id")


# --- alignment ---------------------------------------------------------------------------------


def _lens(spark, sf):
    """Lengths for placeholders: those of every other cut, in id order."""
    rows = ordering.position(v.cuts(spark, sf), "p", None, ["doc_id"])
    return rows.where("p % 2 = 0").select((F.col("p") / 2).cast("long").alias("ordinal"), (lengths.audio_v3(F.col("mel_frames")) % 5).cast("long").alias("n"))


_PH = f"'{tx.AUDIO}'"


@query(
    with_views(
        "cuts",
        "rendered_audio",
        more=f"""lens AS (SELECT CAST(p // 2 AS BIGINT) AS ordinal, n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, ({_Q3}) % 5 AS n FROM cuts) WHERE p % 2 = 0),
        pieces AS (SELECT conv_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS i, unnest(t) AS part, first FROM (SELECT conv_id, string_split(rendered, {_PH}) AS t, coalesce(sum(len(string_split(rendered, {_PH})) - 1) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM rendered_audio))""",
        body=f"SELECT conv_id AS id, md5(string_agg((CASE WHEN i = 0 THEN '' ELSE repeat({_PH}, CAST(greatest(coalesce(n, 1), 1) AS BIGINT)) END) || part, '' ORDER BY i)) AS expanded_md5 FROM pieces LEFT JOIN lens ON i > 0 AND ordinal = first + i - 1 GROUP BY conv_id",
    )
)
def expand_placeholders(spark, sf):
    rows = align.expand_placeholders(v.rendered_audio(spark, sf), _lens(spark, sf), "conv_id", "rendered")
    return rows.select(F.col("conv_id").alias("id"), F.md5("expanded").alias("expanded_md5"))


@query(
    with_views(
        "audio_tokens",
        body=f"SELECT seq_id, pos, CASE WHEN mark AND k < 1 + seq_id % 3 THEN 'audio:' || CAST(k AS VARCHAR) ELSE 'text' END AS source FROM (SELECT *, token = {_PH} AS mark, CAST(sum(CASE WHEN token = {_PH} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS BIGINT) AS k FROM audio_tokens)",
    )
)
def merge_audio_positions(spark, sf):
    tokens = v.tokens(spark, sf, audio=True)
    audio = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("seq_id")).distinct()
    audio = audio.select("seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq_id") % 3)).alias("k")).withColumn("value", F.concat(F.lit("audio:"), F.col("k").cast("string")))
    return align.merge_audio(tokens, audio, "seq_id").select("seq_id", "pos", F.coalesce("value", F.lit("text")).alias("source"))


@query(with_views("tokens", body=f"SELECT seq_id, {_long('count(*) * (count(*) + 1) // 2')} AS allowed_pairs FROM tokens GROUP BY seq_id"))
def causal_mask_pairs(spark, sf):
    return align.causal_pairs(v.tokens(spark, sf), "seq_id")


_AHEAD = f"min(CASE WHEN token = '{tx.END}' THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(with_views("tokens", body=f"SELECT seq_id, pos, {_AHEAD} AS end_pos FROM tokens"))
def next_end_marker(spark, sf):
    rows = v.tokens(spark, sf)
    return rows.select("seq_id", "pos", align.next_marker(F.col("token") == tx.END, "seq_id").alias("end_pos"))


_LABELS = f"""spans AS (SELECT seq_id, pos + 2 AS first, coalesce(e, last) AS final FROM (SELECT *, {_AHEAD} AS e, max(pos) OVER (PARTITION BY seq_id) AS last, lead(token) OVER (PARTITION BY seq_id ORDER BY pos) AS following FROM tokens) WHERE token = '{tx.BEGIN}' AND following = 'assistant')"""


@query(with_views("token_ids", more=_LABELS, body="SELECT t.seq_id, t.pos, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.seq_id = t.seq_id AND t.pos BETWEEN s.first AND s.final) THEN t.token_id ELSE CAST(-100 AS BIGINT) END AS label FROM token_ids t"))
def label_spans(spark, sf):
    rows = align.label_spans(v.token_ids(spark, sf), "seq_id", tx.BEGIN, tx.END, ["assistant"])
    return rows.select("seq_id", "pos", F.when(F.col("labelled"), F.col("token_id")).otherwise(F.lit(-100).cast("long")).alias("label"))


# --- metrics -----------------------------------------------------------------------------------


@query(
    with_views(
        "token_ids",
        more=_LABELS
        + """, lab AS (SELECT t.seq_id, t.pos, t.token_id, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.seq_id = t.seq_id AND t.pos BETWEEN s.first AND s.final) THEN t.token_id ELSE CAST(-100 AS BIGINT) END AS label FROM token_ids t),
        nxt AS (SELECT seq_id, pos, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS n, lead(token_id) OVER (PARTITION BY seq_id ORDER BY pos) AS t FROM lab),
        hit AS (SELECT seq_id, n, CASE WHEN left(md5(CAST(seq_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR)), 1) < 'c' THEN t ELSE 0 END AS p FROM nxt)""",
        body=f"SELECT seq_id, correct, total, round(CASE WHEN total > 0 THEN {_double('correct')} / total ELSE CAST(0 AS DOUBLE) END, 6) AS acc FROM (SELECT seq_id, {_long('count(*) FILTER (WHERE n <> -100 AND p = n)')} AS correct, {_long('count(*) FILTER (WHERE n <> -100)')} AS total FROM hit GROUP BY seq_id)",
    )
)
def token_accuracy(spark, sf):
    from pyspark.sql import Window

    rows = align.label_spans(v.token_ids(spark, sf), "seq_id", tx.BEGIN, tx.END, ["assistant"])
    following = F.lead("token_id").over(Window.partitionBy("seq_id").orderBy("pos"))
    right = F.left(F.md5(F.concat_ws("-", F.col("seq_id").cast("string"), F.col("pos").cast("string"))), F.lit(1)) < "c"
    rows = rows.select("seq_id", "pos", F.when(F.col("labelled"), F.col("token_id")).otherwise(F.lit(-100).cast("long")).alias("label"), F.when(right, following).otherwise(F.lit(0)).alias("predicted"))
    return mt.token_accuracy(rows, "seq_id", "pos", "predicted", "label").withColumn("acc", F.round("acc", 6))


def _sequence_lengths(spark, sf):
    n = v.tokens(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("len"))
    return ordering.position(n, "p", None, ["seq_id"]).withColumn("batch_id", batching.fixed_batches(F.col("p"), BATCH))


_LENS_SQL = f"sized AS (SELECT seq_id, len, {_long(f'(row_number() OVER (ORDER BY seq_id) - 1) // {BATCH}')} AS batch_id FROM (SELECT seq_id, {_long('count(*)')} AS len FROM tokens GROUP BY seq_id))"


@query(with_views("tokens", more=_LENS_SQL, body=f"SELECT batch_id, {_long('count(*)')} AS samples, {_long('sum(len)')} AS tokens, {_long('max(len)')} AS max_len FROM sized GROUP BY batch_id"))
def batch_token_stats(spark, sf):
    return _sequence_lengths(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("len").alias("tokens"), F.max("len").alias("max_len"))


@query(with_views("tokens", more=_LENS_SQL, body=f"SELECT batch_id, {_long('count(*) * max(len)')} AS padded, {_long('count(*) * max(len) - sum(len)')} AS wasted FROM sized GROUP BY batch_id"))
def padding_waste(spark, sf):
    n = F.count(F.lit(1)) * F.max("len")
    return _sequence_lengths(spark, sf).groupBy("batch_id").agg(n.alias("padded"), (n - F.sum("len")).alias("wasted"))


@query(with_views("metrics", body=f"SELECT name, round({_double('sum(value * samples)')} / sum(samples), 6) AS value FROM metrics GROUP BY name"))
def weighted_metrics(spark, sf):
    return mt.weighted_metrics(v.metrics(spark, sf), "name", "value", "samples").withColumn("value", F.round("value", 6))


@query(
    """SELECT split_part(name, '.', 1) AS module, CAST(sum(p_size) AS BIGINT) AS total, CAST(coalesce(sum(p_size) FILTER (free AND NOT (name = 'Brand#11' OR starts_with(name, 'Brand#11.') OR name = 'Brand#12.n1' OR starts_with(name, 'Brand#12.n1.'))), 0) AS BIGINT) AS trainable
    FROM (SELECT p_brand || '.n' || CAST(p_partkey % 13 AS VARCHAR) || '.weight' AS name, p_size, p_partkey % 5 <> 0 AS free FROM part) GROUP BY 1"""
)
def param_summary(spark, sf):
    """Parts as parameters: a module a brand; one brand and a part of another are frozen."""
    name = F.concat("p_brand", F.lit(".n"), (F.col("p_partkey") % 13).cast("string"), F.lit(".weight"))
    rows = v.table(spark, sf, "part").select(name.alias("name"), F.col("p_size").cast("long").alias("numel"), (F.col("p_partkey") % 5 != 0).alias("requires_grad"))
    return mt.param_summary(rows, ["Brand#11", "Brand#12.n1"])


_EMA = """kept AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY step) AS i FROM metrics WHERE step % 100 = 0 AND step > 0),
fold AS (SELECT name, i, value AS ema FROM kept WHERE i = 1 UNION ALL SELECT k.name, k.i, 0.9999::DOUBLE * f.ema + (1 - 0.9999::DOUBLE) * k.value FROM fold f JOIN kept k ON k.name = f.name AND k.i = f.i + 1)"""


@query(with_views("metrics", more=_EMA, recursive=True, body="SELECT name, round(arg_max(ema, i), 6) AS ema FROM fold GROUP BY name"))
def ema(spark, sf):
    return mt.ema(v.metrics(spark, sf), "name", "step", "value").withColumn("ema", F.round("ema", 6))


@query(with_views("metrics", body=f"SELECT name, {_long('p // 4')} AS \"window\", round(sum(value) / 4, 6) AS loss FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY step) - 1 AS p FROM metrics) GROUP BY 1, 2"))
def accum_windows(spark, sf):
    return mt.accumulation_windows(v.metrics(spark, sf), "name", "step", "value", 4).withColumn("loss", F.round("loss", 6))


@query(with_views("captions", body=f"SELECT {_long(f'count(*) // {BATCH} + 1')} AS n FROM captions"))
def estimated_batches(spark, sf):
    return mt.estimated_batches(v.captions(spark, sf), BATCH)


@query(with_views("metrics", body="SELECT name, round(sqrt(sum(c * c)), 6) AS norm FROM (SELECT name, value * least(1.0, 1.0 / (sqrt(sum(value * value) OVER (PARTITION BY name)) + 1e-6)) AS c FROM metrics) GROUP BY name"))
def clip_norm(spark, sf):
    rows = mt.clip_norm(v.metrics(spark, sf), "name", "value")
    return rows.groupBy("name").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"))


# --- packing, padding, frames ------------------------------------------------------------------


@query(
    with_views(
        "tokens",
        body=f"SELECT seq_id, pos, {_long('row_number() OVER (ORDER BY seq_id, pos) - 1')} AS packed_pos, {_long('row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1')} AS position_id FROM tokens WHERE pos % 7 <> 3",
    )
)
def pack_sequences(spark, sf):
    return align.pack(v.tokens(spark, sf), F.col("pos") % 7 != 3, "seq_id").select("seq_id", "pos", F.col("packed_pos").cast("long").alias("packed_pos"), "position_id")


def _check(c: str):
    """Order-free exact checksum of a float array."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.rint(x.cast("double") * 1000).cast("long"))


_CHECK = "CAST(list_sum(list_transform(vec, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 1000, 0) AS BIGINT))) AS BIGINT)"
_FLEN = "n - seq_id % 4 * 3"


@query(
    with_views(
        "frames",
        more=f"l AS (SELECT seq_id, {_FLEN} AS len FROM (SELECT seq_id, count(*) AS n FROM frames GROUP BY seq_id))",
        body=f"SELECT f.seq_id, f.t, {_long('t + coalesce((SELECT sum(len) FROM l o WHERE o.seq_id < f.seq_id), 0)')} AS packed, {_CHECK} AS checksum FROM frames f JOIN l USING (seq_id) WHERE t < len",
    )
)
def pack_features(spark, sf):
    rows = v.frames(spark, sf)
    lens = rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).withColumn("len", F.expr(_FLEN))
    offsets = ordering.running(lens, "first", None, ["seq_id"], value=F.col("len"), inclusive=False)
    kept = rows.join(offsets, "seq_id").where("t < len")
    return kept.select("seq_id", "t", (F.col("t") + F.col("first")).cast("long").alias("packed"), _check("vec").alias("checksum"))


@query(
    with_views(
        "frames",
        more=f"l AS (SELECT seq_id, {_FLEN} AS len FROM (SELECT seq_id, count(*) AS n FROM frames GROUP BY seq_id)), w AS (SELECT seq_id, len, CAST(unnest(range(0, (SELECT max(len) FROM l))) AS BIGINT) AS t FROM l)",
        body=f"SELECT w.seq_id, w.t, CASE WHEN w.t < w.len THEN {_CHECK} ELSE CAST(0 AS BIGINT) END AS checksum FROM w LEFT JOIN frames f ON f.seq_id = w.seq_id AND f.t = w.t",
    )
)
def pad_features(spark, sf):
    rows = v.frames(spark, sf)
    lens = rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).withColumn("len", F.expr(_FLEN))
    widest = lens.agg(F.max("len").alias("width"))
    grid = lens.join(F.broadcast(widest), F.lit(True)).select("seq_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("t"))  # widest: one row
    out = grid.join(rows, ["seq_id", "t"], "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    return out.withColumn("vec", F.when(F.col("t") < F.col("len"), F.col("vec")).otherwise(zero)).select("seq_id", "t", _check("vec").alias("checksum"))


@query(
    with_views(
        "frames",
        body=f"SELECT seq_id, t4 AS t, {_long('sum(c)')} AS checksum, {_long('sum(d)')} AS dim FROM (SELECT seq_id, {_long('t // 4')} AS t4, {_CHECK} AS c, len(vec) AS d FROM frames) GROUP BY seq_id, t4 HAVING count(*) = 4",
    )
)
def concat_frames(spark, sf):
    return align.concat_frames(v.frames(spark, sf), 4).select("seq_id", "t", _check("vec").alias("checksum"), F.size("vec").cast("long").alias("dim"))


@query(with_views("tokens", more=_LENS_SQL, body=f"SELECT seq_id, {_long('max(len) OVER (PARTITION BY batch_id) - len')} AS n_pad FROM sized"))
def pad_tokens(spark, sf):
    rows = _sequence_lengths(spark, sf)
    width = rows.groupBy("batch_id").agg(F.max("len").alias("width"))
    rows = rows.join(width, "batch_id")
    ids = F.array_repeat(F.lit(1), F.col("len").cast("int"))
    padded = align.pad(ids, F.col("width"), F.lit(0), left=True)
    return rows.select("seq_id", F.size(F.filter(padded, lambda x: x == 0)).cast("long").alias("n_pad"))


# --- ordering, mixing, batching ----------------------------------------------------------------


@query(with_views("cuts", body=f"SELECT {_long('doc_id // 16')} AS batch_id, id, {_long('row_number() OVER (PARTITION BY doc_id // 16 ORDER BY duration DESC, id)')} AS rank FROM cuts"))
def batch_order(spark, sf):
    rows = v.cuts(spark, sf).withColumn("batch_id", batching.fixed_batches(F.col("doc_id"), 16))
    return batching.batch_order(rows, "batch_id", "id").select("batch_id", "id", "rank")


@query(with_views("cuts", body=f"SELECT id, CAST(row_number() OVER (ORDER BY md5('7|' || id), id) - 1 AS BIGINT) AS rank FROM cuts"))
def seeded_shuffle(spark, sf):
    return batching.seeded_shuffle(v.cuts(spark, sf).select("id"), 7, "id").select("id", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS run, event_id AS step FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def checkpoint_retention(spark, sf):
    """The last two events of every user."""
    rows = v.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"))
    return checkpoints.keep_last(rows, "run", "step", 2)


@query(
    """WITH named AS (SELECT event_id AS n, user_id % 7 AS epoch, CASE WHEN event_id % 4 = 2 THEN user_id ELSE 0 END AS iter, CASE event_id % 4 WHEN 0 THEN event_type || '.v' || CAST(user_id AS VARCHAR) || '.pt' WHEN 1 THEN '/abs/' || event_type WHEN 2 THEN '' END AS filename FROM events)
    SELECT n, CASE WHEN starts_with(filename, '/') THEN filename WHEN filename <> '' THEN '/exp/' || filename WHEN iter > 0 THEN '/exp/checkpoint-' || CAST(iter AS VARCHAR) || '.pt' ELSE '/exp/epoch-' || CAST(epoch AS VARCHAR) || '.pt' END AS path,
    CASE WHEN starts_with(filename, '/') THEN substr(filename, 6) WHEN filename <> '' THEN left(filename, length(filename) - 3) WHEN iter > 0 THEN 'iter-' || CAST(iter AS VARCHAR) ELSE 'epoch-' || CAST(epoch AS VARCHAR) END AS label
    FROM named WHERE filename <> '' OR iter > 0 OR epoch > 0"""
)
def resolve_checkpoint(spark, sf):
    """Events as choices of a checkpoint by file name (absolute or not), step or epoch."""
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    name = F.when(kind == 0, F.concat("event_type", F.lit(".v"), user, F.lit(".pt"))).when(kind == 1, F.concat(F.lit("/abs/"), "event_type")).when(kind == 2, "")
    rows = v.table(spark, sf, "events").select(F.col("event_id").alias("n"), name.alias("filename"), F.when(kind == 2, F.col("user_id")).otherwise(0).alias("iter"), (F.col("user_id") % 7).alias("epoch"))
    rows = rows.where("coalesce(filename, '') <> '' OR iter > 0 OR epoch > 0")
    return checkpoints.resolve(rows, "/exp").select("n", "path", "label")


@query(
    f"SELECT doc_id, {_long('row_number() OVER (ORDER BY due, source, doc_id) - 1')} AS rank FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5::DOUBLE) / (1 + length(source) - length(replace(source, '1', ''))) AS due FROM documents)"
)
def weighted_mux(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id", "source").withColumn("w", (1 + F.char_length("source") - F.char_length(F.replace("source", F.lit("1"), F.lit("")))).cast("double"))
    return batching.weighted_mux(rows, "source", "w", "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, text FROM conversations")
def flatten_supervisions(spark, sf):
    return v.cuts_nested(spark, sf).select("id", F.explode("supervisions").alias("s")).select("id", F.col("s.text").alias("text"))


def _indexed(spark, sf):
    return ordering.position(v.captions(spark, sf).select("idx", "doc_id"), "p", None, ["doc_id"])


@query(f"SELECT {_long('p // 32')} AS batch_id, {_long('count(*)')} AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) GROUP BY 1")
def fixed_batches(spark, sf):
    return _indexed(spark, sf).groupBy(batching.fixed_batches(F.col("p"), 32).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_long('p // 200')} AS outer_id, {_long('(p % 200) // 32')} AS batch_id, {_long('count(*)')} AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) GROUP BY 1, 2")
def micro_batches(spark, sf):
    outer, inner = batching.micro_batches(F.col("p"), 200, 32)
    return _indexed(spark, sf).groupBy(outer.alias("outer_id"), inner.alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))


def _fold_sql(value: str, limit: str, total: str) -> str:
    return with_views(
        "cuts",
        recursive=True,
        more=f"""sized AS (SELECT id, duration, {_TOKENS_SQL} AS num_tokens FROM cuts WHERE duration BETWEEN 0.5 AND 30.0),
        tiled AS (SELECT id, {value} AS val, ntile(10) OVER (ORDER BY duration, id) AS bucket FROM sized),
        placed AS (SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY md5('11|' || id), id) - 1) // 4096 AS run, val, (row_number() OVER (PARTITION BY bucket ORDER BY md5('11|' || id), id) - 1) % 4096 AS o FROM tiled),
        fold AS (SELECT bucket, run, o, CAST(0 AS BIGINT) AS batch_id, val AS total, val FROM placed WHERE o = 0 UNION ALL SELECT p.bucket, p.run, p.o, CASE WHEN f.total + p.val <= {limit} THEN f.batch_id ELSE f.batch_id + 1 END, CASE WHEN f.total + p.val <= {limit} THEN f.total + p.val ELSE p.val END, p.val FROM fold f JOIN placed p ON p.bucket = f.bucket AND p.run = f.run AND p.o = f.o + 1)""",
        body="SELECT CAST(bucket AS BIGINT) AS bucket, CAST(run AS BIGINT) AS run, batch_id, CAST(count(*) AS BIGINT) AS n, " + total + " AS total FROM fold GROUP BY 1, 2, 3",
    )


@query(_fold_sql("num_tokens", "1500", "CAST(sum(val) AS BIGINT)"))
def token_batches(spark, sf):
    rows = batching.bounded_batches(_sized(spark, sf), "id", "duration", "num_tokens", 1500, 10, 11)
    return rows.groupBy("bucket", "run", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("num_tokens").alias("total"))


@query(_fold_sql("CAST(round_even(duration * 100, 0) AS BIGINT)", "6000", "round(CAST(sum(val) AS DOUBLE) / 100, 2)"))
def duration_batches(spark, sf):
    """Durations in hundredths of a second, so that sums are exact."""
    cut = _sized(spark, sf).withColumn("centi", F.rint(F.col("duration") * 100).cast("long"))
    rows = batching.bounded_batches(cut, "id", "duration", "centi", 6000, 10, 11)
    return rows.groupBy("bucket", "run", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("centi") / 100, 2).alias("total"))


@query(f"SELECT CAST(e AS BIGINT) AS epoch, {_long('count(*)')} AS n FROM documents CROSS JOIN (VALUES (0), (1), (2)) t(e) GROUP BY 1")
def epoch_repeat(spark, sf):
    return batching.repeat_epochs(v.cuts(spark, sf).select("id"), 3).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


_TRIGGERS = {"log": 50, "reset": 200, "validate": 1000, "average": 100}


@query(with_views("metrics", body=" UNION ALL ".join(f"SELECT '{k}' AS trigger_name, {_long('count(*)')} AS n FROM metrics WHERE step % {p} = 0" for k, p in _TRIGGERS.items())))
def trigger_steps(spark, sf):
    due = F.array(*[F.struct(F.lit(k).alias("name"), (F.col("step") % p == 0).alias("due")) for k, p in _TRIGGERS.items()])
    rows = v.metrics(spark, sf).select(F.explode(due).alias("d"))
    return rows.groupBy(F.col("d.name").alias("trigger_name")).agg(F.sum(F.col("d.due").cast("long")).alias("n"))


@query()
def generate_stub(spark, sf):
    rows = v.captions(spark, sf).select("idx", chat.generation_prompt(tx.truncate_tokens(F.col("caption"), 7500)).alias("prompt"))
    out = generate.generate(rows, "prompt", generate.echo(64))
    return out.select("idx", tx.mark_truncated(F.col("response"), F.col("finish_reason")).alias("response"))


@query(
    "SELECT vec_id, CAST(r AS BIGINT) AS rank, CAST(i AS BIGINT) AS place FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE r <= 20"
)
def top_k_scores(spark, sf):
    rows = v.table(spark, sf, "embeddings").select("vec_id", F.posexplode(hooks.top_k(F.col("embedding"), 20)).alias("r", "p"))
    return rows.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("p.place").alias("place"))


_CHANCES = """scored AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r, max(x) OVER (PARTITION BY vec_id) AS top FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
weighed AS (SELECT *, exp((x - top) / 0.6::DOUBLE) AS w FROM scored WHERE r <= 20),
walked AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY vec_id) AS total FROM weighed)"""


@query(f"WITH {_CHANCES} SELECT vec_id, {_long('r')} AS rank, {_long('i')} AS place FROM walked WHERE r = 1 OR before < 0.9::DOUBLE * total")
def top_p_scores(spark, sf):
    rows = v.table(spark, sf, "embeddings").select("vec_id", F.posexplode(hooks.top_p(F.col("embedding"), 0.9, 0.6, 20)).alias("r", "p"))
    return rows.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("p.place").alias("place"))


@query("SELECT doc_id, unnest(['source', 'lang', 'n_chars']) AS key, unnest([source, upper(lang), CAST(n_chars AS VARCHAR)]) AS value FROM documents")
def merge_fields(spark, sf):
    """Fields of the text with those of its inputs, which win."""
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    more = F.create_map(F.lit("lang"), F.upper("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return v.table(spark, sf, "documents").select("doc_id", F.explode(hooks.merge(own, more)).alias("key", "value"))


@query("SELECT DISTINCT source, lang, 'qa_results-' || source || CASE lang WHEN 'en' THEN '' WHEN 'de' THEN '' ELSE '-' || lang END || '.txt' AS name FROM documents")
def result_names(spark, sf):
    """A result file a source and language; two languages have no suffix (one empty, one null)."""
    rows = v.table(spark, sf, "documents").select("source", "lang").distinct()
    suffix = F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", F.col("lang"))
    return rows.withColumn("name", hooks.result_name(F.col("source"), suffix))


@query(f"SELECT doc_id, lang || CASE WHEN n_chars % 3 = 0 THEN ',{tx.AUDIO},' ELSE ',' END || source || CASE WHEN n_chars % 3 = 0 THEN '' ELSE ',{tx.AUDIO}' END AS tokens FROM documents")
def special_tokens(spark, sf):
    """The placeholder among a document's tokens, in its place where it is there already."""
    own = F.when(F.col("n_chars") % 3 == 0, F.array(F.col("lang"), F.lit(tx.AUDIO), F.col("source"))).otherwise(F.array("lang", "source"))
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(hooks.register_token(own, tx.AUDIO), ",").alias("tokens"))


@query("SELECT vec_id, CAST((i - 1) % 16 AS INTEGER) AS channel, CAST((i - 1) // 16 AS INTEGER) AS t, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def transposed_frames(spark, sf):
    """Vectors as four frames of sixteen channels, turned to channels of frames, value by value."""
    frames = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    rows = v.table(spark, sf, "embeddings").select("vec_id", F.posexplode(align.transpose(frames)).alias("channel", "c"))
    return rows.select("vec_id", "channel", F.posexplode("c").alias("t", "x"))


# --- whole paths -------------------------------------------------------------------------------


_PREPARED = f"""{sql_turn("'system'", f"'{_SYSTEM}'")} || {sql_turn("'user'", f"'{tx.AUDIO}{_ASK}'")} || {sql_turn("'assistant'", sql_normalize("text"))}"""


@query(
    f"SELECT id, 'a.wav' AS source, md5(r) AS rendered_md5, {_long('len(' + sql_tokens(sql_strip('r')) + ')')} AS num_text_tokens FROM (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, {_PREPARED} AS r FROM conversations WHERE turn = 0)"
)
def prepare_manifest_files(spark, sf):
    """Cuts written as a manifest, read, prepared, written and read again."""
    sources = F.array(F.struct(F.lit("a.wav").alias("source")))
    none = F.lit(None).cast("map<string,string>").alias("custom")
    cuts = v.cuts_nested(spark, sf).select("id", F.lit(1.0).alias("duration"), F.struct(sources.alias("sources")).alias("recording"), "supervisions", none)
    raw = scratch.path(spark, "cuts")
    manifests.write_manifest(cuts, raw)
    done = paths.prepare_manifest(spark, raw, scratch.path(spark, "prepared"), _ASK, _SYSTEM)
    source = F.col("conversation")[1]["parts"][0]["audio"].alias("source")
    return done.select("id", source, F.md5("rendered_conversation").alias("rendered_md5"), "num_text_tokens")


_CLIPS = "clips AS (SELECT p AS ordinal, mel_frames AS frames FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, mel_frames FROM cuts) WHERE p % 2 = 0)"


@query(
    with_views(
        "cuts",
        "rendered_audio",
        more=f"""{_CLIPS}, lens AS (SELECT ordinal, ({_Q3.replace('mel_frames', 'frames')}) // 4 AS n FROM clips),
        pieces AS (SELECT conv_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS i, unnest(t) AS part, first FROM (SELECT conv_id, string_split(rendered, {_PH}) AS t, coalesce(sum(len(string_split(rendered, {_PH})) - 1) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM rendered_audio)),
        expanded AS (SELECT conv_id, string_agg((CASE WHEN i = 0 THEN '' ELSE repeat({_PH}, CAST(greatest(coalesce(n, 1), 1) AS BIGINT)) END) || part, '' ORDER BY i) AS r FROM pieces LEFT JOIN lens ON i > 0 AND ordinal = first + i - 1 GROUP BY conv_id),
        tokens AS (SELECT conv_id AS seq_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM (SELECT conv_id, {sql_tokens('expanded.r')} AS t FROM expanded)),
        {_LABELS}""",
        body=f"SELECT t.seq_id AS conv_id, {_long('count(*)')} AS n_tokens, {_long(f'count(*) FILTER (WHERE token = {_PH})')} AS n_audio, {_long('count(*) FILTER (WHERE EXISTS (SELECT 1 FROM spans s WHERE s.seq_id = t.seq_id AND t.pos BETWEEN s.first AND s.final))')} AS n_labelled FROM tokens t GROUP BY t.seq_id",
    )
)
def processor_batch(spark, sf):
    """Chat texts with the clips of every other placeholder, expanded, tokenized and labelled."""
    rows = ordering.position(v.cuts(spark, sf), "ordinal", None, ["doc_id"]).where("ordinal % 2 = 0")
    out = paths.process(v.rendered_audio(spark, sf), "conv_id", "rendered", features=rows.select("ordinal", F.col("mel_frames").alias("frames")), encoder="qwen3_asr_audio_encoder")
    count = lambda c: F.sum(c.cast("long"))
    return out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_tokens"), count(F.col("token") == tx.AUDIO).alias("n_audio"), count(F.col("labelled")).alias("n_labelled"))


_MIXED = "(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5::DOUBLE) / (1 + length(source) - length(replace(source, '1', '')))"


@query(
    with_views(
        "cuts",
        recursive=True,
        more=f"""mixed AS (SELECT *, CAST(row_number() OVER (ORDER BY due, source, doc_id) - 1 AS BIGINT) AS rank FROM (SELECT *, {_MIXED} AS due FROM cuts)),
        sized AS (SELECT rank, duration, {_TOKENS_SQL} AS num_tokens FROM mixed WHERE duration BETWEEN 0.5 AND 30.0),
        tiled AS (SELECT rank, num_tokens AS val, ntile(6) OVER (ORDER BY duration, rank) AS bucket FROM sized),
        placed AS (SELECT bucket, rank, val, (p // 4096) AS run, p % 4096 AS o FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('5|' || CAST(rank AS VARCHAR)), rank) - 1 AS p FROM tiled)),
        fold AS (SELECT bucket, run, o, rank, CAST(0 AS BIGINT) AS batch_id, val AS total, val FROM placed WHERE o = 0 UNION ALL SELECT p.bucket, p.run, p.o, p.rank, CASE WHEN f.total + p.val <= 4000 THEN f.batch_id ELSE f.batch_id + 1 END, CASE WHEN f.total + p.val <= 4000 THEN f.total + p.val ELSE p.val END, p.val FROM fold f JOIN placed p ON p.bucket = f.bucket AND p.run = f.run AND p.o = f.o + 1)""",
        body=f"SELECT {_long('bucket')} AS bucket, {_long('run')} AS run, batch_id, rank, val AS num_tokens FROM (SELECT *, max(batch_id) OVER (PARTITION BY bucket, run) AS last FROM fold) WHERE batch_id < last",
    )
)
def train_batches(spark, sf):
    """Sources mixed by weight, held to the duration range, batched by tokens; open batches dropped."""
    weight = (1 + F.char_length("source") - F.char_length(F.replace("source", F.lit("1"), F.lit("")))).cast("double")
    cuts = v.cuts(spark, sf).select("doc_id", "source", "duration", weight.alias("weight"), tx.token_count(F.col("text")).alias("num_text_tokens"))
    return paths.train_batches(cuts, 4000, 6, 5, rate=RATE)


@query(
    with_views(
        "qa_results",
        more=f"sets AS (SELECT * FROM (VALUES ('set0'), ('set1'), ('set2'), ('empty')) t(test_set)), scores AS (SELECT test_set, count(*) FILTER (WHERE {_MATCH}) AS correct, count(*) AS total FROM qa_results GROUP BY test_set)",
        body=f"SELECT 'qa_results-' || test_set || '-iter-9.txt' AS file, CASE WHEN id IS NULL THEN NULL ELSE id || ' | ' || {sql_strip('hyp')} || ' | ' || {sql_strip('ref')} END AS line FROM sets LEFT JOIN qa_results USING (test_set) UNION ALL SELECT 'accuracy-' || test_set || '-iter-9.txt', printf('Accuracy: %.2f%% (%d/%d)', CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / total * 100 ELSE CAST(0 AS DOUBLE) END, CAST(coalesce(correct, 0) AS BIGINT), CAST(coalesce(total, 0) AS BIGINT)) FROM sets LEFT JOIN scores USING (test_set)",
    )
)
def qa_evaluation(spark, sf):
    """Lines of the result and accuracy files of four test sets, one of them empty."""
    sets = spark.createDataFrame([("set0",), ("set1",), ("set2",), ("empty",)], "test_set string")
    return paths.evaluate(v.qa_results(spark, sf).withColumnRenamed("id", "cut_id"), sets, F.lit("iter-9")).select("file", "line")


@query(
    f"""SELECT conv_id, md5(string_agg({sql_turn('role', "(CASE WHEN role = 'user' THEN '" + tx.AUDIO + " ' ELSE '' END) || text")}, '' ORDER BY turn) || '{tx.BEGIN}assistant' || chr(10)) AS prompt_md5 FROM conversations GROUP BY conv_id"""
)
def chat_template(spark, sf):
    """Batches of one conversation each, given to the template as an array."""
    parts = F.when(F.col("role") == "user", F.array(chat.audio_part(F.lit("a.wav")), chat.text_part(F.col("text")))).otherwise(F.array(chat.text_part(F.col("text"))))
    turns = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", parts.alias("parts")).alias("t")))).alias("c"))
    batch = F.array(F.transform("c", lambda x: x["t"]))
    return turns.select("conv_id", F.md5(chat.apply_template(batch, batch=True, prompt=True)[0]).alias("prompt_md5"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'model_type', 'whisper' FROM events")
def config_defaults(spark, sf):
    given = F.from_json("props", "map<string,string>")
    return v.table(spark, sf, "events").select("event_id", F.explode(hooks.resolve_config(given, "whisper")).alias("key", "value"))


@query("SELECT CAST(b AS BIGINT) AS batch_id, CAST(max(n) AS BIGINT) AS cuts FROM (SELECT doc_id // 16 AS b, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE b % 50 = 0 GROUP BY b")
def progress_counts(spark, sf):
    rows = v.cuts(spark, sf).withColumn("batch_id", batching.fixed_batches(F.col("doc_id"), 16))
    return mt.progress(rows, "batch_id").select("batch_id", F.col("cuts").cast("long").alias("cuts"))
