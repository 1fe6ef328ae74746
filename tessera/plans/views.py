"""Canonical inputs of the operators, derived from the synthetic tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chat, ordering

#: Most tokens of a vocabulary that is broadcast, and parts of a token's rows beyond it.
VOCABULARY, DEALS = 500_000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("caption"), "lang", "source", "doc_id")


def cuts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), (F.col("n_chars") / 100.0).alias("duration"), F.col("n_chars").alias("mel_frames"), "doc_id", "source", "text")


def cuts_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A cut per conversation, a supervision per turn; ``answer`` is there on odd turns, null on every other."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))

    def supervision(t):
        text = t["text"]
        answer = F.when(t["turn"] % 4 == 3, F.lit(None).cast("string")).otherwise(F.reverse(text))
        custom = F.when(t["turn"] % 2 == 1, F.create_map(F.lit("answer"), answer)).otherwise(F.create_map(F.lit("role"), t["role"]))
        return F.struct(text.alias("text"), custom.alias("custom"))

    return turns.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("id"), F.transform("t", supervision).alias("supervisions"))


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn with the user turn right before it."""
    conv = table(spark, sf, "conversations")
    user = conv.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    answer = conv.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return answer.join(user, ["conv_id", "turn"]).select(F.format_string("%08d-%04d", "conv_id", "turn").alias("id"), "conv_id", "turn", "question", "answer")


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("t"))
    return turns.select("conv_id", chat.render_turns(F.col("t")).alias("rendered"))


def rendered_audio(spark: SparkSession, sf: str) -> DataFrame:
    """The same with an audio placeholder at the start of each user turn."""
    text = F.when(F.col("role") == "user", F.concat(F.lit(tx.AUDIO), F.col("text"))).otherwise(F.col("text"))
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", text.alias("text"))).alias("t"))
    return turns.select("conv_id", chat.render_turns(F.col("t")).alias("rendered"))


def tokens(spark: SparkSession, sf: str, audio: bool = False) -> DataFrame:
    source = rendered_audio(spark, sf) if audio else rendered(spark, sf)
    rows = source.select(F.col("conv_id").alias("seq_id"), F.posexplode(tx.tokens(F.col("rendered"))).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with their rank among all distinct tokens, from 1.

    A vocabulary of up to ``VOCABULARY`` tokens is ranked by the driver and broadcast; a larger one
    meets tokens dealt by position too, as markers are very frequent.
    """
    rows = tokens(spark, sf)
    words = rows.select("token").distinct()
    found = words.orderBy("token").limit(VOCABULARY + 1).toPandas()
    if len(found) <= VOCABULARY:
        return rows.join(F.broadcast(spark.createDataFrame(found.assign(token_id=range(1, len(found) + 1)), "token string, token_id long")), "token")
    vocabulary = ordering.running(words, "token_id", None, ["token"])
    vocabulary = vocabulary.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<bigint>")))
    return rows.withColumn("_deal", F.col("pos") % DEALS).join(vocabulary, ["token", "_deal"]).drop("_deal")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("seq_id"), "vec_id", F.col("embedding").alias("vec"))
    rows = ordering.position(rows, "t", None, ["vec_id"], within=["seq_id"])
    return rows.select("seq_id", F.col("t").cast("long").alias("t"), "vec")


def qa_results(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant text as answer, the first word of the user's text as reference; three test sets."""
    rows = qa_pairs(spark, sf)
    return rows.select("id", F.concat(F.lit("set"), (F.col("conv_id") % 3).cast("string")).alias("test_set"), F.col("answer").alias("hyp"), F.regexp_extract("question", r"^[^ \t-\r]+", 0).alias("ref"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("name"), "value", (1 + F.col("user_id") % 8).cast("long").alias("samples"))
    rows = ordering.running(rows, "step", None, ["ts", "event_id"])
    return rows.select("event_id", F.col("step").cast("long").alias("step"), "name", "value", "samples")


#: White space of Python in the SQL dialect, and the tokenizer's pattern.
SQL_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_PUNCTUATION = r"[!-/:-@\[-\x60{-~]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_answer(c: str) -> str:
    low = f"regexp_replace(lower({sql_strip(c)}), '{SQL_PUNCTUATION}+$', '')"
    return sql_strip(f"regexp_replace({low}, '{SQL_SPACE}+', ' ', 'g')")


def sql_normalize(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace({c}, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g')"
    return rf"trim(regexp_replace(lower(strip_accents({bare})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{tx.TOKEN}')"


def sql_turn(role: str, text: str) -> str:
    return f"('{tx.BEGIN}' || {role} || chr(10) || {text} || '{tx.END}' || chr(10))"


SQL: dict[str, str] = {
    "captions": "SELECT CAST(doc_id AS VARCHAR) AS idx, text AS caption, lang, source, doc_id FROM documents",
    "cuts": "SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, CAST(n_chars AS DOUBLE) / 100.0 AS duration, n_chars AS mel_frames, doc_id, source, text FROM documents",
    "qa_pairs": "SELECT printf('%08d-%04d', a.conv_id, a.turn) AS id, a.conv_id, a.turn, u.text AS question, a.text AS answer FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user'",
    "rendered": f"SELECT conv_id, string_agg({sql_turn('role', 'text')}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id",
    "rendered_audio": f"""SELECT conv_id, string_agg({sql_turn("role", f"(CASE WHEN role = 'user' THEN '{tx.AUDIO}' ELSE '' END) || text")}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""",
    "tokens": f"SELECT conv_id AS seq_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM (SELECT conv_id, {sql_tokens('rendered')} AS t FROM rendered)",
    "audio_tokens": f"SELECT conv_id AS seq_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM (SELECT conv_id, {sql_tokens('rendered_audio.rendered')} AS t FROM rendered_audio)",
    "token_ids": "SELECT seq_id, pos, token, CAST(dense_rank() OVER (ORDER BY token) AS BIGINT) AS token_id FROM tokens",
    "frames": "SELECT CAST(label AS BIGINT) AS seq_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS t, embedding AS vec FROM embeddings",
    "qa_results": "SELECT id, 'set' || CAST(conv_id % 3 AS VARCHAR) AS test_set, answer AS hyp, regexp_extract(question, '^[^ \\t-\\r]+') AS ref FROM qa_pairs",
    "metrics": "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS step, event_type AS name, value, CAST(1 + user_id % 8 AS BIGINT) AS samples FROM events",
}
_NEEDS = {"tokens": ["rendered"], "audio_tokens": ["rendered_audio"], "token_ids": ["rendered", "tokens"], "qa_results": ["qa_pairs"]}


def with_views(*names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """SQL that defines the named views (and those they need) before ``body``."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + ([more] if more else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " " if parts else "") + body
