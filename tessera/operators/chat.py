"""Conversations: building, rendering and cutting chat text.

A conversation is array<struct<role, parts: array<struct<type, audio, text>>>>; plain string
content is one text part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ASSISTANT_HEADER, AUDIO, BEGIN, END, py_strip

PART = "struct<type:string,audio:string,text:string>"
#: The default system prompts.
QA_SYSTEM = "You are an audio understanding assistant. Listen to the audio and answer the question concisely."
GENERATION_SYSTEM = "You are an AI assistant directly hearing this audio. Respond as if you heard it yourself."


def audio_part(source: Column) -> Column:
    return F.struct(F.lit("audio").alias("type"), source.cast("string").alias("audio"), F.lit(None).cast("string").alias("text"))


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("audio"), text.cast("string").alias("text"))


def turn(role: str | Column, *parts: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), F.array(*parts).alias("parts"))


def response_of(custom: Column, text: Column) -> Column:
    """``custom['answer']`` where the key is there, even if null; else the text."""
    return F.when(F.coalesce(F.map_contains_key(custom, F.lit("answer")), F.lit(False)), custom["answer"]).otherwise(text)


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def build_conversation(source: Column, response: Column, instruction: Column, system: Column) -> Column:
    """Optional system turn, audio (and instruction, if any) from the user, then the response."""
    asked = F.when(_present(instruction), F.array(audio_part(source), text_part(instruction))).otherwise(F.array(audio_part(source)))
    user = F.struct(F.lit("user").alias("role"), asked.alias("parts"))
    rest = F.array(user, turn("assistant", text_part(response)))
    return F.when(_present(system), F.concat(F.array(turn("system", text_part(system))), rest)).otherwise(rest)


def build_qa_conversation(source: Column, question: Column, answer: Column, system: str = QA_SYSTEM) -> Column:
    """System prompt, audio and question, then the stripped answer; a missing one of both raises."""
    need = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"{name} is missing")).cast("string"))
    return F.array(turn("system", text_part(F.lit(system))), turn("user", audio_part(source), text_part(need(question, "question"))), turn("assistant", text_part(py_strip(need(answer, "answer")))))


def _shown(part: Column, audio: str) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unknown content type "), F.coalesce(part["type"], F.lit("null")))).cast("string")
    return F.when(part["type"] == "audio", F.lit(audio)).when(part["type"] == "text", F.coalesce(part["text"], F.lit(""))).otherwise(unknown)


def content(parts: Column, separator: str, audio: str = AUDIO) -> Column:
    return F.array_join(F.transform(parts, lambda p: _shown(p, audio)), separator)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END + "\n"))


def render(conversation: Column, audio: str = AUDIO) -> Column:
    """Chat text; parts of a turn follow each other without a separator."""
    return F.array_join(F.transform(conversation, lambda t: render_turn(t["role"], content(t["parts"], "", audio))), "")


def render_turns(turns: Column) -> Column:
    """Chat text of array<struct<turn, role, text>>, in turn order."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: render_turn(t["role"], t["text"])), "")


def normalize_parts(conversation: Column, audio: str = AUDIO) -> Column:
    """Turns with string content: parts joined by single spaces."""
    return F.transform(conversation, lambda t: F.struct(t["role"].alias("role"), content(t["parts"], " ", audio).alias("content")))


def generation_prompt(text: Column, system: str = GENERATION_SYSTEM) -> Column:
    """System and user turn, and the header that asks for an answer."""
    return F.concat(render_turn(F.lit("system"), F.lit(system)), render_turn(F.lit("user"), text), F.lit(ASSISTANT_HEADER))


def strip_last_assistant(rendered: Column) -> Column:
    """Everything up to and with the last assistant header; without one, the header is appended."""
    header = F.lit(ASSISTANT_HEADER)
    tail = F.substring_index(rendered, ASSISTANT_HEADER, -1)
    return F.when(F.contains(rendered, header), F.left(rendered, F.char_length(rendered) - F.char_length(tail))).otherwise(F.concat(rendered, header))


def apply_template(conversations: Column, batch: bool, prompt: bool = False) -> Column:
    """Chat text of a conversation, or with ``batch`` an array of them; ``prompt`` asks for an answer.

    Parts are normalized first, so those of a turn are joined by single spaces.
    """
    tail = F.lit(ASSISTANT_HEADER if prompt else "")
    one = lambda c: F.concat(F.array_join(F.transform(normalize_parts(c), lambda t: render_turn(t["role"], t["content"])), ""), tail)
    return F.transform(conversations, one) if batch else one(conversations)
