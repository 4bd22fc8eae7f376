"""Operator 2: chat formatting of event-sourced conversations.

A log holds events of messages: whole messages, streamed deltas, edits, regenerations and deletions. The log is
partitioned by conversation and sorted by sequence; a fold replays the events of one conversation after the other
into final messages and renders them with a template. A task holds one conversation at a time, however many it gets.

The template marks a turn as ``<s>[ROLE] role``, a line end, the text and ``</s>`` with a line end. Control strings in
texts get a backslash after their first character (and one more if they have some already), which reading removes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.shared import table

OPEN, CLOSE = "<s>[ROLE] ", "</s>\n"
# Control strings of common chat templates, escaped wherever they occur in a text.
CONTROL = ("<s>", "</s>", "[ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
DELTA_CHARS = 2000
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The formatted text, and the spans (code points, end exclusive) of the trained role's texts: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
        if role == TRAINED_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text. Texts hold no bare control string, so marks are unambiguous."""
    out = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, text = turn.removesuffix(CLOSE).partition("\n")
        out.append((_role_in(role), unescape(text)))
    return out


class Conversation:
    """Messages in order of their first event."""

    def __init__(self) -> None:
        self.messages: dict[object, tuple[str, list[str]]] = {}

    def add(self, message: object, kind: str, role: str, text: str) -> None:
        if kind == "delete":
            self.messages.pop(message, None)
        elif kind in ("message", "delta", "edit", "regenerate"):
            known = self.messages.get(message)
            if known is None:
                known = self.messages[message] = (role, [])
            if kind != "delta":
                known[1].clear()
            known[1].append(text)

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


_OUT = pa.schema([("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, key, kind = None, None, None

    def done(k: object, c: Conversation) -> pa.RecordBatch:
        messages = c.final()
        text, spans = render(messages)
        return pa.record_batch([pa.array([k], kind), *(pa.array([v], f.type) for v, f in zip((len(messages), text, spans), _OUT))], ["conv_id", *_OUT.names])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, message, what, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != key:
                if now is not None:
                    yield done(key, now)
                now, key = Conversation(), conv
            now.add(message, what, role or "", text or "")
    if now is not None:
        yield done(key, now)


def format_chats(events: DataFrame, *, conv: str = "conv_id", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """conv_id, n_turns, formatted and loss (spans of the assistant's texts) of each conversation of an event log.

    Kinds: message and edit set a message's text, delta appends to it, regenerate starts it anew with its text (often
    none), delete removes it; other kinds and null are ignored. A message has the role of its first event. Null roles
    and texts are empty; null conversations are one; events of equal order come by message, kind and text. A conversation
    whose messages are all deleted has no turns and an empty text.
    """
    kind_of = events.schema[conv].dataType.simpleString()
    rows = events.select(F.col(conv).alias("conv_id"), F.col(message).alias("message"), F.col(kind).alias("kind"), F.col(role).alias("role"), F.col(text).alias("text"), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *[f"_o{k}" for k in range(len(order))], "message", "kind", "text")
    return rows.select("conv_id", "message", "kind", "role", "text").mapInArrow(_fold, f"conv_id {kind_of}, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def as_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table of turns: assistants stream their text in deltas, others send whole messages. Rows of one
    turn are messages of their own, in order of role and text."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), 0)  # one pass over the text, however long
    pieces: Column = F.when(
        (F.col("role") == TRAINED_ROLE) & (F.col("text") != ""), F.transform(cut, lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("piece")))
    ).otherwise(F.array(F.struct(F.lit("message").alias("kind"), F.col("text").alias("piece"))))
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    return turns.select("conv_id", "seq", F.col("seq").alias("message"), "role", F.posexplode(pieces).alias("part", "p")).select("conv_id", "seq", "part", "message", F.col("p.kind").alias("kind"), "role", F.col("p.piece").alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = read_back(formatted)
            learned = [unescape(formatted[x["start"] : x["end"]]) for x in loss]
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, learned)), hashlib.sha256("".join(learned).encode()).hexdigest(), len(formatted)))
        n, turn_sha, chars, loss_sha, whole = zip(*rows) if rows else ((),) * 5
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turn_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(whole, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests, read back from the formatted text, of every conversation and of conversation -7."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    chats = format_chats(as_events(rows), order=("seq", "part"))
    return chats.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '(<)(\\*(?:s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>))|(\[)(\\*(?:ROLE\]|INST\]|/INST\]))', '\1\3\\\2\4', 'g') AS body FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[ROLE] ') + length(role) + 1 + length(body) + length('</s>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
