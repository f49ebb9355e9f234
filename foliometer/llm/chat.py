"""Chat formatting from event logs.

A log holds events of messages: deltas that append text, edits that replace it, and
regenerations that start it anew. Messages are folded from their events in sequence,
conversations are rendered with a template, and the rendered text can be read back.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, without_clashes

# Characters of one delta when stored turns are replayed as a log.
DELTA = 256
# Characters from which a segment of rendered text is closed.
SEGMENT = 1_000_000
# The template: ``<turn ROLE>`` + text + ``</turn>`` + line end. Inside roles and texts the
# signs of the markers and the escape sign are written as two signs each.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"))
END = "</turn>\n"


def escape(text: str) -> str:
    for plain, written in ESCAPES:
        text = text.replace(plain, written)
    return text


def unescape(text: str) -> str:
    """Undo ``escape``: pairs are read from the left."""
    if "\\" not in text:
        return text
    back = {written[1]: plain for plain, written in ESCAPES}
    parts = iter(text)
    return "".join(back[next(parts)] if sign == "\\" else sign for sign in parts)


def as_events(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log of stored turns (conv_id, turn, role, text): a delta per ``delta`` characters.

    A null text is one empty delta. Rows equal in conversation and turn are separate
    messages, ordered by role and text; whole copies get a number.
    """
    rows = without_clashes(turns, "conv_id", "turn", "role", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    digest = F.sha2(F.to_json(F.struct("role", "text")), 256)
    message = F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("")), digest, "copy")
    parts = F.greatest(F.lit(1), F.ceil(F.length("text") / delta)).cast("int")
    events = rows.withColumn("message", message).select(
        "conv_id", "message", F.col("turn").cast("long").alias("seq"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        F.lit("delta").alias("kind"), "role", "text",
    )
    piece = F.substring(F.col("text"), F.col("part") * delta + 1, F.lit(delta))
    return events.withColumn("text", piece)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, seq, role, text) of a log.

    Events of a message apply in the order of (seq, part): ``delta`` appends its text,
    ``edit`` replaces all, ``regenerate`` clears all (its own text, mostly null, is the new
    beginning). The message keeps the place of its first event and its last role that is not
    null. Null texts are empty, null roles give the empty role, other kinds raise an error.
    Partitions are by conversation and message: a message is one text, while a conversation
    of any size is spread over tasks. Rows are read in order, one message at a time.
    """
    rows = events.select("conv_id", "message", "seq", "part", "kind", "role", "text")
    ordered = rows.repartition("conv_id", "message").sortWithinPartitions(
        "conv_id", "message", "seq", "part"
    )
    key_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key_type}, message string, seq long, role string, text string"

    def run(batches):
        current, texts, role, first = None, [], "", None
        out: list[tuple] = []
        size = 0
        kinds = None

        def flush():
            columns = zip(*out, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "message", "seq", "role", "text"])

        for batch in batches:
            kinds = [batch.column(0).type, pa.string(), pa.int64(), pa.string(), pa.string()]
            for conv, message, seq, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, message) != current:
                    if current is not None:
                        out.append((*current, first, role, "".join(texts)))
                        size += len(out[-1][4])
                        if size > SEGMENT:
                            yield flush()
                            out, size = [], 0
                    current, texts, role, first = (conv, message), [], "", seq
                if kind not in ("delta", "edit", "regenerate"):
                    raise ValueError(f"unknown kind of event: {kind}")
                if kind != "delta":
                    texts = []
                texts.append(text or "")
                role = role if who is None else who
        if current is not None:
            out.append((*current, first, role, "".join(texts)))
            yield flush()

    return ordered.mapInArrow(run, schema)


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered conversations as segments, each of whole turns.

    Returns (conv_id, segment, text, n_turns, loss_spans): the rendered text of a
    conversation is that of its segments in order. ``loss_spans`` holds (start, end) of the
    texts of ``trained`` roles, in code points of the segment. Turns are sorted over the
    whole table by (conv_id, seq, role, text), so a hot conversation spans many tasks;
    a segment ends with its conversation, its task, or about SEGMENT characters.
    """
    sort = ["conv_id", "seq", "role", "text", "message"]
    ordered = messages.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = ordered.withColumn("segment", F.monotonically_increasing_id())
    key_type = messages.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {key_type}, segment long, text string, n_turns long, "
        "loss_spans array<struct<start:long,end:long>>"
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        conv, segment, parts, spans, size = None, None, [], [], 0

        def flush():
            row = [conv, segment, "".join(parts), len(parts), spans]
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), span]
            arrays = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "segment", "text", "n_turns", "loss_spans"])

        for batch in batches:
            key_type = batch.column(0).type
            for new, role, text, number in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "segment")), strict=True):
                if parts and (new != conv or size >= SEGMENT):
                    yield flush()
                    parts, spans, size = [], [], 0
                if not parts:
                    conv, segment = new, number
                head, body = f"<turn {escape(role)}>", escape(text)
                if role in trained:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                parts.append(head + body + END)
                size += len(parts[-1])
        if parts:
            yield flush()

    return ordered.select("conv_id", "role", "text", "segment").mapInArrow(run, schema)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of rendered text."""
    turns = []
    for block in text.split(END)[:-1]:
        role, body = block.removeprefix("<turn ").split(">", 1)
        turns.append((unescape(role), unescape(body)))
    return turns


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from a stored table of rendered segments.

    Returns (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). A
    digest of a conversation takes its text in order; it is fed segment by segment, and no
    more than one segment is in memory. Only parsed segments, not whole conversations, are
    compared with each other.
    """
    key_type = segments.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {key_type}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def run(batches):
        rows, conv, state = [], None, None
        kinds = None

        def close():
            turns, loss, n_turns, loss_chars, chars = state
            rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for new, _, text, _, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or new != conv:
                    if state is not None:
                        close()
                    conv, state = new, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, body in parse_turns(text):
                    state[0].update(f"{role}\n{body}\n".encode())
                    state[2] += 1
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    state[1].update(body.encode())
                    state[3] += len(body)
                state[4] += len(text)
        if state is not None:
            close()
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [field.split(" ")[0] for field in schema.split(", ")])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.select("conv_id", "segment", "text", "n_turns", "loss_spans").mapInArrow(run, schema)


def format_chats(turns: DataFrame) -> DataFrame:
    """Replay turns as a log, fold, render, store, and read the stored output back."""
    return read_back(stored(render(fold(as_events(turns))), "chats"))
