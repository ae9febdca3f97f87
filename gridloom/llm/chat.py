"""Chat formatting: conversation logs folded into final messages and rendered with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

KINDS = ("message", "delta", "edit", "regenerate")

_ESCAPED = re.compile(r"[\\<\[]")
_PLAIN = re.compile(r"\\(.)", re.DOTALL)
#: One rendered turn: a user turn, a turn of another role, or an assistant's text up to its end.
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>(?:[^\\\[<]|\\.)*) \[/INST\]"
    r"|\[TURN (?P<role>(?:[^\\\[<\]]|\\.)*)\](?P<other>(?:[^\\\[<]|\\.)*)\[/TURN\]"
    r"|(?P<assistant>(?:[^\\\[<]|\\.)*)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    """Every backslash, ``<`` and ``[`` gets a backslash before it, so no control string stays."""
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[1], text)


def _escape_role(role: str) -> str:
    return escape(role).replace("]", "\\]")


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn, and the start and end of its loss mask in it (equal: no loss)."""
    body = escape(text or "")
    if role == "assistant":
        return f"{body}</s>", 0, len(body)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0
    return f"[TURN {_escape_role(role or '')}]{body}[/TURN]", 0, 0


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a rendered conversation."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["other"] is not None:
            yield unescape(m["role"]), unescape(m["other"])
        else:
            yield "assistant", unescape(m["assistant"])


def as_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: one ``message`` each, sequence 0 of its turn.

    Rows that share a conversation and a turn stay apart: they get sequences by role and text, and
    as each is a ``message`` it opens a message of its own.
    """
    return rows.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of an event log.

    ``events`` has conv_id, turn, seq, kind, role and text. Within a turn, by seq: ``message`` opens
    a message with its text; ``delta`` appends to the open message; ``edit`` replaces its text by its
    own; ``regenerate`` drops its text, so that later deltas start anew. The role is the last
    non-null one given. Equal seqs are ordered by kind (message, delta, edit, regenerate), role, text.

    A null text is empty, a null kind is a ``message``, a delta, edit or regeneration without a
    message opens one, repeated messages are messages of their own, an empty log has none and other
    columns are dropped. A null conv_id or turn is a value like any other and sorts first. Nothing
    collects a conversation: a turn's events are numbered by a window over that turn, and only the
    events after the last edit or regeneration of a message are joined to its text.
    """
    kind = F.coalesce("kind", F.lit("message"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    order = ["seq", "_place", "role", "text"]
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    log = events.select("conv_id", "turn", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), place.alias("_place"))
    log = log.withColumn("_n", F.row_number().over(turn))
    opened = F.sum(F.when(F.col("_place") == 1, 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    # what precedes the first message belongs to it
    log = log.withColumn("part", F.greatest(opened, F.lit(1)))
    message = Window.partitionBy("conv_id", "turn", "part")
    log = log.withColumn("_from", F.max(F.when(F.col("_place") != 2, F.col("_n"))).over(message))
    kept = F.when((F.col("_from").isNull() | (F.col("_n") >= F.col("_from"))) & (F.col("_place") != 4), F.struct("_n", "text"))
    folded = log.groupBy("conv_id", "turn", "part").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_n"))).alias("role"),
        F.sort_array(F.collect_list(kept)).alias("_texts"),
    )
    text = F.array_join(F.transform("_texts", lambda x: x["text"]), "")
    return folded.select("conv_id", "turn", "part", "role", text.alias("text"))


def render_conversations(messages: DataFrame) -> DataFrame:
    """Rendered turns (conv_id, turn, part, formatted, loss_start, loss_end).

    A conversation's training text is its turns' ``formatted`` in order, with nothing between;
    ``loss_start`` and ``loss_end`` bound the loss mask inside the turn. Turns are rendered where
    they lie, however long their conversation is.
    """
    found = messages.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [render_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "part")),
                    pa.array([t[0] for t in turns], pa.string()),
                    pa.array([t[1] for t in turns], pa.int64()),
                    pa.array([t[2] for t in turns], pa.int64()),
                ],
                names=["conv_id", "turn", "part", "formatted", "loss_start", "loss_end"],
            )

    ids = ", ".join(f"{c} {found[c].dataType.simpleString()}" for c in ("conv_id", "turn", "part"))
    return messages.select("conv_id", "turn", "part", "role", "text").mapInArrow(
        run, f"{ids}, formatted string, loss_start long, loss_end long"
    )


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        for role, text in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        learned = unescape(formatted[loss_start:loss_end])
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(rendered: DataFrame) -> DataFrame:
    """What is read back from the rendered text, one row per conversation.

    Turns are sorted inside their partition and run through the digests one after another, so a
    conversation of any length needs no more memory than its longest turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[tuple] = []
        kind, digest = None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for conversation, *turn in zip(*columns):
                if digest is None or conversation != ids[-1]:
                    if digest is not None:
                        rows.append(digest.row())
                    ids.append(conversation)
                    digest = _Digest()
                digest.add(*turn)
            if len(rows) >= 10_000:
                yield _rows(ids[: len(rows)], rows, kind)
                ids, rows = ids[len(rows) :], []
        if digest is not None:
            yield _rows(ids, [*rows, digest.row()], kind)

    kind = rendered.schema["conv_id"].dataType.simpleString()
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, {DIGEST}")


def _rows(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    n, turns, loss_chars, loss, chars = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind),
            pa.array(n, pa.int64()),
            pa.array(turns, pa.string()),
            pa.array(loss_chars, pa.int64()),
            pa.array(loss, pa.string()),
            pa.array(chars, pa.int64()),
        ],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )
