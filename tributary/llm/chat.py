"""Chat formatting with a grammar round trip.

A conversation is its turns one after another, and the grammar is

    conversation = turn*
    turn         = "### " name ": " body "\\n</turn>\\n"

where a body holds no unescaped control string: ``</turn>`` or a turn's beginning. A control string is escaped by one more
backslash before the backslashes that stand in front of it (none at first), and unescaped by one less. Every turn is rendered as it
is, parsed again, and compared with its source; one that does not come back (it holds a control string, escaped or not) is rendered
with its conflicting content escaped, which must come back identical. Turns are self-delimiting, so a conversation comes
back if its turns do. Known roles have names of their own, every other role is percent-encoded after ``=``, a null role is ``-``.

Rows are dealt out by ranges of (conversation, turn), so one conversation with most of the rows is formatted by many tasks; the
output is pieces of about PIECE_CHARS of whole turns. Reading back parses each piece in its own task. A conversation inside one piece
is digested there; only those that cross a task's range or a piece send their bytes on, and are hashed
piece by piece in order, which sequential digests need, without holding a conversation.

Null texts count as empty. Turns follow by number, null first; rows of one number by role and text checksum, repeated rows all stay. Null
conversation ids are one conversation. No rows give no rows. Other columns stay behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import pieces

PIECE_CHARS = 1_000_000
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {name: role for role, name in NAMES.items()}
BEGIN, END = r"### [\w.~%=-]+: ", "</turn>"
HEADER = re.compile(r"### ([\w.~%=-]+): ", re.ASCII)
#: A control string with all backslashes in front of it, and one that is escaped.
CONTROL = re.compile(rf"(?<!\\)\\*+(?:{END}|{BEGIN})", re.ASCII)
ESCAPED = re.compile(rf"(?<!\\)\\(\\*+(?:{END}|{BEGIN}))", re.ASCII)


def name_of(role: str | None) -> str:
    return "-" if role is None else NAMES.get(role) or "=" + quote(role, safe="")


def role_of(name: str) -> str | None:
    return None if name == "-" else ROLES.get(name) or unquote(name[1:])


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(body: str) -> str:
    return ESCAPED.sub(r"\1", body)


def render(role: str | None, body: str) -> str:
    return f"### {name_of(role)}: {body}\n{END}\n"


def parse(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(role, begin of the body, its end) of each turn; ValueError where the text is not of the grammar."""
    at = 0
    while at < len(text):
        head = HEADER.match(text, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        mark = next((m for m in CONTROL.finditer(text, head.end()) if m[0][0] != "\\"), None)
        if not mark or mark[0] != END or mark.start() == head.end() or text[mark.start() - 1] + text[mark.end() : mark.end() + 1] != "\n\n":
            raise ValueError(f"the turn at {at} does not end")
        yield role_of(head[1]), head.end(), mark.start() - 1
        at = mark.end() + 1


def turns_of(text: str) -> list[tuple[str | None, str]]:
    return [(role, unescaped(text[a:b])) for role, a, b in parse(text)]


def comes_back(turn: str, role: str | None, text: str) -> bool:
    try:
        return turns_of(turn) == [(role, text)]
    except ValueError:
        return False


def turn_text(role: str | None, text: str) -> str:
    """The turn, escaped only if its plain form does not come back."""
    turn = render(role, text)
    if not comes_back(turn, role, text):
        turn = render(role, escaped(text))
        if not comes_back(turn, role, text):
            raise ValueError("a turn does not come back")
    return turn


PIECE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
     ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
PIECE_DDL = "conv_id long, part long, whole boolean, text string, loss array<struct<start: long, end: long>>"


def formatted(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), piece_chars: int = PIECE_CHARS,
              conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces of formatted conversations: conv_id, part (ascending within a conversation), whole (the piece is its whole
    conversation for sure), text, and loss: the spans of code points of the bodies of ``loss_roles`` in the piece."""
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        held: list[str] = []
        loss: list[dict] = []
        size = done = 0
        conv, first, cut = None, True, False  # the open conversation, whether it is the task's first one, whether it was cut

        def close(last: bool, goes_on: bool = False) -> None:
            nonlocal part, held, loss, size, done, cut
            if held:
                out.append((conv, part, not (first or last or cut or goes_on), "".join(held), loss))
                part, done = part + 1, done + size
            held, loss, size, cut = [], [], 0, goes_on

        def rows_out() -> pa.RecordBatch:
            nonlocal out, done
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)
            out, done = [], 0
            return made

        begun = False
        for batch in batches:
            for this, who, what in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and this != conv:
                    close(False)
                    first = False
                conv, begun = this, True
                made = turn_text(who, what or "")
                if who in loss_roles:
                    loss.append({"start": size + made.index(": ") + 2, "end": size + len(made) - len(f"\n{END}\n")})
                held.append(made)
                size += len(made)
                if size >= piece_chars:
                    close(False, True)
                if done >= piece_chars and out:
                    yield rows_out()
        close(True)
        if out:
            yield rows_out()

    return dealt.mapInArrow(run, PIECE_DDL)


def read_back(formatted_pieces: DataFrame) -> DataFrame:
    """One row per conversation, all from the formatted text and its mask: conv_id, n_turns, turns_sha256 (role, LF, text, LF of each
    turn; a null role is empty), loss_chars and loss_sha256 (the unescaped text under the mask), formatted_chars."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64()),
         ("turns", pa.binary()), ("loss", pa.binary()), ("turns_sha256", pa.string()), ("loss_sha256", pa.string())]
    )

    def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for conv, part, whole, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                found = turns_of(text)
                turns = "".join(f"{r or ''}\n{t}\n" for r, t in found).encode()
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in mask)
                bytes_of = loss.encode()
                ends = [None, None, hashlib.sha256(turns).hexdigest(), hashlib.sha256(bytes_of).hexdigest()] if whole else [turns, bytes_of, None, None]
                rows.append([conv, part, len(found), len(loss), len(text), *ends])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv = sums = hashes = None

        def closed(out: list) -> None:
            if hashes:
                out.append([conv, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]])

        def rows(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            out: list[list] = []
            for row in batch.to_pylist():
                if row["turns"] is None:
                    out.append([row[n] for n in names])
                    continue
                if hashes is None or row["conv_id"] != conv:
                    closed(out)
                    conv, sums, hashes = row["conv_id"], [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                for k, n in enumerate(("n_turns", "loss_chars", "formatted_chars")):
                    sums[k] += row[n]
                hashes[0].update(row["turns"])
                hashes[1].update(row["loss"])
            if out:
                yield rows(out)
        out = []
        closed(out)
        if out:
            yield rows(out)

    parsed = formatted_pieces.select("conv_id", "part", "whole", "text", "loss").mapInArrow(
        recover, "conv_id long, part long, n_turns long, loss_chars long, formatted_chars long, turns binary, loss binary, turns_sha256 string, loss_sha256 string"
    )
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
