"""Chat formatting by columnar byte assembly.

A batch of turns is formatted at once: the lengths of headers, contents and ends give every segment's offset in one output buffer,
into which a scatter copies the bytes; the loss mask is the pairs of offsets of assistant contents. Control strings within a text are
escaped by a backslash, and so are backslashes, so that the text can be read back.

Turns are dealt by conversation and sorted within tasks, never gathered: a conversation of any length streams through as chunks of
at most about CHUNK bytes, each a row of its own.

Cases: a null text is empty; a null role is the empty role; repeated turns all stay, ordered by role and text; turns of null number come
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import ship

from .common import utf8

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = b"<|turn|>", b"<|says|>", b"<|end|>\n"
CHUNK = 4_000_000
SCHEMA = "conv_id long, chunk long, n_turns long, formatted binary, starts array<long>, stops array<long>"
ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.binary()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])


def escape(text: bytes) -> bytes:
    return text.replace(b"\\", b"\\\\").replace(b"<|", b"<\\|")


def unescape(text: bytes) -> bytes:
    """Inverse of escape: a backslash before a backslash or a bar goes."""
    return b"\\".join(part.replace(b"<\\|", b"<|") for part in text.split(b"\\\\"))


def assemble(roles: list[bytes], texts: list[bytes], trained: str = "assistant") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns, where each turn ends in it, and the start and stop of the texts under the loss mask."""
    roles, texts = [escape(r) for r in roles], [escape(t) for t in texts]
    n = len(roles)
    # five segments a turn: marks are one shared source each, roles and texts lie one after the other
    source = np.frombuffer(OPEN + MIDDLE + CLOSE + b"".join(roles) + b"".join(texts), np.uint8)
    marks = np.array([len(OPEN), len(MIDDLE), len(CLOSE)])
    mark_at = np.cumsum(marks) - marks
    role_len, text_len = np.array([len(r) for r in roles]), np.array([len(t) for t in texts])
    role_at = marks.sum() + np.cumsum(role_len) - role_len
    text_at = marks.sum() + role_len.sum() + np.cumsum(text_len) - text_len
    full = lambda x: np.full(n, x)
    length = np.stack([full(marks[0]), role_len, full(marks[1]), text_len, full(marks[2])], axis=1).ravel()
    origin = np.stack([full(mark_at[0]), role_at, full(mark_at[1]), text_at, full(mark_at[2])], axis=1).ravel()
    offset = np.cumsum(length) - length
    buffer = np.empty(int(length.sum()), np.uint8)
    buffer[:] = source[np.arange(len(buffer)) + np.repeat(origin - offset, length)]
    ends = (offset + length).reshape(n, 5)[:, 4]
    learn = np.array([r == trained.encode() for r in roles], bool)
    starts = offset.reshape(n, 5)[:, 3][learn]
    return buffer, ends, starts, starts + text_len[learn]


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, starts, stops): each conversation's formatted bytes in chunks of whole turns, with the byte ranges to learn from."""
    ship(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def chunks(batches):
        """(conv_id, number, roles, texts) of consecutive turns, cut at the end of a conversation or beyond CHUNK bytes."""
        conv, number, roles, texts, held = None, 0, [], [], 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if roles and (c != conv or held > CHUNK):
                    yield conv, number, roles, texts
                    number, roles, texts, held = number + 1 if c == conv else 0, [], [], 0
                conv = c
                roles.append(utf8(r)), texts.append(utf8(t))
                held += len(texts[-1])
        if roles:
            yield conv, number, roles, texts

    def build(lot):
        buffer, ends, starts, stops = assemble([r for x in lot for r in x[2]], [t for x in lot for t in x[3]], trained)
        turns_of = np.array([len(x[2]) for x in lot])
        stop = ends[np.cumsum(turns_of) - 1]
        begin = np.concatenate([[0], stop[:-1]])
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
        offsets = pa.array(np.concatenate([[0], np.cumsum(last - first)]), pa.int32())
        back = np.repeat(begin, last - first)
        formatted = pa.Array.from_buffers(pa.binary(), len(lot), [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(buffer)])
        columns = [pa.array([x[0] for x in lot], pa.int64()), pa.array([x[1] for x in lot], pa.int64()), pa.array(turns_of, pa.int64()), formatted]
        return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(offsets, pa.array(a - back, pa.int64())) for a in (starts, stops))], schema=ARROW)

    def run(batches):
        lot, held = [], 0
        for x in chunks(batches):
            lot.append(x)
            held += sum(map(len, x[3]))
            if held > CHUNK or len(lot) >= 5000:
                yield build(lot)
                lot, held = [], 0
        if lot:
            yield build(lot)

    return dealt.mapInArrow(run, SCHEMA)


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted bytes."""
    found = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn.removeprefix(OPEN).split(MIDDLE)
        found.append((unescape(role), unescape(text)))
    return found


def digest(chats: DataFrame, in_order: bool = False) -> DataFrame:
    """What the formatted bytes and masks say, for each conversation; chunks stream in order, so nothing is gathered.

    in_order: chats come straight from format_chats, so a conversation's chunks follow one another in a task already.
    """
    dealt = chats if in_order else chats.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, state = None, None
        out = []

        def close():
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for c, _, _, data, starts, stops in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(data):
                    state[0] += 1
                    state[1].update(role + b"\n" + text + b"\n")
                for a, b in zip(starts, stops, strict=True):
                    text = unescape(data[a:b])
                    state[2] += len(text.decode("utf-8", "surrogatepass"))
                    state[3].update(text)
                state[4] += len(data.decode("utf-8", "surrogatepass"))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=names)
                out = []
        if state is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=names)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
