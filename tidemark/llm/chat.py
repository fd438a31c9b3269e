"""Chat formatting by columnar byte assembly.

The turns of a batch become one buffer at once: the lengths of all headers, contents and ends are known from Arrow's
offsets, their running sum says where each goes, and numpy copies the bytes there. No string is made a turn at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import flat_bytes, one_batch, ranges

HEAD, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"


def assembled(roles: pa.Array, texts: pa.Array, ends: np.ndarray) -> pa.Array:
    """One text for each conversation; ``ends`` has the conversations' first turns and, last, the number of turns."""
    role, role_at = flat_bytes(roles)
    text, text_at = flat_bytes(texts)
    n = len(role_at) - 1
    parts = [(np.frombuffer(HEAD, np.uint8), None), (role, role_at), (np.frombuffer(MIDDLE, np.uint8), None), (text, text_at), (np.frombuffer(END, np.uint8), None)]
    size = np.stack([np.full(n, len(p)) if at is None else np.diff(at) for p, at in parts], axis=1)
    places = np.concatenate(([0], np.cumsum(size)))
    start = places[:-1].reshape(n, len(parts))
    buffer = np.empty(int(places[-1]), np.uint8)
    for k, (p, at) in enumerate(parts):
        if at is None:
            buffer[start[:, k, None] + np.arange(len(p))] = p
        else:
            buffer[ranges(start[:, k], size[:, k])] = p
    turn_at = np.append(start[:, 0], places[-1]) if n else np.zeros(1, np.int64)
    offsets = np.ascontiguousarray(turn_at[ends].astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets), pa.py_buffer(buffer))


def chat_format(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One formatted text for each conversation: (conv_id, n_turns, formatted).

    A turn is ``<|im_start|>role``, a line feed, its text as it is, ``<|im_end|>`` and a line feed. Turns go by
    ``turn`` (null first), then role, then text. A null role is written as ``user``, a null text as an empty one. Rows
    without ``conv_id`` are one conversation of their own; repeated rows are repeated turns. Other columns are not
    read; an empty table gives no rows.
    """
    own = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    kind = own.schema["conv_id"].dataType.simpleString()

    def done(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        ends = np.append(first, batch.num_rows)
        whole = assembled(batch.column("role"), batch.column("text"), ends)
        return pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(first)), pa.array(np.diff(ends), pa.int32()), whole.cast(pa.string())], names=["conv_id", "n_turns", "formatted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last conversation so far
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("conv_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            same = held and held[0].column("conv_id")[0] == batch.column("conv_id")[0] or held and held[0].column("conv_id")[0].as_py() is batch.column("conv_id")[0].as_py() is None
            if held and not same:
                yield done(one_batch(held), np.zeros(1, np.int64))
                held = []
            if not len(cuts):
                held.append(batch)
                continue
            last = int(cuts[-1])
            first = np.concatenate(([0], cuts[:-1]))
            if held:
                head = one_batch([*held, batch.slice(0, int(cuts[0]))])
                yield done(head, np.zeros(1, np.int64))
                if len(first) > 1:
                    yield done(batch.slice(int(cuts[0]), last - int(cuts[0])), first[1:] - int(cuts[0]))
            else:
                yield done(batch.slice(0, last), first)
            held = [batch.slice(last)]
        if held:
            yield done(one_batch(held), np.zeros(1, np.int64))

    rows = own.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns int, formatted string")
