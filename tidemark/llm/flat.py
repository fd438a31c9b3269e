"""Whole-batch text handling: one flat byte buffer, numpy offsets, no per-row Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one Python step holds at a time; a longer single text is a step of its own.
CHUNK_BYTES = 16 << 20


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def byte_slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that no piece holds more text than ``most``, single rows aside."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins small batches and cuts large ones, so that each step has about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in byte_slices(batch, text, most):
            own = pc.sum(pc.binary_length(piece.column(text))).as_py() or 0
            if held and size + own > most:
                yield one_batch(held)
                held, size = [], 0
            held.append(piece)
            size += own
    if held:
        yield one_batch(held)


def one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all rows, n + 1 row offsets into them, and the distinct words; words are runs without white space."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(column)), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text is split to one empty word
        keep = np.ones(len(codes), bool)
        keep[offsets[:-1][empty & (np.diff(offsets) > 0)]] = False
        offsets = np.concatenate(([0], np.cumsum(np.diff(offsets) - (empty & (np.diff(offsets) > 0)))))
        codes = codes[keep]
    return codes, offsets, coded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def gathered_ranges(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """source[ranges(starts, lengths)] with index arrays of about ``most`` elements at a time."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, source.dtype)
    at = 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        out[done : int(ends[stop - 1])] = source[ranges(starts[at:stop], lengths[at:stop])]
        at = stop
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; the array is sorted in place."""
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, by the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
