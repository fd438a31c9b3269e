"""Directly addressable codes for token ids.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one; a bitmap
says which entries of a level go on, and a rank directory (ones before every 512th bit) finds an entry's place on
the next level. Any token is read by at most one chunk and one rank a level; nothing is decoded in blocks.

Layout, little endian: version u8, chunk bits u8, levels u8, zero u8; entries of each level u32; then for each level
its chunks and, but for the last, its bitmap (lowest bit first) and its rank directory u32.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, encoded, vocabulary

BITS, BLOCK = 8, 512


def dac_batch(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The code of each list of ids; ``at`` has the lists' n + 1 offsets."""
    if len(tokens) and int(tokens.min()) < 0:
        raise ValueError("token ids can't be negative")
    parts: list[list[bytes]] = [[] for _ in range(len(at) - 1)]
    sizes: list[list[int]] = [[] for _ in range(len(at) - 1)]
    rest, bounds = tokens.astype(np.uint32), at.astype(np.int64)
    level = 0
    while level == 0 or len(rest):
        chunk = (rest & 0xFF).astype(np.uint8)
        rest = rest >> BITS
        more = rest > 0
        ones = np.concatenate(([0], np.cumsum(more)))
        ends = bounds.tolist()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            if b == a and level:
                continue
            sizes[k].append(b - a)
            own = parts[k]
            own.append(chunk[a:b].tobytes())
            if ones[b] > ones[a]:
                own.append(np.packbits(more[a:b], bitorder="little").tobytes())
                own.append((ones[a:b:BLOCK] - ones[a]).astype("<u4").tobytes())
        bounds = ones[bounds]
        rest = rest[more]
        level += 1
    return [struct.pack(f"<4B{len(s)}I", 1, BITS, len(s), 0, *s) + b"".join(p) for s, p in zip(sizes, parts)]


def dac_encode(ids) -> bytes:
    ids = np.asarray(ids, np.int64)
    if len(ids) and int(ids.max()) >= 1 << 31:
        raise ValueError("token ids have 31 bits at most")
    return dac_batch(ids, np.array([0, len(ids)]))[0]


def _levels(code: bytes) -> list[tuple[int, int, int, int]]:
    """Entries, and places of chunks, bitmap and directory, for each level."""
    if len(code) < 4 or code[0] != 1 or code[1] != BITS:
        raise ValueError("no token code")
    n = code[2]
    sizes = struct.unpack_from(f"<{n}I", code, 4)
    place, out = 4 + 4 * n, []
    for k, size in enumerate(sizes):
        bitmap = place + size
        ranks = bitmap + (size + 7) // 8
        out.append((size, place, bitmap, ranks))
        place = bitmap if k == n - 1 else ranks + 4 * -(-size // BLOCK)
    return out


def dac_length(code: bytes) -> int:
    return struct.unpack_from("<I", code, 4)[0]


def dac_get(code: bytes, i: int) -> int:
    """Token ``i``; negative places count from the end."""
    levels = _levels(code)
    n = levels[0][0]
    i = i + n if i < 0 else i
    if not 0 <= i < n:
        raise IndexError(i)
    value = 0
    for k, (_, place, bitmap, ranks) in enumerate(levels):
        value |= code[place + i] << BITS * k
        if k == len(levels) - 1 or not code[bitmap + (i >> 3)] >> (i & 7) & 1:
            break
        block = i // BLOCK
        from_bit = block * BLOCK
        bits = int.from_bytes(code[bitmap + from_bit // 8 : bitmap + (i >> 3) + 1], "little") & (1 << i - from_bit) - 1
        i = struct.unpack_from("<I", code, ranks + 4 * block)[0] + bits.bit_count()
    return value


def dac_decode(code: bytes) -> np.ndarray:
    levels = _levels(code)
    out = np.zeros(levels[0][0], np.int64)
    where = np.arange(levels[0][0])
    for k, (size, place, bitmap, _) in enumerate(levels):
        out[where] |= np.frombuffer(code, np.uint8, size, place).astype(np.int64) << BITS * k
        if k < len(levels) - 1:
            where = where[np.unpackbits(np.frombuffer(code, np.uint8, (size + 7) // 8, bitmap), bitorder="little")[:size] > 0]
    return out


def token_codes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k.json", rows: int = 4000, most_sent: int = 1 << 20) -> DataFrame:
    """Every text's token ids in directly addressable form: (doc_id, n_tokens, codes).

    A null text has null tokens and codes; an empty one has 0 tokens and a code without entries; texts of any length are
    whole. Rows come out one for one, repeated ones too, null ids kept; an empty table gives no rows; other columns of
    the input are not read, whatever their names. ``most_sent`` is as in bpe_encode.
    """

    def made(ids: pa.Array, missing: np.ndarray, tokens: np.ndarray, at: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = dac_batch(tokens, at)
        for a in range(0, len(ids), rows):
            b = min(a + rows, len(ids))
            own = pa.array([None if m else c for m, c in zip(missing[a:b], codes[a:b])], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(at[a : b + 1]), pa.int32(), mask=missing[a:b]), own], names=["doc_id", "n_tokens", "codes"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encoded(own, vocabulary(tokenizers, name), most_sent, made, f"doc_id {own.schema[0].dataType.simpleString()}, n_tokens int, codes binary")
