"""Byte-level BPE by replaying the merge list over the corpus's distinct words.

Pre-tokens are found on the flat UTF-8 buffer with numpy and made distinct in chunks, then, by a shuffle of the chunks'
words, over the corpus. An inverted index from merge rank (token pair) to word positions gives, for each merge in rank
order, the places it applies to, and only the pairs on either side of a merged place are looked up again. Texts are
kept as codes of their chunk's words and take the words' tokens from the corpus's table; words that no other chunk has
are replayed with their chunk.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import flat_bytes, gathered, gathered_ranges
from .shared import written

#: Folder of the public tokenizers; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WIDE = 1 << 20
#: Text bytes of a chunk; distinct words of the corpus that one task replays.
REPLAY_BYTES, REPLAY_WORDS = 8 << 20, 1 << 18
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def char_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[list(_SPACES)] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    ascii_table = np.concatenate((table[:128], np.zeros(128, np.uint8)))
    classes = ascii_table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        first = padded[lead].astype(np.int64)
        extra = 1 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(extra == 1, first & 0x1F, np.where(extra == 2, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            point = np.where(extra >= k, point << 6 | padded[lead + k] & 0x3F, point)
        kind = table[np.minimum(point, 0x10FFFF)]
        classes[lead] = kind
        for k in (1, 2, 3):
            at = lead[extra >= k] + k
            inside = at < len(data)
            classes[at[inside]] = kind[extra >= k][inside]
    return classes


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of the usual byte-level pattern; none crosses a row's offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    classes = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    cut = first[:n].copy()
    cut[1:] |= classes[1:] != classes[:-1]
    cut[0] = True
    after = np.flatnonzero((classes[1:] != SPACE) & (classes[:-1] == SPACE) & ~first[1:n]) + 1
    last = after - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    cut[last] = True
    cut[after[data[last] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & cut)
    if len(quote):
        row_end = offsets[np.searchsorted(offsets, quote, side="right")]
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 2 <= row_end)
        long = ((one == 0x6C) & (two == 0x6C) | np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == 0x65)) & (quote + 3 <= row_end)
        for at, size in ((quote[short], 2), (quote[long], 3)):
            cut[at + 1] = False
            end = at + size
            cut[end[end < n]] = True
    return np.flatnonzero(cut)


@functools.cache
def alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A byte-level vocabulary with its ranked merge list, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        stand_in = alphabet()
        size = max(vocab.values()) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            if all(c in stand_in for c in token):
                self.pieces[i] = bytes(stand_in[c] for c in token)
            else:
                self.pieces[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in stand_in.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = self.left * WIDE + self.right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_at = np.concatenate(([0], np.cumsum([len(p) for p in self.pieces]))).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 where there is none."""
        code = left * WIDE + right
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, self.order[k], -1)

    def replay(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in ``data`` and n + 1 offsets into them."""
        n = len(data)
        token = self.of_byte[data]
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        ends = offsets[1:][np.diff(offsets) > 0]
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        before[:1] = -1
        at = np.flatnonzero(after >= 0)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(rank: np.ndarray, where: np.ndarray) -> None:
            known = rank >= 0
            rank, where = rank[known], where[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, where = rank[order], where[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for r, a, b in zip(rank[begin].tolist(), begin, [*begin[1:], len(rank)]):
                if r in places:
                    places[r].append(where[a:b])
                else:
                    places[r] = [where[a:b]]
                    heapq.heappush(queue, r)

        pair_of_bytes = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        note(pair_of_bytes[data[at].astype(np.int64) * 256 + data[np.minimum(at + 1, n - 1)]], at)
        while queue:
            r = heapq.heappop(queue)
            held = places.pop(r)
            where = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            a, b, c = int(self.left[r]), int(self.right[r]), int(self.made[r])
            follow = after[where]
            live = (token[where] == a) & (follow >= 0) & (token[follow] == b)
            where, follow = where[live], follow[live]
            if a == b and len(where) > 1:  # overlapping places: every other one of a run, from its left
                head = np.concatenate(([True], where[1:] != follow[:-1]))
                k = np.arange(len(where))
                even = (k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0
                where, follow = where[even], follow[even]
            if not len(where):
                continue
            token[where] = c
            token[follow] = -1
            beyond = after[follow]
            after[where] = beyond
            has = beyond >= 0
            before[beyond[has]] = where[has]
            ahead = before[where]
            front = ahead >= 0
            left_at, right_at = ahead[front], where[has]
            starts = np.concatenate((left_at, right_at))
            note(self.ranks(token[starts], token[after[starts]]), starts)
        live = token >= 0
        count = np.concatenate(([0], np.cumsum(live)))
        return token[live].astype(np.int32), count[offsets]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts in ``data`` and n + 1 offsets into them."""
        starts = pre_tokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids, at = self.replay(*flat_bytes(coded.dictionary))
        size = np.diff(at)
        per_word = size[code]
        tokens = gathered_ranges(ids, at[code], per_word)
        total = np.concatenate(([0], np.cumsum(per_word)))
        return tokens, total[np.searchsorted(starts, offsets)]

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inverse of encode: bytes and their offsets."""
        size = self.piece_at[tokens + 1] - self.piece_at[tokens] if len(tokens) else np.zeros(0, np.int64)
        data = gathered_ranges(self.piece_bytes, self.piece_at[tokens], size) if len(tokens) else np.zeros(0, np.uint8)
        return data, np.concatenate(([0], np.cumsum(size)))[offsets]


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def vocabulary(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> str:
    return f"{tokenizers.rstrip('/')}/{name}"


class Tokens:
    """Tokens of the corpus's frequent words, replayed once: sorted hashes, and each word's tokens."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, size: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, at = hashes[order], np.concatenate(([0], np.cumsum(size)))[:-1]
        self.at, self.size, self.tokens = at[order], size[order], tokens

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where there is none. A word of equal hash may be another one."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        k = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[k] == own, k, -1)


def coded(docs: DataFrame, most: int = REPLAY_BYTES) -> DataFrame:
    """Chunks of about ``most`` bytes of text as word codes, a row each: (ids, counts, codes, words, ends).

    ``counts`` has each text's number of words, -1 for null, ``codes`` the words of all texts as places in ``words``,
    the bytes of the chunk's distinct words with their ``ends``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=most):
            data, offsets = flat_bytes(batch.column("text"))
            starts = pre_tokens(data, offsets)
            bounds = np.append(starts, len(data)).astype(np.int64)
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            made = column.dictionary_encode()
            codes = made.indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
            words, at = flat_bytes(made.dictionary)
            counts = np.where(batch.column("text").is_null().to_numpy(zero_copy_only=False), -1, np.diff(np.searchsorted(starts, offsets))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (counts, codes, words, at[1:].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([ids, *blobs], names=["ids", "counts", "codes", "words", "ends"])

    return docs.mapInArrow(run, f"ids array<{kind}>, counts binary, codes binary, words binary, ends binary")


def _words(batch: pa.RecordBatch, k: int) -> pa.Array:
    ends = np.frombuffer(batch.column("ends")[k].as_buffer(), np.int32)
    bounds = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), batch.column("words")[k].as_buffer()])


def corpus_tokens(chunks: DataFrame, path: str, most_sent: int) -> Tokens:
    """Tokens of the words that more than one chunk has, from a replay over all of them.

    Words are made distinct over the corpus by a shuffle of chunks' distinct words. If there are more than
    ``most_sent`` words, those of fewer chunks are left to the chunks. Others are in one chunk only and replayed there,
    so that each word of the corpus is replayed once.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = _words(batch, k)
                for a in range(0, len(own), 100_000):
                    yield pa.RecordBatch.from_arrays([own.slice(a, 100_000).cast(pa.binary())], names=["word"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("word") for b in batches]
        own = pa.chunked_array(held, pa.binary()).combine_chunks() if held else pa.array([], pa.binary())
        if not len(own):
            return
        ids, at = merges(path).replay(*flat_bytes(own))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own.to_pylist()), np.uint64, len(own))
        tokens = [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tokens, pa.binary())], names=["hash", "tokens"])

    spark = chunks.sparkSession
    words = written(chunks.select("words", "ends").mapInArrow(listed, "word binary").groupBy("word").count().where("count > 1"))
    by_count = {r["count"]: r.n for r in words.groupBy("count").agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(by_count, default=2) + 1
    for c in sorted(by_count, reverse=True):
        if total + by_count[c] > most_sent:
            break
        total, least = total + by_count[c], c
    if not total:
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    tasks = max(1, min(-(-total // REPLAY_WORDS), spark.sparkContext.defaultParallelism))
    table = words.where(F.col("count") >= least).select("word").repartition(tasks).mapInArrow(replayed, "hash long, tokens binary").toArrow()
    data, at = flat_bytes(table.column("tokens"))
    return Tokens(table.column("hash").to_numpy().view(np.uint64), data.view(np.int32), np.diff(at) // 4)


def encoded(docs: DataFrame, path: str, most_sent: int, made: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, most: int = REPLAY_BYTES) -> DataFrame:
    """What ``made`` gives for each chunk of (doc_id, text): of ids, which texts are null, tokens, offsets into them and
    which texts' tokens decode to their bytes. The corpus is read once, then its words' codes."""
    chunks = written(coded(docs, most), {"parquet.block.size": 64 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    sent = docs.sparkSession.sparkContext.broadcast(corpus_tokens(chunks, path, most_sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = merges(path), sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                counts, codes = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in ("counts", "codes"))
                words = _words(batch, k)
                size, at, there = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), known.find(words)
                found = np.flatnonzero(there >= 0)
                size[found], at[found] = known.size[there[found]], known.at[there[found]]
                right = np.zeros(len(words), bool)
                right[found] = _decodes(model, words.take(pa.array(found)), gathered_ranges(known.tokens, at[found], size[found]), size[found])
                rest = np.flatnonzero(~right)  # words that only this chunk has
                ids, own = model.replay(*flat_bytes(words.take(pa.array(rest))))
                size[rest], at[rest] = np.diff(own), own[:-1] + len(known.tokens)
                right[rest] = _decodes(model, words.take(pa.array(rest)), ids, size[rest])
                all_ids = np.concatenate((known.tokens, ids)) if len(rest) else known.tokens
                tokens = gathered_ranges(all_ids, at[codes], size[codes])
                ends = np.concatenate(([0], np.cumsum(np.maximum(counts, 0))))
                token_at = np.concatenate(([0], np.cumsum(size[codes])))[ends]
                wrong = np.concatenate(([0], np.cumsum(~right[codes])))[ends]
                yield from made(batch.column("ids")[k].values, counts < 0, tokens, token_at, np.diff(wrong) == 0)

    return chunks.mapInArrow(run, schema)


def _decodes(model: Merges, words: pa.Array, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each word's tokens give its bytes again."""
    if not len(words):
        return np.zeros(0, bool)
    data, at = flat_bytes(words)
    back, back_at = model.decode(tokens, np.concatenate(([0], np.cumsum(size))))
    if np.array_equal(at, back_at) and np.array_equal(data, back):
        return np.ones(len(words), bool)
    return np.array([data[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(at, at[1:], back_at, back_at[1:])])


def bpe_encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k.json", rows: int = 2000, most_sent: int = 1 << 20) -> DataFrame:
    """Tokens of every text: (doc_id, token_ids, round_trip).

    ``round_trip`` says that decoding the tokens gives the bytes of all of the text's words, of which it consists. A
    null text has null tokens and a null ``round_trip``; an empty text has no tokens and round-trips; texts of any
    length are whole. Rows come out one for one, repeated ones too, null ids kept; an empty table gives no rows; other
    columns of the input are not read, whatever their names. ``most_sent`` is how many words' tokens are broadcast at
    most (about 40 bytes each); tokens are the same for any.
    """

    def made(ids: pa.Array, missing: np.ndarray, tokens: np.ndarray, at: np.ndarray, good: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), rows):
            b = min(a + rows, len(ids))
            lists = pa.ListArray.from_arrays(pa.array((at[a : b + 1] - at[a]).astype(np.int32)), pa.array(tokens[at[a] : at[b]]), mask=pa.array(missing[a:b]))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists, pa.array(good[a:b], mask=missing[a:b])], names=["doc_id", "token_ids", "round_trip"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encoded(own, vocabulary(tokenizers, name), most_sent, made, f"doc_id {own.schema[0].dataType.simpleString()}, token_ids array<int>, round_trip boolean")


def bpe_decode(tokens: DataFrame, doc_id: str = "doc_id", token_ids: str = "token_ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Texts of token lists: (doc_id, text). A null list gives a null text, an empty one an empty text; bytes that are
    no UTF-8 become replacement characters; an id outside the vocabulary, or a null one, is an error."""
    path = vocabulary(tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            lists = batch.column("token_ids")
            values = pc.list_flatten(lists)
            if values.null_count:
                raise ValueError("a token list holds a null")
            ids = values.to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(model.pieces)):
                raise ValueError("a token id is outside the vocabulary")
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            data, ends = model.decode(ids, at)
            whole = data.tobytes()
            missing = lists.is_null().to_pylist()
            texts = [None if m else whole[a:b].decode("utf-8", "replace") for m, a, b in zip(missing, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    own = tokens.select(F.col(doc_id).alias("doc_id"), F.col(token_ids).cast("array<int>").alias("token_ids"))
    return own.mapInArrow(run, f"doc_id {own.schema[0].dataType.simpleString()}, text string")
