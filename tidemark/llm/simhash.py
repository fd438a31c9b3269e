"""Near-duplicate groups by SimHash and an LSH forest.

A text's fingerprint is a 256-bit SimHash of its set of words (lower case, outer punctuation dropped). Each trie of
the forest orders the bits by its own random permutation. Fingerprints are shuffled by short prefixes of a few tries,
as deep as their counts ask for, to buckets of up to ``BUCKET``; a bucket has a forest of its own in memory, in which
each fingerprint's prefixes adapt to the density around it and climb to shorter ones until a pair at the design
distance meets with the target probability, and one at the radius with probability ``EDGE``. Every pair that shares a
prefix is verified by the Hamming distance of the whole fingerprints.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import distinct, flat_bytes, gathered, row_of, words
from .shared import may_be_in, written

BITS, BYTES = 256, 32
PUNCTUATION = ".,;:!?\"'`()[]{}<>|#$%&*+-=/\\~^_@…–—«»¿¡“”‘’"
#: Bits of a trie's prefixes at most, and of those counted at a time.
DEEPEST, STEP = 64, 12
#: Fingerprints that a bucket holds at most, unless they share as many bits as are counted; tries that are shuffled at least.
BUCKET, TRIES = 1 << 20, 8
#: Rows that share a prefix up to which pairs are compared side by side, beyond it row by row; both compare them all.
CROWD = 256
#: Recall of pairs at the radius itself.
EDGE = 0.92
#: Distinct words from which a text's bits are counted by itself.
LONG = 600
#: Fingerprints of a bucket that are searched, and those that are shuffled as one row, at most.
SEARCHED, PACKED = 1 << 18, 64
#: Text bytes that are hashed at a time.
STEP_BYTES = 3 << 20


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(column: pa.Array) -> list[bytes | None]:
    """The SimHash of each text; None for null and for texts without a word."""
    codes, offsets, dictionary = words(column)
    plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=PUNCTUATION).dictionary_encode()
    known = plain.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    table = np.stack([_mixed(hashes, k) for k in range(BITS // 64)], axis=1).view(np.uint8).reshape(-1, BYTES) if known else np.zeros((0, BYTES), np.uint8)
    codes = plain.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
    blank = known.index("") if "" in known else -1
    n = len(offsets) - 1
    pairs = distinct(row_of(offsets) * max(len(known), 1) + codes) if len(codes) else np.zeros(0, np.int64)
    rows, codes = np.divmod(pairs, max(len(known), 1))
    rows, codes = rows[codes != blank], codes[codes != blank]
    ends = np.searchsorted(rows, np.arange(n + 1))
    packed = _majority(table.view(np.uint64), codes, ends[:-1], np.diff(ends)).view(np.uint8).tobytes()
    some = (np.diff(ends) > 0).tolist()
    return [packed[BYTES * k : BYTES * (k + 1)] if one else None for k, one in enumerate(some)]


def _majority(table: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row of codes the bits that more than half of their entries in the table have.

    The k-th entries of all rows are added at once to counters that are kept by binary digits, a uint64 for 64 counters;
    rows of more than ``LONG`` entries are counted one by one.
    """
    n, width = len(size), table.shape[1]
    out = np.empty((n, width), np.uint64)
    for k in np.flatnonzero(size > LONG).tolist():
        ones = np.zeros(64 * width, np.int64)
        for c in range(int(begin[k]), int(begin[k] + size[k]), 255):  # eight counters of a byte in each uint64
            bits = np.unpackbits(table[codes[c : min(c + 255, int(begin[k] + size[k]))]].view(np.uint8), axis=1)
            ones += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
        out[k] = np.packbits(2 * ones > size[k]).view(np.uint64)
    order = np.flatnonzero(size <= LONG)
    order = order[np.argsort(-size[order], kind="stable")]  # rows that go on are in front
    begin, size, n = begin[order], size[order], len(order)
    digits: list[np.ndarray] = []
    longest = int(size[0]) if n else 0
    for k, going in enumerate(np.searchsorted(-size, -np.arange(longest), side="left").tolist()):
        carry = table[codes[begin[:going] + k]]
        if not (k + 1) & k:
            digits.append(np.zeros((n, width), np.uint64))
        for own in digits:
            both = own[:going] & carry
            own[:going] ^= carry
            carry = both
            if not carry.any():
                break
    more, same = np.zeros((n, width), np.uint64), np.full((n, width), 2**64 - 1, np.uint64)
    half = size // 2
    for d in reversed(range(len(digits))):
        limit = np.where(half >> d & 1, np.uint64(2**64 - 1), np.uint64(0))[:, None]
        more |= same & digits[d] & ~limit
        same &= ~(digits[d] ^ limit)
    out[order] = more
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) of (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=STEP_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fingerprints(batch.column("text")), pa.binary())], names=["doc_id", "row", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp binary")


@functools.cache
def permutation(trie: int) -> np.ndarray:
    """The bits that the trie's prefixes are made of, in its own random order."""
    return np.random.default_rng(7919 * trie + 17).permutation(BITS)[:DEEPEST]


def prefix_keys(bits: np.ndarray, trie: int) -> np.ndarray:
    """The permuted bits of each row of unpacked fingerprints as one number, the first bit on top."""
    return np.packbits(np.take(bits, permutation(trie), axis=1), axis=1).view(">u8").ravel().astype(np.uint64)


def _unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(len(fp), BYTES), axis=1)


def recall(depth: float, tries: int, distance: float) -> float:
    """Probability that a pair at this share of differing bits has a common prefix of ``depth`` bits in one of the tries."""
    return 1 - (1 - (1 - distance) ** depth) ** tries


class _Components:
    """Components of rows by verified pairs; ``label`` is the smallest row of each. Pairs within one are passed over."""

    def __init__(self, fp: np.ndarray, most: int):
        self.fp, self.most = fp, most
        self.label = np.arange(len(fp), dtype=np.int32 if len(fp) < 1 << 31 else np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.pending += len(a)
            if self.pending > len(self.label) // 4 + 1000:
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        label = self.label
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.pending = [], 0
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            label[np.maximum(x, y)] = np.minimum(x, y)  # of several that share a place one is taken, the others come again
            while not np.array_equal(up := label[label], label):
                label[:] = up
            del up

    def check(self, columns: list[np.ndarray], order: np.ndarray, a: np.ndarray, shift: int) -> None:
        """Pairs of places (a, a + shift) in an order of the rows; ``columns`` has their fingerprints by words, in that order."""
        for k in range(0, len(a), 1 << 18):
            x = a[k : k + (1 << 18)]
            y = x + shift
            apart = np.bitwise_count(columns[0][x] ^ columns[0][y]) + np.bitwise_count(columns[1][x] ^ columns[1][y])
            x = x[apart <= self.most]  # most pairs differ too much in half of the bits already
            x, y = order[x], order[x + shift]
            other = self.label[x] != self.label[y]
            x, y = x[other], y[other]
            near = np.bitwise_count(self.fp[x] ^ self.fp[y]).sum(axis=1, dtype=np.int64) <= self.most
            self.add(x[near], y[near])

    def crowd(self, rows: np.ndarray, asking: np.ndarray) -> None:
        """A prefix's many rows: those asking, or all, if many ask, are compared with all others. A row that was reached by
        one that is compared with all needs no other way to its component, so copies don't multiply the work."""
        if 8 * len(asking) < len(rows):
            self.settle()
            for x in asking.tolist():
                other = rows[self.label[rows] != self.label[x]]
                near = other[np.bitwise_count(self.fp[other] ^ self.fp[x]).sum(axis=1, dtype=np.int64) <= self.most]
                if len(near):
                    self.add(np.full(len(near), x), near)
                    self.settle()
            return
        rest, queue = rows, []
        while len(rest) or queue:
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            x = queue.pop()
            near = np.bitwise_count(self.fp[rest] ^ self.fp[x]).sum(axis=1, dtype=np.int64) <= self.most
            if near.any():
                found, rest = rest[near], rest[~near]
                self.add(np.full(len(found), x), found)
                queue.extend(found.tolist())


def _depths(key: np.ndarray, leaf: int) -> np.ndarray:
    """For each of the sorted keys the shortest prefix that at most ``leaf`` of them share."""
    n = len(key)
    depth = np.full(n, DEEPEST, np.int8)
    open_ = np.ones(n, bool)
    apart = key[1:] ^ key[:-1]
    for d in range(DEEPEST):
        if d:
            new = np.flatnonzero(np.concatenate(([True], apart >= np.uint64(1 << (DEEPEST - d)))))
        else:
            new = np.zeros(1, np.int64)
        size = np.diff(np.append(new, n))
        few = open_ & np.repeat(size <= leaf, size)
        depth[few] = d
        open_ &= ~few
        if not open_.any():
            break
    return depth


def bucket_components(fp: np.ndarray, most: int, wanted: list[tuple[float, float]], seed: int, leaf: int) -> np.ndarray:
    """The smallest row of each row's component of verified pairs, by an LSH forest; ``fp`` has 4 uint64 a row.

    ``wanted`` has (share of differing bits, recall). A row's prefix in a trie is as deep as it takes for at most
    ``leaf`` rows to share it, so depth follows density. Tries are added while most rows fall short of the recall at
    their depths; then those that still do climb, one bit in all tries at a time, until they have it.
    """
    n = len(fp)
    found = _Components(fp, most)
    meets = [np.log1p(-np.minimum((1 - distance) ** np.arange(DEEPEST + 1.0), 1 - 1e-12)) for distance, _ in wanted]
    limits = [math.log(max(1 - target, 1e-9)) for _, target in wanted]
    nominal = max(0.0, math.log2(max(n, 1) / leaf))
    fewest = max(math.ceil(limit / min(float(np.interp(nominal, np.arange(DEEPEST + 1.0), meet)), -1e-9)) for meet, limit in zip(meets, limits))
    depths: list[np.ndarray] = []
    miss = np.zeros((len(wanted), n))

    def sorted_keys(t: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.empty(n, np.uint64)
        for a in range(0, n, 1 << 13):
            key[a : a + (1 << 13)] = prefix_keys(_unpacked(fp[a : a + (1 << 13)]), 1000 * (seed + 1) + t)
        order = np.argsort(key, kind="stable").astype(found.label.dtype)
        return key[order], order

    while True:
        key, order = sorted_keys(len(depths))
        own = np.empty(n, np.int8)
        own[order] = _depths(key, leaf)
        del key, order
        depths.append(own)
        for k, meet in enumerate(meets):
            for a in range(0, n, SEARCHED):
                miss[k, a : a + SEARCHED] += meet[own[a : a + SEARCHED]]
        short = np.any([miss[k] > limit for k, limit in enumerate(limits)], axis=0)
        if len(depths) >= fewest and (short.mean() <= 0.1 or len(depths) >= 4 * fewest + 8):
            break
    del miss
    climb = np.zeros(n, np.int8)
    for a in range(0, n, SEARCHED):
        rows = a + np.flatnonzero(short[a : a + SEARCHED])
        while len(rows):
            climb[rows] += 1
            at = [np.maximum(d[rows] - climb[rows], 0) for d in depths]
            rows = rows[np.any([sum(meet[d] for d in at) > limit for meet, limit in zip(meets, limits)], axis=0)]
    for t, own in enumerate(depths):
        key, order = sorted_keys(t)
        begin, end = np.empty_like(order), np.empty_like(order)
        for a in range(0, n, SEARCHED):
            step = slice(a, a + SEARCHED)
            depth = np.maximum(own[order[step]] - climb[order[step]], 0).astype(np.uint64)
            wide = np.minimum(np.uint64(DEEPEST) - depth, np.uint64(63))
            low = np.where(depth > 0, key[step] >> wide << wide, np.uint64(0))
            top = np.where(depth > 0, low + ((np.uint64(1) << wide) - np.uint64(1)), np.uint64(2**64 - 1))
            begin[step], end[step] = np.searchsorted(key, low, side="left"), np.searchsorted(key, top, side="right")
        del key
        crowded = end - begin > CROWD
        columns = [fp[:, k][order] for k in (0, 1)]
        for a in range(0, n, SEARCHED):
            ask = a + np.flatnonzero(~crowded[a : a + SEARCHED])
            shift = 1
            while len(ask):  # a pair is compared once: by its first row if that reaches so far, else by its second
                ahead = ask[ask + shift < end[ask]]
                found.check(columns, order, ahead, shift)
                back = ask[ask - shift >= begin[ask]]
                back = back[crowded[back - shift] | (end[back - shift] <= back)]
                found.check(columns, order, back - shift, shift)
                ask = ask[(ask + shift < end[ask]) | (ask - shift >= begin[ask])]
                shift += 1
        del columns
        if crowded.any():
            where = np.flatnonzero(crowded)
            node, member = np.unique(begin[where].astype(np.int64) * (n + 1) + end[where], return_inverse=True)
            by = np.argsort(member, kind="stable")
            cuts = np.searchsorted(member[by], np.arange(len(node) + 1))
            found.settle()
            mixed = np.concatenate(([0], np.cumsum(np.diff(found.label[order]) != 0)))
            for k, code in enumerate(node.tolist()):
                a, b = divmod(code, n + 1)
                if mixed[a] == mixed[b - 1]:  # one component already
                    continue
                found.crowd(order[a:b], order[where[by[cuts[k] : cuts[k + 1]]]])
    found.settle()
    return found.label


class Forest:
    """What is shuffled: ``tries`` tries whose prefixes are as deep as it takes for a bucket to hold at most so many
    fingerprints, but not deeper than the tries can make up for: beyond that, a crowd is climbed back to and its bucket
    is larger. A bucket has a forest of its own (``bucket_components``), whose recall makes up for the bucket's depth.
    """

    def __init__(self, n: int, bucket: int, wanted: list[tuple[float, float]], least: int):
        self.wanted = wanted
        even = max(0.0, math.log2(max(n, 1) / bucket))  # the depth if fingerprints were spread evenly; crowds get a bit more
        even += even > 0
        self.tries = max(least, *(math.ceil(math.log(1 - target) / math.log1p(-0.8 * (1 - distance) ** even)) for distance, target in wanted))
        self.deepest = 0
        while self.deepest < DEEPEST and even and all(0.98 * (1 - distance) ** (self.deepest + 1) >= owed for distance, owed in self.recalls(0)):
            self.deepest += 1
        self.starts: list[np.ndarray] = []
        self.depth: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def recalls(self, depth: int) -> list[tuple[float, float]]:
        """The recall that a bucket of this depth owes, for each distance."""
        return [(distance, min(0.98, (1 - (1 - target) ** (1 / self.tries)) / (1 - distance) ** depth)) for distance, target in self.wanted]


def _counted(nodes: DataFrame, tries: list[int], level: int, open_: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each trie the prefixes of (level + 1) * STEP bits below the open ones of level * STEP, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            bits = np.unpackbits(flat_bytes(batch.column("fp"))[0].reshape(-1, BYTES), axis=1)
            for t in tries:
                key = prefix_keys(bits, t) >> np.uint64(DEEPEST - (level + 1) * STEP)
                if level:
                    key = key[np.isin(key >> np.uint64(STEP), open_[t])]
                value, count = np.unique(key, return_counts=True)
                if t in held:
                    value, place = np.unique(np.concatenate((held[t][0], value)), return_inverse=True)
                    count = np.bincount(place, weights=np.concatenate((held[t][1], count)), minlength=len(value)).astype(np.int64)
                held[t] = value, count
        for t, (value, count) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), t, np.int32)), pa.array(value.astype(np.int64)), pa.array(count.astype(np.int64))], names=["trie", "prefix", "n"])

    table = nodes.select("fp").mapInArrow(run, "trie int, prefix long, n long").groupBy("trie", "prefix").agg(F.sum("n").alias("n")).toArrow()
    trie, prefix, n = (table.column(c).to_numpy() for c in ("trie", "prefix", "n"))
    return {t: (prefix[trie == t].astype(np.uint64), n[trie == t]) for t in tries}


def planned(nodes: DataFrame, n: int, bucket: int, wanted: list[tuple[float, float]], least: int) -> Forest:
    """The forest for ``n`` fingerprints, from counts of all of them; without counting where one bucket holds all."""
    forest = Forest(n, bucket, wanted, least)
    leaves: dict[int, list[tuple[int, int, int]]] = {t: [] for t in range(forest.tries)}
    open_ = {t: np.zeros(1, np.uint64) for t in range(forest.tries)} if forest.deepest else {}
    if not open_:
        leaves = {t: [(0, 0, n)] for t in range(forest.tries)}
    level = 0
    while open_:
        counts = _counted(nodes, list(open_), level, open_)
        further = {}
        for t, above in open_.items():
            prefix, count = counts[t]
            still = []
            for p in above.tolist():
                sums = [np.zeros(1 << STEP, np.int64)]
                a, b = np.searchsorted(prefix, np.array([p << STEP, (p + 1) << STEP], np.uint64))
                sums[0][(prefix[a:b] - np.uint64(p << STEP)).astype(np.int64)] = count[a:b]
                while len(sums[-1]) > 1:
                    sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
                crowded = np.zeros(1, np.int64)
                for d in range(1, STEP + 1):
                    depth = level * STEP + d
                    below = np.concatenate((2 * crowded, 2 * crowded + 1))
                    size = sums[STEP - d][below]
                    full = (size > bucket) & (depth < forest.deepest)
                    leaves[t] += [(((p << d) + x) << (DEEPEST - depth), depth, s) for x, s in zip(below[~full].tolist(), size[~full].tolist())]
                    crowded = np.sort(below[full])
                still += [(p << STEP) + x for x in crowded.tolist()]
            if still:
                further[t] = np.array(still, np.uint64)
        open_, level = further, level + 1
    for own in leaves.values():
        own.sort()
        forest.starts.append(np.array([x for x, _, _ in own], np.uint64))
        forest.depth.append(np.array([d for _, d, _ in own], np.int64))
        forest.size.append(np.array([s for _, _, s in own], np.int64))
    return forest


def pack(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows of up to ``PACKED`` fingerprints of one bucket: their bucket, and node and fingerprint of each, 40 bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
    cuts = np.flatnonzero(rank % PACKED == 0)
    body = np.column_stack((node.astype(np.int64).view(np.uint64), fp.reshape(-1, BITS // 64)))[order]
    offsets = (8 + BYTES) * np.append(cuts, len(bucket)).astype(np.int32)
    return bucket[cuts], pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _bucket_edges(held: list[pa.RecordBatch], most: int, wanted: list[tuple[float, float]], seed: int, leaf: int) -> pa.RecordBatch:
    """(a, b) that join the nodes of each component of a bucket; its rows (see pack) are taken out of ``held``."""
    bodies = []
    while held:
        bodies.append(flat_bytes(held.pop().column("packed"))[0].view(np.uint64).reshape(-1, 1 + BITS // 64))
    ids = np.concatenate([x[:, 0] for x in bodies]).view(np.int64)
    fp = np.empty((len(ids), BITS // 64), np.uint64)
    at = len(ids)
    while bodies:
        x = bodies.pop()
        at -= len(x)
        fp[at : at + len(x)] = x[:, 1:]
    order = np.argsort(ids, kind="stable")  # the smallest node of each component is its centre; any order of rows gives the same
    ids = ids[order]
    for k in range(BITS // 64):
        fp[:, k] = fp[order, k]
    del order, x
    label = bucket_components(fp, most, wanted, seed, leaf)
    off = label != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[label[off]])], names=["a", "b"])


def forest_edges(nodes: DataFrame, radius: float, distance: float, target: float, leaf: int, n: int, bucket: int = BUCKET, tries: int = TRIES) -> DataFrame:
    """Distinct (a, b), a > b, that join the nodes of each group of verified pairs; nodes are (node, fp), ``n`` of them."""
    most = int(radius * BITS)
    forest = planned(nodes, n, bucket, [(distance, target), (most / BITS, EDGE)], tries)
    first = np.concatenate(([0], np.cumsum([len(s) for s in forest.starts]))).astype(np.int64)
    size, depth = np.concatenate(forest.size), np.concatenate(forest.depth)
    spark = nodes.sparkSession
    parts = int(min(max((size > 0).sum(), 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)))
    part = np.empty(len(size), np.int32)
    part[np.argsort(-size, kind="stable")] = np.arange(len(size)) % parts  # the largest buckets go to different partitions
    sent = spark.sparkContext.broadcast((forest.starts, part))  # 12 bytes for each trie's n / bucket buckets

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, part = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = flat_bytes(batch.column("fp"))[0]
            bits = np.unpackbits(fp.reshape(-1, BYTES), axis=1)
            for t, own in enumerate(starts):
                place = first[t] + (np.searchsorted(own, prefix_keys(bits, t), side="right") - 1 if len(own) > 1 else np.zeros(len(bits), np.int64))
                bucket, packed = pack(place, batch.column("node").to_numpy(), fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part[bucket]), pa.array(bucket), packed], names=["part", "bucket", "packed"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: int) -> pa.RecordBatch:
            return _bucket_edges(held, most, forest.recalls(int(depth[bucket])), int(np.searchsorted(first, bucket, side="right")), leaf)

        held: list[pa.RecordBatch] = []
        now = -1
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != now and held:
                    yield done(now)
                now = int(own[a])
                held.append(batch.slice(a, b - a))
            del batch
        if held:
            yield done(now)

    rows = nodes.mapInArrow(spread, "part int, bucket long, packed binary").repartitionById(parts, "part").sortWithinPartitions("bucket")
    return rows.select("bucket", "packed").mapInArrow(join, "a long, b long").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")]
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    made = _Components(np.zeros((len(ids), 0), np.uint64), 0)
    made.add(place[: len(ends[0])], place[len(ends[0]) :])
    made.settle()
    off = made.label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[made.label[off]])], names=["node", "keeper"])


def components(edges: DataFrame, one_task: int = 1 << 22) -> DataFrame:
    """(node, keeper) of all nodes but the keepers: the smallest node of each connected component of (a, b).

    Up to ``one_task`` edges (16 bytes each) are one task's work. More take alternating large-star and small-star
    steps, each written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    Both give the same.
    """
    from pyspark.sql import Window

    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_joined, "node long, keeper long")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        new = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(new)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("keeper"))
        mark = found


def _decided(docs: DataFrame, doc_id: str, text: str, radius: float, distance: float, target: float, leaf: int) -> DataFrame:
    """(doc_id, row, keeper_id, is_duplicate) of all rows; ``row`` is the hash of the text, which tells rows of one id apart."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    keys = written(hashed(own))
    nodes = written(keys.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    groups = components(forest_edges(nodes.select("node", "fp"), radius, distance, target, leaf, n)) if n else nodes.select("node", F.col("node").alias("keeper")).limit(0)
    grouped = nodes.join(groups, "node", "left").select("fp", "id", F.coalesce("keeper", "node").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("id").alias("keeper"))
    joined = keys.join(grouped.join(smallest, "group").select("fp", "keeper"), "fp", "left").withColumn("keeper", F.when(F.col("doc_id").isNotNull(), F.coalesce("keeper", "doc_id")))
    return joined.select("doc_id", "row", F.col("keeper").alias("keeper_id"), F.coalesce(F.col("doc_id") != F.col("keeper"), F.lit(False)).alias("is_duplicate"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: float = 0.17, distance: float = 0.13, target: float = 0.95, leaf: int = 64) -> DataFrame:
    """The decision on every row: (doc_id, keeper_id, is_duplicate).

    Texts whose fingerprints differ in at most ``radius`` of the bits are near-duplicates; groups are the connected
    components of such pairs, equal texts included, and the smallest id of a group is its keeper. ``distance`` is the
    share of differing bits for which the forest has at least the recall ``target``; closer pairs are found more surely, those
    at the radius with ``EDGE``.
    A null text, a text without words and a row without id are in no group, and are no duplicates; texts of any length
    are read whole. Each row is decided by its own text: rows with one id may be in different groups, and those with
    the keeper's id stay, repeated rows too. Ids may be numbers or strings. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    return _decided(docs, doc_id, text, radius, distance, target, leaf).select("doc_id", "keeper_id", "is_duplicate")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: float = 0.17, distance: float = 0.13, target: float = 0.95, leaf: int = 64, most_sent: int = 4 << 20) -> DataFrame:
    """The rows that near_duplicates keeps, with all columns of the input, whatever their names; null texts, texts
    without words and rows without id stay; an empty table gives no rows. The rows that go, by id and hash of the text,
    are broadcast up to ``most_sent`` of them; beyond that a Bloom filter of their texts' hashes says which rows are
    compared with them by a shuffle."""
    lost = written(_decided(docs, doc_id, text, radius, distance, target, leaf).where("is_duplicate").select(F.col("doc_id").alias("_lost_id"), F.col("row").alias("_lost_row")).distinct())
    n, own = lost.count(), F.xxhash64(docs[text])
    goes = (docs[doc_id] == lost["_lost_id"]) & (own == lost["_lost_row"])
    if n <= most_sent:
        return docs.join(F.broadcast(lost), goes, "left_anti")
    may = may_be_in(lost.select("_lost_row"), n, own)
    return docs.where(may).join(lost, goes, "left_anti").union(docs.where(~may))
