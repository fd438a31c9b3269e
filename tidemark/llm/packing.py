"""Best-fit packing of whole corpora by length classes.

Lengths are whole numbers up to the capacity, so a corpus is described by how many pieces each length has. From these
counts alone (their number is bounded by the capacity, not by the corpus) the driver makes the whole plan: large
pieces, above a third of the capacity, are matched greedily, two a bin at most; smaller ones go, longest first, to
the tightest gap that takes them. The plan says which ranks of a length go to which bins; each piece finds its bin by
its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of one length that are ranked together; a length has as many parts as its pieces ask for.
RANKED = 1 << 18


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, pieces, first bin, pieces a bin, offset in the bin) and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used: dict[int, int] = defaultdict(int)
    segments: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # the gaps that there are, sorted

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        segments.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a) - 1
        while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
            k -= 1
        if k < 0:
            n = left[a]
            place(a, n, bins, 1, 0)
            free(capacity - a, bins, n)
        elif large[k] == a:
            n = left[a] // 2
            place(a, 2 * n, bins, 2, 0)
            free(capacity - 2 * a, bins, n)
        else:
            b = large[k]
            n = min(left[a], left[b])
            place(a, n, bins, 1, 0)
            place(b, n, bins, 1, a)
            free(capacity - a - b, bins, n)
        bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                n = -(-left[length] // (capacity // length))
                free(capacity, bins, n)
                bins += n
                continue
            gap = sizes[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(k)
            each = gap // length
            whole = min(n, left[length] // each)
            if whole:  # these bins take all they can of this length
                place(length, whole * each, first, each, capacity - gap)
                free(gap - each * length, first, whole)
                free(gap, first + whole, n - whole)
            else:
                few = left[length]
                place(length, few, first, few, capacity - gap)
                free(gap - few * length, first, 1)
                free(gap, first + 1, n - 1)
    return segments, bins


def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 8192, ranked: int = RANKED) -> DataFrame:
    """Where every piece of every text goes: (doc_id, start, length, bin_id, bin_offset).

    Lengths are bytes of UTF-8, that is byte-level tokens. A text longer than ``capacity`` is cut into full pieces and a
    rest; ``start`` is a piece's first byte in its text. A null or empty text has one row with length 0 and no bin.
    Texts of any length are whole. Repeated rows are packed once each; equal lengths go by the hash of id and start, then id. Null ids are packed as
    any other; other columns of the input are not read, whatever their names; an empty table gives no rows. ``ranked`` is about
    how many pieces of one length a task ranks.
    """
    from .shared import written

    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    own = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long")
    pieces = own.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    pieces = pieces.select("doc_id", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("k") * capacity).alias("length"))
    pieces = written(pieces)
    totals = {r.length: r["count"] for r in pieces.where("length > 0").groupBy("length").count().collect()}
    parts = spark.createDataFrame([(n, -(-c // ranked)) for n, c in totals.items()], "s_length long, s_parts long")  # one row for each length
    salted = pieces.where("length > 0").join(F.broadcast(parts), F.col("length") == F.col("s_length"))
    salted = salted.select("doc_id", "start", "length", F.pmod(F.xxhash64("doc_id", "start"), F.col("s_parts")).alias("salt"))
    counts = salted.groupBy("length", "salt").count()
    segments, _ = packing_plan(totals, capacity)
    schema = "p_length long, p_first long, p_n long, p_bin long, p_each long, p_offset long"
    plan = spark.createDataFrame(segments, schema)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("length", "salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "start")) - 1
    numbered = salted.withColumn("rank", rank).join(shifts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_first") + F.col("p_n"))
    nth = F.col("rank") - F.col("p_first")
    packed = numbered.join(F.broadcast(plan), here).select("doc_id", "start", "length", (F.col("p_bin") + F.expr("(rank - p_first) div p_each")).alias("bin_id"), (F.col("p_offset") + F.pmod(nth, F.col("p_each")) * F.col("length")).alias("bin_offset"))
    none = pieces.where("length = 0").select("doc_id", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(none)
