"""License scans by diagonal voting.

Every rolling k-gram of words of every text is joined to the places where the license templates have it. Hits of a
text and a template are counted by bands of diagonals (place in the text less place in the template), as words put in
or left out move the diagonal, and the stretches that get the votes that any accepted span has are verified word by
word.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import gathered, row_of, words
from .shared import written
from .simhash import PUNCTUATION, _mixed

#: (license, text); short notices and the operative sentences of longer ones.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def plain_words(text: str) -> list[str]:
    """The words that take part: lower case, without outer punctuation; marks alone (bullets, comment signs) drop out."""
    return [w for w in (x.lower().strip(PUNCTUATION) for x in text.split()) if w]


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for i in range(k):
            out += _mixed(hashes[i : i + len(out)], i)
    return out.view(np.int64)


def _word_hashes(known: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))


def text_grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, place, gram): all rolling k-grams of all texts; places count the words that take part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=8 << 20):
            codes, offsets, dictionary = words(batch.column("text"))
            if not len(codes):
                continue
            plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=PUNCTUATION)
            hashes = _word_hashes(plain.to_pylist())
            real = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)[codes]
            rows = row_of(offsets)[real]
            grams = _grams(hashes[codes[real]], k)
            first = np.searchsorted(rows, np.arange(len(offsets) - 1))
            inside = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            place = (at - first[rows[at]]).astype(np.int32)
            for a in range(0, len(at), 500_000):
                b = a + 500_000
                own = pa.array(rows[at[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("row").take(own), pa.array(place[a:b]), pa.array(grams[at[a:b]])], names=["doc_id", "row", "place", "gram"])

    return docs.mapInArrow(run, f"doc_id {kind}, row long, place int, gram long")


def fewest_votes(length: int, k: int, least: int, share: float) -> int:
    """The fewest k-grams that an accepted span has in common with a template of ``length`` words.

    Of its equal words, in the text as in the template, at most ``equal / share`` words are covered. Each word that
    only one of them has parts the equal words once at most, and a part loses k - 1 k-grams.
    """
    most = []
    for equal in range(max(1, math.ceil(share * min(length, least) - 1e-9)), length + 1):
        more = _covered(equal, share) - equal
        parts = min(equal, more + min(more, length - equal) + 1)
        most.append(max(0, equal - parts * (k - 1)))
    return min(most)


def _covered(words_: int, share: float) -> int:
    """The most words that an accepted span with so many equal words covers."""
    return int(words_ / share + 1e-9)


def gram_size(lengths: list[int], k: int, least: int, share: float) -> int:
    """The longest k-grams, up to ``k``, of which accepted spans of all templates have at least one."""
    return next((n for n in range(k, 1, -1) if all(fewest_votes(m, n, least, share) for m in lengths)), 1)


def candidates(docs: DataFrame, templates: tuple[tuple[str, str], ...], k: int, drift: int, least: int, share: float) -> DataFrame:
    """(doc_id, row, template, first, last, votes): bands of diagonals with at least the votes that an accepted span has.

    The diagonals of an accepted span differ by at most the words that it has more than the template, or less; bands
    are twice as wide and overlap by half, so that one has all its votes.
    """
    known = [plain_words(text) for _, text in templates]
    if not all(known):
        raise ValueError(f"template {known.index([])} has no words")
    k = gram_size([len(own) for own in known], k, least, share)
    rows = []
    for t, own in enumerate(known):
        votes, wide = max(1, fewest_votes(len(own), k, least, share)), max(drift, _covered(len(own), share) - len(own)) + 1
        rows += [(t, p, g, votes, wide) for p, g in enumerate(_grams(_word_hashes(own), k).tolist())]
    places = docs.sparkSession.createDataFrame(rows, "template int, t_place int, t_gram long, least int, wide int")
    hits = text_grams(docs, k).join(F.broadcast(places), F.col("gram") == F.col("t_gram"))
    band = F.floor((F.col("place") - F.col("t_place")) / F.col("wide"))
    banded = hits.select("doc_id", "row", "template", "place", "least", F.explode(F.array(band, band - 1)).alias("band"))
    counted = banded.groupBy("doc_id", "row", "template", "band").agg(F.count("*").alias("votes"), F.min("place").alias("first"), (F.max("place") + k).alias("last"), F.first("least").alias("least"))
    return counted.where("votes >= least").select("doc_id", "row", "template", "first", "last", "votes")


def verified(own: list[str], template: list[str], first: int, last: int, least: int, share: float) -> tuple[int, int, float] | None:
    """The span (first, last) and the share of equal words if the text has the template there."""
    pad = 2
    a = max(0, first - pad)
    piece = own[a : last + pad]
    blocks = [b for b in difflib.SequenceMatcher(None, piece, template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    equal = sum(b.size for b in blocks)
    begin, end = blocks[0].a, blocks[-1].a + blocks[-1].size
    covered = max(end - begin, blocks[-1].b + blocks[-1].size - blocks[0].b)
    score = equal / covered
    if equal < share * min(len(template), least) or score < share:
        return None
    return a + begin, a + end, score


def _accepted(piece: list[str], template: list[str], least: int, share: float) -> tuple[int, int, float] | None:
    """Of the runs of matching blocks that ``verified`` would accept, the one with the most equal words."""
    blocks = [b for b in difflib.SequenceMatcher(None, piece, template, autojunk=False).get_matching_blocks() if b.size]
    need, best = share * min(len(template), least), None
    for i, x in enumerate(blocks):
        equal = 0
        for y in blocks[i:]:
            equal += y.size
            covered = max(y.a + y.size - x.a, y.b + y.size - x.b)
            if equal >= need and equal / covered >= share and (best is None or (equal, equal / covered) > best[:2]):
                best = (equal, equal / covered, x.a, y.a + y.size)
    return best and (best[2], best[3], best[1])


def _in_window(own: list[str], template: list[str], a: int, b: int, least: int, share: float) -> tuple[int, int, float] | None:
    """An accepted span within the words a to b: by all of them at once, else by the stretches that begin and end with words of the template."""
    need, room = share * min(len(template), least), Counter(template)
    if (room & Counter(own[a:b])).total() < need:
        return None
    found = _accepted(own[a:b], template, least, share)
    if found:
        return a + found[0], a + found[1], found[2]
    long = _covered(len(template), share)
    for x in range(a, b):
        if own[x] not in room:
            continue
        stop = min(b, x + long)
        for y in range(stop, x, -1) if long <= 16 else (stop,):
            if own[y - 1] not in room and y < stop:
                continue
            if (room & Counter(own[x:y])).total() < need:
                break
            found = _accepted(own[x:y], template, least, share)
            if found:
                return x + found[0], x + found[1], found[2]
    return None


def all_verified(own: list[str], template: list[str], ranges: list[tuple[int, int]], gap: int, least: int, share: float) -> list[tuple[int, int, float]]:
    """All spans (first, last, share of equal words) with the template around the ranges of a text's words.

    Ranges at most ``gap`` words apart are searched in one go, in windows that hold any accepted span whole; what is
    left before and after an accepted span is searched again.
    """
    long = _covered(len(template), share)
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        a, b = max(0, a - long), min(len(own), b + long)
        if merged and a <= merged[-1][1] + gap:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, end in merged:
        while a < end:
            rest, after = [(a, min(a + 2 * long, end))], a + long
            while rest:
                x, y = rest.pop()
                found = _in_window(own, template, x, y, least, share) if y > x else None
                if not found:
                    continue
                rest.append((x, found[0]))
                if found[0] < a + long:  # else the window may end within it: it is left to the next one
                    out.append(found)
                    after = max(after, found[1])
                    if found[1] < a + long:
                        rest.append((found[1], y))
            a = after
    return sorted(out)


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = 3, drift: int = 3, gap: int = 12, least: int = 12, share: float = 0.8, most_sent: int = 1 << 20) -> DataFrame:
    """Where texts have a license's words: (doc_id, license, first_word, last_word, score).

    Places count the words of ``plain_words``, ``last_word`` excluded. A span is accepted if at least ``share`` of its
    words and of ``least`` words of the template (all, if it has fewer) are equal; of overlapping spans the one with
    the most equal words stays, then the better score, then the earlier template. Null and empty texts have none; ids
    may be null or repeated: each row is verified by itself, told from others of its id
    by the hash of its text (rows equal in both have equal spans). ``k`` is the longest that k-grams may be; they are shorter
    if an accepted span could have none of that length. Candidates (one row for each text with hits) are broadcast up to
    ``most_sent`` rows and joined by a shuffle beyond. Other columns of the input are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("text"))
    found = candidates(own, templates, k, drift, least, share)
    per = written(found.groupBy(F.col("doc_id").alias("c_id"), F.col("row").alias("c_row")).agg(F.collect_list(F.struct("template", "first", "last")).alias("spans")))
    small = per.count() <= most_sent
    rows = own.join(F.broadcast(per) if small else per, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row"))).select("doc_id", "text", "spans")
    names = [n for n, _ in templates]
    known = [plain_words(t) for _, t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, body, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if body is None:
                    continue
                own_words = plain_words(body)
                good = []
                places = defaultdict(list)
                for s in spans:
                    places[s["template"]].append((s["first"], s["last"]))
                for t, ranges in places.items():
                    for a, b, score in all_verified(own_words, known[t], ranges, gap, least, share):
                        good.append((-round(score * (b - a)), -score, t, a, b))
                taken: list[tuple[int, int]] = []
                for _, score, t, a, b in sorted(good):
                    if not any(a < y and x < b for x, y in taken):
                        taken.append((a, b))
                        out.append((i, names[t], a, b, -score))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], names=["doc_id", "license", "first_word", "last_word", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, first_word int, last_word int, score double")
