"""Quality by ordinal cumulative-link regression on hashed text.

A grade is 0 (rated low), 1 (rated good but toxic) or 2 (rated good and not toxic). One weight vector over hashed
features is shared by all grades; ordered thresholds give P(grade > k) = sigmoid(weights . features - threshold_k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import byte_slices, gathered, row_of, words
from .shared import sampled

DIMENSIONS = 1 << 18
GRADES = 3
#: Text bytes that one step has features of; distinct word counts of a step are several times as large as its text.
STEP_BYTES = 4 << 20
#: Strength of the features that are shares of a text's words, not presences.
SHARE = 4.0


def _hashes(mark: str, values: pa.Array) -> np.ndarray:
    """The feature of each string, 0 for empty ones; ``mark`` keeps kinds of features apart."""
    known = values.dictionary_encode()
    seed = ord(mark)
    own = np.fromiter((xxhash.xxh32_intdigest(w, seed) % (DIMENSIONS - 2) + 2 if w else 0 for w in known.dictionary.to_pylist()), np.int64, len(known.dictionary))
    return own[known.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)


def word_features(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each distinct word: present ones (the whole word, its first 4 and 5 letters), and its whole shape."""
    shape = known
    for pattern, kind in ((r"[\p{Lu}\p{Lt}]+", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}]+", "x"), (r"[0-9]+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, kind)
    core = pc.utf8_trim(pc.utf8_lower(known), characters=".,;:!?\"'()|#$%&*")
    size = pc.utf8_length(core)
    starts = [pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(core, 0, n), "") for n in (4, 5)]
    return np.stack([_hashes("w", core), *(_hashes("p", s) for s in starts)], axis=1), _hashes("s", shape)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, by rows, and the rows' numbers of words. Feature 1 is the share of repeated words."""
    codes, offsets, dictionary = words(column)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.diff(offsets)
    present, shape = word_features(dictionary)
    rows = row_of(offsets)
    size = np.diff(offsets)
    once = np.unique(rows * len(present) + codes)
    r, c = np.divmod(once, len(present))
    p = np.concatenate([r * DIMENSIONS + present[c, j] for j in range(present.shape[1])])
    p = np.unique(p[p % DIMENSIONS > 0])
    s, count = np.unique(rows * DIMENSIONS + shape[codes], return_counts=True)
    same = np.concatenate(([False], (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])))
    again = np.bincount(rows[same], minlength=len(size))
    twice = np.flatnonzero(again)
    key = np.concatenate((p, s, twice * DIMENSIONS + 1))
    value = np.concatenate((np.ones(len(p)), SHARE * count / size[s // DIMENSIONS], SHARE * again[twice] / size[twice]))
    order = np.argsort(key, kind="stable")
    r, f = np.divmod(key[order], DIMENSIONS)
    return r, f, value[order], size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class _Entries:
    """A sparse matrix (n texts, d features) as entries sorted by text and again by feature."""

    def __init__(self, r: np.ndarray, f: np.ndarray, v: np.ndarray, n: int, d: int):
        by_feature, by_row = np.argsort(f, kind="stable"), np.argsort(r, kind="stable")
        self._hold(n, d, (r[by_feature], f[by_feature], v[by_feature]), (r[by_row], f[by_row], v[by_row]))

    def _hold(self, n: int, d: int, by_feature: tuple, by_row: tuple) -> None:
        self.n, self.d, self.by_feature, self.by_row = n, d, by_feature, by_row
        self.row_at, self.row_none = _begins(by_row[0], n)
        self.f_at, self.f_none = _begins(by_feature[1], d)

    def of(self, features: np.ndarray) -> _Entries:
        """Those of some features, which are numbered anew."""
        place = np.full(self.d, -1, np.int32)
        place[features] = np.arange(len(features))
        some = []
        for r, f, v in (self.by_feature, self.by_row):
            new = place[f]
            keep = new >= 0
            some.append((r[keep], new[keep], v[keep]))
        made = _Entries.__new__(_Entries)
        made._hold(self.n, len(features), *some)
        return made

    def rate(self) -> float:
        """A step that falls for most tables; where it doesn't, the fit halves it."""
        return 32.0 / (1.0 + np.bincount(self.by_row[0], weights=self.by_row[2] ** 2, minlength=self.n).max())

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The sum of value times weight of each text."""
        return _sums(self.by_row[2] * w[self.by_row[1]], self.row_at, self.row_none)

    def pulls(self, x: np.ndarray) -> np.ndarray:
        """The sum of value times the text's ``x`` of each feature."""
        return _sums(self.by_feature[2] * x[self.by_feature[0]], self.f_at, self.f_none)


def _begins(sorted_: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(sorted_, minlength=n)
    return np.cumsum(size) - size, size == 0


def _sums(values: np.ndarray, begin: np.ndarray, none: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(begin))
    out = np.add.reduceat(values, np.minimum(begin, len(values) - 1)) if len(begin) else np.zeros(0)
    out[none] = 0
    return out


class Ordinal:
    """The fitted model: sparse weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: np.ndarray, feats: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = 150, l1: float = 2e-3, least: float = 0.006, settled: float = 1e-3) -> Ordinal:
        """Accelerated proximal gradient with an L1 penalty, in two rounds; a round ends when 10 steps lower the penalised
        loss by less than the share ``settled``, or after ``steps`` steps and four times as many. Features in fewer than
        3 texts, or less than the share ``least`` of them, are left out."""
        n = len(grades)
        weights = np.zeros(DIMENSIONS)
        share = np.array([(np.sum(grades > k) + 0.5) / (n + 1.0) for k in range(GRADES - 1)])
        thresholds = -np.log(share / (1 - share))
        if not n or len(np.unique(grades)) < 2:
            return cls(weights, thresholds if n else np.full(GRADES - 1, 6.0))
        seen = np.bincount(feats, minlength=DIMENSIONS)
        often = seen >= max(3, least * n)
        used = np.flatnonzero(often)
        keep, d = often[feats], len(used)
        r, f, v = rows[keep].astype(np.int32), (np.cumsum(often) - 1).astype(np.int32)[feats[keep]], values[keep].astype(float)
        above = np.stack([(grades > k).astype(float) for k in range(GRADES - 1)])
        # A rarer grade's texts weigh more, by the root of its rarity.
        each = np.bincount(grades, minlength=GRADES)
        weight = np.sqrt(n / np.maximum(each, 1))[grades]
        weight = weight / weight.mean()
        scale = np.sqrt(np.maximum(np.bincount(f, weights=v * v, minlength=d) / n, 1e-4))
        v = v / np.minimum(1.0, scale * 4)[f]  # rarer features may move faster
        entries = _Entries(r, f, v, n, d)
        del keep, r, f, v
        rate = entries.rate()
        own, held = np.arange(d), entries  # the features that move now: all, then those that the penalty doesn't hold at 0
        y, before, momentum = np.zeros(d), np.zeros(d), 1.0
        charge = np.full(d, l1)
        best, past, first, step = np.inf, [], True, 0
        while True:
            done = step >= (steps if first else 4 * steps) or len(past) > 10 and past[-1] >= past[-11] * (1 - settled)
            if done and not first:
                break
            if done:  # the rest is for the features found so far, the stronger ones shrunk less
                kept = own[before != 0]
                held = entries = entries.of(kept)
                used, scale, before = used[kept], scale[kept], before[before != 0]
                own, charge = np.arange(len(before)), l1 * 0.1 / (0.1 + np.abs(before))
                y, momentum, best, past, first, step = before.copy(), 1.0, np.inf, [], False, 0
                rate = entries.rate()
            elif step and step % 15 == 0:
                slack = (_sigmoid(held.scores(before) - thresholds[:, None]) - above) * weight
                moves = np.abs(entries.pulls(slack.sum(axis=0))) / n > 0.5 * charge
                value, next_ = np.zeros(entries.d), np.zeros(entries.d)
                value[own], next_[own] = before, y
                own = np.flatnonzero(moves | (value != 0) | (next_ != 0))
                held, before, y = entries.of(own), value[own], next_[own]
            penalty = charge[own]
            step += 1
            score = held.scores(y)
            slack = _sigmoid(score - thresholds[:, None]) - above
            loss = -np.sum(weight * np.log(np.clip(np.where(above > 0, slack + above, 1 - slack), 1e-9, 1))) / n + (penalty * np.abs(y)).sum()
            if loss > best * 1.5 + 1e-9:
                rate, momentum, y = rate / 2, 1.0, before.copy()
                best = np.inf
                continue
            best = min(best, loss)
            past.append(best)
            slack = slack * weight
            grad = held.pulls(slack.sum(axis=0)) / n
            thresholds = np.sort(thresholds + 2.0 * slack.sum(axis=1) / n)
            new = y - rate * grad
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            y = new + (momentum - 1) / ahead * (new - before)
            before, momentum = new, ahead
        weights[used[own]] = before / np.minimum(1.0, scale[own] * 4)
        return cls(weights, thresholds)

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text (rows) and k (columns). The same sums as over ``features``; features whose weight is
        0, most of them, are passed over before any is counted."""
        codes, offsets, dictionary = words(column)
        size = np.diff(offsets)
        n = len(size)
        score = np.zeros(n)
        if len(codes):
            present, shape = word_features(dictionary)
            rows = row_of(offsets)
            same = np.concatenate(([False], (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])))
            shares = np.bincount(rows, weights=self.weights[shape[codes]], minlength=n) + self.weights[1] * np.bincount(rows[same], minlength=n)
            score += SHARE * shares / np.maximum(size, 1)
            used = np.unique(present[self.weights[present] != 0])
            used = used[used > 0]
            weights = self.weights[used]
            own = np.where(np.isin(present, used), np.searchsorted(used, present), -1)  # place among those used
            live = np.flatnonzero((own >= 0).any(axis=1)[codes])
            rows, codes = rows[live], codes[live]
            step = max(1, (1 << 24) // max(len(used), 1))
            ends = np.searchsorted(rows, np.arange(0, n + step, step))
            for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                seen = np.zeros((min(step, n - k * step), len(used)), bool)
                for j in range(own.shape[1]):
                    place = own[codes[a:b], j]
                    there = place >= 0
                    seen[rows[a:b][there] - k * step, place[there]] = True
                r, f = np.divmod(np.flatnonzero(seen), max(len(used), 1))
                score[k * step : k * step + len(seen)] += np.bincount(r, weights=weights[f], minlength=len(seen))
        return _sigmoid(score[:, None] - self.thresholds)


def rated(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of about ``most`` rated texts, chosen by the hash of their ids.

    Several ratings of an id count as the worst of them, of several texts of an id the smallest is taken; null ratings,
    ids and texts are left out, a null ``toxic`` counts as 0. Rows come in the order of their ids.
    """
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    ratings = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_rated")).agg(F.min(grade).alias("grade"))
    chosen = sampled(ratings, ["_rated"], most, ratings.count())
    texts = docs.where("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("_rated")).groupBy("_rated").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    kind = texts.schema["_rated"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=STEP_BYTES):
            r, f, v, size = features(batch.column("text"))
            ends = np.searchsorted(r, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_rated"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(ends), pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.float32)))], names=["id", "grade", "f", "v"])

    table = texts.mapInArrow(run, f"id {kind}, grade int, f array<int>, v array<float>").toArrow().sort_by("id").combine_chunks()
    n = table.num_rows
    size = pc.list_value_length(table.column("f")).to_numpy().astype(np.int64) if n else np.zeros(0, np.int64)
    one = lambda c, t: np.asarray(pc.list_flatten(table.column(c))).astype(t) if n else np.zeros(0, t)
    return np.repeat(np.arange(n, dtype=np.int32), size), one("f", np.int32), one("v", np.float32), table.column("grade").to_numpy().astype(np.int64) if n else np.zeros(0, np.int64)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Ordinal:
    """The model of about ``most`` rated texts (a bound on the fit, not on what is scored)."""
    return Ordinal.fit(*rated(docs, labels, most))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 6000, accept: float = 0.5) -> DataFrame:
    """Every row's grade: (doc_id, expected_grade, p_above_0, p_above_1, accepted).

    A text is accepted if P(grade > 1) is at least ``accept``. Whole texts are scored, however long: features are whole
    words, the words' first 4 and 5 letters (stems), shares of the words' shapes and of repeated words; the fit leaves
    features out that are in less than 0.6 % of the rated texts, or in fewer than 3. A null text has null scores and
    isn't accepted; a text without words is graded by the thresholds alone. Rows come out one for one, null ids and
    repeated rows too, equal texts with equal scores; an empty table gives no rows. Ratings of one grade only give all
    texts that grade's share; without ratings no text is accepted. Other columns of docs and labels are not read,
    whatever their names. About ``most`` ratings are fitted on, chosen by the hash of their ids.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit_quality(own, labels.select("doc_id", "quality", "toxic"), most)
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=STEP_BYTES):
            p = sent.value.tails(batch.column("text"))
            none = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            cols = [pa.array(x, pa.float64(), mask=none) for x in (p.sum(axis=1), p[:, 0], p[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array((p[:, 1] >= accept) & ~none)], names=["doc_id", "expected_grade", "p_above_0", "p_above_1", "accepted"])

    return own.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_above_0 double, p_above_1 double, accepted boolean")


def quality_filter(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 6000, accept: float = 0.5) -> DataFrame:
    """The rows that quality_scores accepts, with all columns of the input, whatever their names; one pass, no shuffle of
    texts. Null texts go, null ids and repeated rows stay if their text is accepted; without ratings no row stays; an
    empty table gives no rows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = own.sparkSession.sparkContext.broadcast(fit_quality(own, labels.select("doc_id", "quality", "toxic"), most))

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        good: list[np.ndarray] = [np.zeros(0, bool)]
        for piece in byte_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), most=STEP_BYTES):
            column = piece.column("text")
            good.append((sent.value.tails(column)[:, 1] >= accept) & ~column.is_null().to_numpy(zero_copy_only=False))
        return pa.array(np.concatenate(good))

    return docs.where(accepted(docs[text]))
