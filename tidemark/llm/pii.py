"""Personal data by weak supervision.

Loose patterns propose spans; regex, checksum, gazetteer, context and boundary labelers vote on each. The votes of all
spans, counted by kind and pattern, go to an expectation-maximisation that estimates how reliable each labeler is for
each kind; its posteriors are the soft labels of a logistic classifier on hashed features of spans, which decides.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import byte_slices, gathered
from .shared import written

KINDS = ("SECRET", "KEY", "EMAIL", "IP", "IBAN", "CARD", "SSN", "PHONE", "NAME")
LABELERS = ("regex", "checksum", "gazetteer", "context", "boundary")
HASHED = 1 << 12
#: Text bytes that are searched at a time.
STEP_BYTES = 4 << 20
_TITLES = r"(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora|Señor)"
#: What the proposals look like; of overlapping spans the first kind's counts.
PROPOSALS = (
    ("SECRET", re.compile(r"""(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([^\s"'<>]{6,})""")),
    ("KEY", re.compile(r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16}|ASIA(?=[A-Z]*\d)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])([0-9a-fA-F]{32,})(?![A-Za-z0-9])")),
    ("EMAIL", re.compile(r"(?<![\w.+-])([\w.+%-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("IP", re.compile(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("CARD", re.compile(r"(?<![\d.,])(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d|[.,]\d)")),
    ("SSN", re.compile(r"(?<![\d-])(\d{3}[- ]\d{2}[- ]\d{4})(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w+(.])((?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-]?){1,3}\d{2,4}|\+\d{8,14})(?![\w])")),
    ("NAME", re.compile(_TITLES + r"\.? ([A-ZÀ-Þ][^\W\d_]+(?: [A-ZÀ-Þ][^\W\d_]+)?)")),
)
_DIGIT = re.compile(r"\d")
_ASSIGNED = re.compile(r"[:=]")


def _worth(text: str) -> list[bool]:
    """Which of PROPOSALS can match at all, by characters that each match of them has."""
    digit = _DIGIT.search(text) is not None
    key = "AKIA" in text or "ASIA" in text or "sk-" in text or "xox" in text or "_" in text
    return [_ASSIGNED.search(text) is not None, key, True, "@" in text, digit and "." in text, digit, digit, digit, digit, True]


_STRICT = {
    "SECRET": re.compile(r"(?=.*\d)[\w+/=.-]{8,}"),
    "KEY": re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"),
    "EMAIL": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "IP": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}"),
    "IBAN": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4})+"),
    "CARD": re.compile(r"\d{13,19}|(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}"),
    "SSN": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "PHONE": re.compile(r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"),
    "NAME": re.compile(r"[^\W\d_]{2,}(?: [^\W\d_]{2,})?"),
}
_CARD_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|3[0568]")
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai dev app de fr es uk us ca au at ch it nl be pt br mx ar cl co pl se no dk fi ru cn jp kr in eu test example invalid".split())
_GIVEN_NAMES = frozenset("james john robert michael william david mary patricia jennifer linda elizabeth barbara susan anna maria peter hans klaus jürgen thomas andreas sabine monika pierre jean marie michel claire juan josé carlos luis carmen ana laura antonio pablo sofia".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
_NEAR = {
    "SECRET": re.compile(r"(?i)pass|pwd|secret|token|key|credential"),
    "KEY": re.compile(r"(?i)key|token|aws|secret|credential|access"),
    "EMAIL": re.compile(r"(?i)mail|contact|write|schreib|correo|@|from|to:"),
    "IP": re.compile(r"(?i)\bip\b|address|host|server|ping|adres"),
    "IBAN": re.compile(r"(?i)iban|konto|account|bank|compte|cuenta"),
    "CARD": re.compile(r"(?i)card|visa|master|amex|karte|carte|tarjeta|credit"),
    "SSN": re.compile(r"(?i)ssn|social|security"),
    "PHONE": re.compile(r"(?i)phone|tel|call|fax|mobile|handy|anruf|appel|llam"),
    "NAME": re.compile(r"(?i)name|dear|from|sign|by|nom|nombre"),
}
_AGAINST = re.compile(r"(?i)(?:version|\bv|isbn|issn|doi|page|pages|figure|fig\.|table|section|§|no\.|nr\.|total|sum|price|[$€£])\s*$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def votes(kind: str, value: str, before: str, after: str) -> str:
    """One of + - 0 for each labeler."""
    digits = re.sub(r"\D", "", value) if kind in ("CARD", "PHONE", "SSN") else ""
    regex = "+" if _STRICT[kind].fullmatch(value) else "-"
    check = "0"
    if kind == "CARD":
        check = "+" if _luhn(digits) else "0"
    elif kind == "IP":
        check = "+" if all(int(x) < 256 for x in value.split(".")) else "-"
    elif kind == "EMAIL":
        name, _, host = value.rpartition("@")
        check = "-" if ".." in value or host[:1] in "-." or len(name) > 64 else "+"
    elif kind == "IBAN":
        plain = value.replace(" ", "")
        check = "+" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "-"
    elif kind in ("SECRET", "KEY"):
        check = "+" if _entropy(value) >= 2.5 and any(c.isdigit() for c in value) else "-"
    elif kind == "PHONE":
        check = "+" if 9 <= len(digits) <= 15 else "-" if len(digits) < 7 else "0"
    elif kind == "SSN":
        check = "-" if digits[:3] in ("000", "666") or digits[0] == "9" else "0"
    known = "0"
    if kind == "CARD":
        known = "+" if _CARD_ISSUERS.match(digits) else "-"
    elif kind == "EMAIL":
        known = "+" if value.rpartition(".")[2].lower() in _TOP_LEVEL else "0"
    elif kind == "IP":
        known = "-" if value.split(".")[0] in ("0", "255") or value == "127.0.0.1" else "0"
    elif kind == "PHONE":
        known = "+" if value[0] == "+" and any(digits[:k] in _CODES for k in (1, 2, 3)) else "0"
    elif kind == "KEY":
        known = "+"
    elif kind == "NAME":
        known = "+" if value.split()[0].lower() in _GIVEN_NAMES else "0"
    elif kind == "SECRET":
        known = "+" if _NEAR["SECRET"].search(before[-24:]) else "0"
    context = "-" if _AGAINST.search(before) else "+" if _NEAR[kind].search(before) or kind == "EMAIL" and "@" in value else "0"
    closed = (not before or not (before[-1].isalnum() or before[-1] in "_/.,") or kind == "NAME") and (not after or not (after[0].isalnum() or after[0] in "_/%"))
    return regex + check + known + context + ("+" if closed else "-")


def _collapsed(value: str) -> str:
    out = re.sub(r"\d+", lambda m: "9" * min(len(m[0]), 4), value)
    return re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", out)[:24]


def span_features(kind: str, value: str, before: str, after: str, pattern: str) -> list[int]:
    last = re.findall(r"[^\W\d_]+", before[-24:])
    parts = [kind, f"{kind}|{_collapsed(value)}", f"{kind}|{len(value).bit_length()}", f"{kind}<{before[-1:]}", f"{kind}>{after[:1]}"]
    parts += [f"{kind}|{name}{v}" for name, v in zip(LABELERS, pattern)]
    if last and _NEAR[kind].search(last[-1]):
        parts.append(f"{kind}~{last[-1].lower()}")
    return sorted({xxhash.xxh32_intdigest(p) % HASHED for p in parts})


def proposed(text: str) -> list[tuple[int, int, str]]:
    """Spans that don't overlap, by the order of PROPOSALS."""
    taken: list[tuple[int, int, str]] = []
    for (kind, pattern), worth in zip(PROPOSALS, _worth(text)):
        for m in pattern.finditer(text) if worth else ():
            a, b = m.span(1)
            if kind == "CARD" or kind == "IBAN":
                b = a + len(text[a:b].rstrip(" -"))
            if kind == "SECRET":
                b = a + max(1, len(text[a:b].rstrip(".,;:!?)]}#$%&*")))
            k = bisect.bisect(taken, (a,))
            if not (k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b):
                taken.insert(k, (a, b, kind))
    return taken


def spans(column: pa.Array) -> Iterator[tuple[int, int, int, str, str, list[int]]]:
    """(row, first character, end, kind, votes, features) of every proposal in the whole texts, in order."""
    for row, text in enumerate(column.to_pylist()):
        for x, y, kind in proposed(text) if text else ():
            before, after = text[max(0, x - 48) : x], text[y : y + 4]
            pattern = votes(kind, text[x:y], before, after)
            yield row, x, y, kind, pattern, span_features(kind, text[x:y], before, after, pattern)


def posteriors(counts: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that spans of a kind with a pattern of votes are what the kind says, by expectation-maximisation.

    Per kind, labelers are independent given the truth; pseudo-counts say that a labeler is right more often than not.
    """
    out: dict[tuple[str, str], float] = {}
    by_kind: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (kind, pattern), n in sorted(counts.items()):
        by_kind[kind].append((pattern, n))
    sign = {"+": 0, "0": 1, "-": 2}
    for kind, rows in by_kind.items():
        v = np.array([[sign[c] for c in p] for p, _ in rows])
        n = np.array([m for _, m in rows], float)
        score = (v == 0).sum(axis=1) - (v == 2).sum(axis=1)
        q = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
        for _ in range(rounds):
            prior = ((n * q).sum() + 2) / (n.sum() + 4)
            log = np.log(prior) - np.log1p(-prior) + np.zeros(len(rows))
            for k in range(v.shape[1]):
                yes = np.array([4.0, 2.0, 1.0]) + np.bincount(v[:, k], weights=n * q, minlength=3)
                no = np.array([1.0, 2.0, 4.0]) + np.bincount(v[:, k], weights=n * (1 - q), minlength=3)
                log += np.log(yes / yes.sum())[v[:, k]] - np.log(no / no.sum())[v[:, k]]
            q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        out |= {(kind, p): float(x) for (p, _), x in zip(rows, q)}
    return out


def fit_spans(feats: list[list[int]], soft: list[float], weight: list[float], steps: int = 200, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier on hashed features (the last weight is the constant); ``weight`` says how many
    spans each stands for."""
    w = np.zeros(HASHED + 1)
    w[-1] = 0.5
    if not feats:
        return w
    size = np.array([len(f) for f in feats])
    rows, flat = np.repeat(np.arange(len(feats)), size), np.concatenate([np.array(f, np.int64) for f in feats])
    y, each = np.array(soft), np.array(weight) / np.sum(weight)
    speed = np.full(len(w), 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(rows, weights=w[flat], minlength=len(y)) + w[-1])))
        off = (p - y) * each
        g = np.append(np.bincount(flat, weights=off[rows], minlength=HASHED), off.sum()) + l2 * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    return w


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, votes, features) of all proposals in (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, most=STEP_BYTES):
            found = list(spans(batch.column("text")))
            r, a, b, k, v, f = zip(*found) if found else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(v, pa.string()), pa.array(f, pa.list_(pa.int32()))], names=["doc_id", "start", "end", "kind", "votes", "features"])

    return docs.mapInArrow(run, f"doc_id {kind}, start int, end int, kind string, votes string, features array<int>")


def shares(counts: dict[tuple[str, str], int], most: int) -> dict[tuple[str, str], float]:
    """Which share of each kind and pattern of votes to fit on: rare ones whole, of the others as many each as ``most`` allows."""
    left, groups, out = most, sorted(counts.items(), key=lambda x: (x[1], x[0])), {}
    for k, (group, n) in enumerate(groups):
        taken = min(n, left / (len(groups) - k))
        out[group] = taken / n
        left -= taken
    return out


def trained(found: DataFrame, most: int) -> np.ndarray:
    """The span classifier: reliabilities from the votes of all proposals, weights from about ``most`` of them, by hash
    within each kind and pattern of votes, each weighing as many as it stands for."""
    counts = {(r.kind, r.votes): r["count"] for r in found.groupBy("kind", "votes").count().collect()}
    truth, share = posteriors(counts), shares(counts, most)
    rates = found.sparkSession.createDataFrame([(*g, int(x * (1 << 62))) for g, x in share.items()], "r_kind string, r_votes string, below long")
    here = (F.col("kind") == F.col("r_kind")) & (F.col("votes") == F.col("r_votes")) & (F.xxhash64("doc_id", "start", "end").bitwiseAND((1 << 62) - 1) < F.col("below"))
    sample = sorted(found.join(F.broadcast(rates), here).select("kind", "votes", "features").collect())
    there: dict[tuple[str, str], int] = defaultdict(int)
    for r in sample:
        there[r.kind, r.votes] += 1
    return fit_spans([r.features for r in sample], [truth[r.kind, r.votes] for r in sample], [counts[r.kind, r.votes] / there[r.kind, r.votes] for r in sample])


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 20000, accept: float = 0.5) -> DataFrame:
    """Personal data in whole texts: (doc_id, start, end, kind, probability), one row for each span that is accepted.

    ``start`` and ``end`` count characters. Patterns match in whole texts of any length; of overlapping proposals the
    first kind's counts, then the earlier one. Labelers see a proposal with 48 characters before it and 4 after. The
    votes of all proposals are used; the classifier is fitted on about ``most`` of them, every kind and pattern of votes
    among them. Null and empty texts have no spans; a null id is kept as such; repeated rows give their spans once each.
    Other columns of the input are not read, whatever their names; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(proposals(own))
    w = trained(found, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([_probability(w, f) for f in batch.column("features").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "end", "kind")), pa.array(p, pa.float64())], names=["doc_id", "start", "end", "kind", "probability"])

    scored = found.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, start int, end int, kind string, probability double")
    return scored.where(F.col("probability") >= accept)


def _probability(w: np.ndarray, feats: list[int]) -> float:
    return 1 / (1 + math.exp(-(float(w[feats].sum()) + float(w[-1]))))


def redacted(column: pa.Array, w: np.ndarray, accept: float) -> list[str | None]:
    """The texts with every accepted span replaced by its kind in angle brackets."""
    texts = column.to_pylist()
    by_row: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for row, a, b, kind, _, feats in spans(column):
        if _probability(w, feats) >= accept:
            by_row[row].append((a, b, kind))
    for row, own in by_row.items():
        text, out, at = texts[row], [], 0
        for a, b, kind in own:
            out += [text[at:a], f"<{kind}>"]
            at = b
        texts[row] = "".join([*out, text[at:]])
    return texts


def pii_redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", most: int = 20000, accept: float = 0.5) -> DataFrame:
    """All rows and columns of the input, with the spans of pii_spans replaced in the text by <KIND>, and the column
    ``length``, if there is one, set to the new number of characters where the text was changed. Rows are not joined
    or moved: the classifier goes to them. Null and empty texts, null ids and repeated rows stay as they are; columns may
    have any names; an empty table gives no rows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    w = trained(written(proposals(own)), most)
    sent = own.sparkSession.sparkContext.broadcast(w)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for piece in byte_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), most=STEP_BYTES):
            out += redacted(piece.column("text"), sent.value, accept)
        return pa.array(out, pa.string())

    cleaned = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)], clean(docs[text]).alias("_clean"))
    out = []
    for i, c in enumerate(docs.columns):
        if c.lower() == text.lower():
            out.append(F.col("_clean").alias(c))
        elif length is not None and c.lower() == length.lower():
            old = F.col(f"_c{i}")
            where = next(j for j, x in enumerate(docs.columns) if x.lower() == text.lower())
            out.append(F.when(F.col("_clean") != F.col(f"_c{where}"), F.char_length("_clean").cast(docs.schema[i].dataType)).otherwise(old).alias(c))
        else:
            out.append(F.col(f"_c{i}").alias(c))
    return cleaned.select(*out)
