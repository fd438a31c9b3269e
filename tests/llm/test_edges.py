"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, chat, dac, exact, fingerprint, licenses, packing, pii, quality, simhash

LONG = "Lorem ipsum dolor sit amet consectetur " * 30_000
CLASHING = ("_row", "_id", "_text", "_h", "_digest", "_winner", "keeper_id", "is_duplicate", "bin_id", "start", "length", "size", "salt", "rank", "fp", "digest", "canon", "group_id", "kind", "votes", "features", "_clean", "_c0", "c0", "_lost_id", "spans", "key", "node", "token_ids", "codes", "accepted", "_rated", "grade", "place", "gram", "template", "count")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
BODY = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, None),
    (None, None),
    (None, "a text without an id, mail to ann.lee@mail.example.com please"),
    (4, ""),
    (5, ""),
    (6, " \n\t "),
    (7, LONG),
    (8, LONG),
    (9, "Ünïcödé 日本語 😀 Released under the MIT License."),
]


def rows():
    return [(i, t, None if i == 1 else "en", None if i == 2 else "s", None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t in BODY]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (2, None, 0, "x"), (None, 1, 1, "x"), (7, 1, None, "x"), (9, 0, 0, "x"), (99, 1, 1, "x")], "doc_id bigint, quality int, toxic int, grade string")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ALL = sorted((i for i, _ in BODY), key=lambda x: (x is None, x))


def test_packing(docs, nothing):
    out = packing.best_fit_packing(docs, capacity=100_000).collect()
    assert {r.doc_id for r in out} == {i for i, _ in BODY}
    assert sum(r.length for r in out) == sum(len((t or "").encode()) for _, t in BODY)
    assert all((r.bin_id is None) == (r.length == 0) for r in out)
    assert sum(r.length == 0 for r in out) == 4
    fill = {}
    for r in sorted((r for r in out if r.length), key=lambda r: (r.bin_id, r.bin_offset)):
        assert fill.get(r.bin_id, 0) == r.bin_offset
        fill[r.bin_id] = r.bin_offset + r.length
    assert max(fill.values()) <= 100_000
    assert packing.best_fit_packing(nothing).collect() == []


def test_licenses(docs, nothing):
    assert [(r.doc_id, r.license) for r in licenses.license_spans(docs).collect()] == [(9, "MIT")]
    assert licenses.license_spans(nothing).collect() == []


def test_token_codes(docs, nothing):
    out = dac.token_codes(docs).collect()
    assert ids(dac.token_codes(docs)) == ALL
    for r in out:
        assert (r.codes is None) == (r.n_tokens is None)
        if r.codes is not None:
            assert dac.dac_length(bytes(r.codes)) == r.n_tokens
    assert sum(r.codes is None for r in out) == 2 and sum(r.n_tokens == 0 for r in out) == 2
    assert dac.token_codes(nothing).collect() == []


def test_bpe(docs, nothing):
    enc = bpe.bpe_encode(docs)
    assert ids(enc) == ALL
    assert all(r.round_trip is (None if r.token_ids is None else True) for r in enc.collect())
    back = bpe.bpe_decode(enc)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(BODY, key=repr)
    assert bpe.bpe_encode(nothing).collect() == []


def test_near(docs, nothing):
    out = simhash.near_duplicates(docs)
    assert ids(out) == ALL
    got = {r.doc_id: (r.keeper_id, r.is_duplicate) for r in out.collect() if r.doc_id is not None}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False), 6: (6, False), 7: (7, False), 8: (7, True), 9: (9, False)}
    assert not any(r.is_duplicate for r in out.collect() if r.doc_id is None)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 4, 5, 6, 7, 9, None, None]
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.near_dedup(nothing).collect() == []


@pytest.mark.parametrize("copies", [2, 32])
def test_exact(docs, nothing, copies):
    out = exact.exact_duplicates(docs, copies=copies).collect()
    assert sorted(r.doc_id for r in out if r.is_duplicate) == [2, 2, 5, 8]
    assert {r.doc_id: r.keeper_id for r in out if r.doc_id is not None} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    kept = exact.exact_dedup(docs, copies=copies)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 4, 6, 7, 9, None, None]
    assert exact.exact_duplicates(nothing).collect() == [] and exact.exact_dedup(nothing).collect() == []


def test_exact_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(5, "same", "a")] * 3 + [(5, "same", "b")], "doc_id bigint, text string, lang string")
    for copies in (2, 32):
        assert exact.exact_dedup(df, copies=copies).count() == exact.exact_dedup(df, copies=copies, most_sent=0).count() == 1
        assert sum(r.is_duplicate for r in exact.exact_duplicates(df, copies=copies).collect()) == 3


def test_pii(docs, nothing):
    out = pii.pii_spans(docs).collect()
    assert [(r.doc_id, r.kind) for r in out] == [(None, "EMAIL")]
    clean = pii.pii_redact(docs)
    assert clean.columns == docs.columns and ids(clean) == ALL
    texts = {r.text for r in clean.collect()}
    assert "a text without an id, mail to <EMAIL> please" in texts and LONG in texts and None in texts
    changed = [r for r in clean.collect() if r.text and "<EMAIL>" in r.text]
    assert changed[0].n_chars == len(changed[0].text)
    assert pii.pii_spans(nothing).collect() == [] and pii.pii_redact(nothing).collect() == []


def test_quality(spark, docs, nothing, labels):
    out = quality.quality_scores(docs, labels)
    assert ids(out) == ALL
    for r in out.collect():
        assert r.p_above_0 is None or 0 <= r.p_above_1 <= r.p_above_0 <= 1
    assert not any(r.accepted for r in out.collect() if r.p_above_0 is None)
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(out.where("accepted"))
    assert quality.quality_scores(nothing, labels).collect() == []
    none = labels.where("false")
    assert not any(r.accepted for r in quality.quality_scores(docs, none).collect()) and quality.quality_filter(docs, none).collect() == []


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, n_turns string, formatted string"
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 1, None, None), (2, None, "user", ""), (2, 0, "user", LONG), (3, 0, "system", "é😀")]
    df = spark.createDataFrame([(*t, "x", "x") for t in turns], schema)
    got = {r.conv_id: (r.n_turns, r.formatted) for r in chat.chat_format(df).collect()}
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {
        1: (3, one("user", "a") + one("assistant", "b") * 2), None: (2, one("user", "x") + one("user", "")), 2: (2, one("user", "") + one("user", LONG)), 3: (1, one("system", "é😀")),
    }
    assert chat.chat_format(df.where("false")).collect() == []


def test_fingerprints(docs, nothing):
    out = fingerprint.document_fingerprints(docs)
    assert ids(out) == ALL
    rows_ = [r for r in out.collect()]
    assert {r.doc_id: r.group_id for r in rows_ if r.doc_id is not None} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9}
    assert sum(r.fingerprint is None for r in rows_) == 2
    assert ids(fingerprint.document_fingerprints(docs, most_sent=0)) == ALL
    assert fingerprint.document_fingerprints(nothing).collect() == []


def test_stages(spark, docs, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, nothing, str(tmp_path)).collect() == []


def test_repeated_word_hashes_are_stable():
    assert np.array_equal(simhash.permutation(3), simhash.permutation.__wrapped__(3))
