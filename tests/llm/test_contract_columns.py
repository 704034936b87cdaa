"""The registered queries on a small folder: every column that their contracts name, against plain versions."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from test_operators import ROWS, covered, plain_pii, shingle_set, words

from quillspark.llm import lm_score, ngram_join, pii, suffix_dedup, toxicity

PAIR = ("abcdefghijklmnop", "x220hrqb|]:z/:9,")  # alike for a hash that chains pieces of eight bytes
EXTRA = [
    (100, f"{PAIR[0]} b c d e f {PAIR[1]} b c d e"), (101, PAIR[0]), (102, f"{PAIR[1]} {PAIR[0]}"), (103, "mail ann@example.org, call +49 30 1234567 or 10.0.0.1, pay 4111 1111 1111 1111"),
    (104, "no 4111-1111-1111-1112, 999.1.1.1, +12"), (105, "tel (020) 7946-0123, kim (at) uni (dot) org"),
]
DOCS = [(i, t, "en", "s", 1) for i, t in [*ROWS, *EXTRA]]


def crc(i):
    return zlib.crc32(str(i).encode())


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i, *_ in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_op1_columns(spark, sf):
    got = {r.doc_id: r for r in ngram_join.op1_ngram_join(spark, sf).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingle_set(t)) for i, t, *_ in DOCS} and got[100].n_shingles == 7


def test_op2_columns(spark, sf):
    out = toxicity.op2_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in DOCS)
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in out)


def test_op5_columns(spark, sf, monkeypatch):
    monkeypatch.setattr(pii, "trained", lambda spark, docs: ([], dict.fromkeys(pii.KINDS, 2.0)))  # no added spans: base and spans are alike
    for r in pii.op5_pii(spark, sf).collect():
        spans = plain_pii(dict((i, t) for i, t, *_ in DOCS)[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.base_sha256, r.spans) == (sha(listed.encode()), listed)
        n = Counter(k for k, *_ in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [n[k] for k in pii.KINDS]


def test_op7_columns(spark, sf):
    held = {i: crc(i) % 7 == 2 for i, *_ in DOCS}
    end = object()
    tokens = {i: [*words(t), end] for i, t, *_ in DOCS}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, v = counts.total(), len(counts)
    got = {r.doc_id: r for r in lm_score.op7_lm_scoring(spark, sf).collect()}
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and math.isfinite(got[i].score)


def test_crafted_words_stay_apart(spark):
    """Trained on one word of the pair, the model doesn't know the other."""
    d = spark.createDataFrame([(1, PAIR[0], True), (2, PAIR[1], False), (3, PAIR[0], False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in lm_score.score(d, d.train).collect()}
    assert (got[2].n_known, got[3].n_known) == (1, 2) and got[2].base_score < got[3].base_score


def test_op9_columns(spark, sf):
    rows = [(i, t) for i, t, *_ in DOCS]
    gone = covered(rows, 200)
    got = {r.doc_id: r for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        b, out = (t or "").encode(), set(gone[i])
        runs = sum(k in out and k - 1 not in out for k in range(len(b)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(out), runs, sha(bytes(x for k, x in enumerate(b) if k not in out)))
