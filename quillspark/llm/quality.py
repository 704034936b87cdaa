"""Quality scores from supervised subword embeddings, trained by stochastic gradient descent in NumPy.

A text's features are its words and the character n-grams of its words, marked at both ends, hashed into a table of learned
vectors. Two features have vectors of their own: a word that repeats the one before it, and the end, which every text has. A
text's vector is the mean over its features, and a softmax layer gives the probability of label 1. Vectors and layer are
learned one text at a time, with a rate that falls to zero.

Labelled rows are few, at most `SAMPLE`: their features are counted where the texts lie, and one task learns from the counts.
Scoring is one map over whole texts, in pieces that end between words. Since the layers are linear up to the softmax, each
feature's vector folds into one number, and the model that is broadcast has a fixed size, BUCKETS numbers of four bytes.

Defined results: null and empty texts, and those of white space alone, are scored by the end alone. Without labelled rows every
score is 0.5. Rows labelled more than once count with their greatest label, repeated identifiers with their least text; null
labels and identifiers are not learned from. Repeated rows are scored one by one; equal texts have equal scores. Columns of
any names pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quillspark.llm.common import fresh, materialize, table
from quillspark.llm.vectors import mix, slices_of

U = np.uint64
SAMPLE = 4000  # labelled rows that are learned from, by the hash of their identifiers
BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4, 5)
STEPS, EPOCHS, RATE, SEED = 16_000, 20, 0.2, 11  # steps, and how often a row is seen at most
PIECE = 1 << 18  # characters whose features are made at once
_BASE = U(0x9E3779B97F4A7C15)
GAP = re.compile(r"\s")


class Model(NamedTuple):
    """Each feature's part of the logit, and what the layer adds."""

    weight: np.ndarray
    bias: float


def pieces(text: str | None) -> Iterator[str]:
    """A text in pieces of about PIECE characters that end at white space."""
    at, text = 0, text or ""
    while len(text) - at > PIECE:
        gap = GAP.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, the text of each): words, n-grams of words, and 1 for a word like the one before it; the end, 0, is not among them."""
    parts = [" ".join(t.split()) for t in texts]
    a = np.frombuffer(f" {' '.join(parts)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    owner = np.repeat(np.arange(len(parts)), np.array([len(p) + 1 for p in parts]))  # of each place after the first space
    gap = a == U(32)
    gaps = np.cumsum(gap)
    found, whose = [], []
    h = a
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _BASE + a[n - 1 :]
        if n in GRAMS:
            start = np.flatnonzero(inside(gaps, n))
            found.append(mix(h[start] ^ U(n)))
            whose.append(owner[start])
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if len(first):
        size = np.diff(np.append(first, len(a)))
        place = np.arange(first[0], len(a)) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()), _BASE, U))
        letters = np.where(gap[first[0] :], U(0), mix(a[first[0] :] + U(1)) * power[place])
        words = mix(np.add.reduceat(letters, first - first[0]))
        of = owner[first - 1]
        again = of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])]
        found.append(words)
        whose += [of, again]
        ids = np.append((np.concatenate(found) % U(BUCKETS - 2)).astype(np.int64) + 2, np.ones(len(again), np.int64))
        return ids, np.concatenate(whose)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def inside(gaps: np.ndarray, n: int) -> np.ndarray:
    """Whether the n characters from each place on hold no space but at their ends."""
    most = max(len(gaps) - n + 1, 0)
    return gaps[n - 2 : n - 2 + most] == gaps[:most]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, their shares) of a whole text, each feature once."""
    total = np.zeros(BUCKETS, np.int64)
    total[0] = 1
    for piece in pieces(text):
        total += np.bincount(features([piece])[0], minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, (total[ids] / total.sum()).astype(np.float32)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Vectors and softmax layer of (features, shares, label) rows, one row at a time, in an order of their own each epoch."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = min(EPOCHS, -(-STEPS // len(rows)))
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, shares, label = rows[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = shares @ vectors[ids]
            out = layer @ hidden + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            bias -= rate * p
            vectors[ids] -= np.outer(shares * (rate / float(shares @ shares)), back)  # a step of one length for short and long texts
    way = layer[1] - layer[0]
    return Model(vectors @ way, float(bias[1] - bias[0]))


def fold(docs_col: str = "doc_id"):
    """Whether a row is held out; identifiers that are null are not."""
    return F.coalesce(F.crc32(F.col(docs_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, quality) of at most `sample` labelled identifiers outside the held-out fold."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~fold()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # bounded by `sample`
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most `sample` labelled rows: features where the texts lie, then one task that learns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, marks in slices_of(b):
                found = [counted(t) for t in texts]
                columns = [pa.array(ids, pa.int64()), pa.array([x.astype(np.uint16).tobytes() for x, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()), pa.array([int(m > 0) for m in marks], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "shares", "label"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for i, ids, shares, label in zip(*(c.to_pylist() for c in b.columns)):
                held.append((i, np.frombuffer(ids, np.uint16), np.frombuffer(shares, np.float32), label))
        model = learn([(ids.astype(np.int64), shares, label) for _, ids, shares, label in sorted(held, key=lambda x: x[0])])
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weight", "bias"])

    rows = training(docs, labels, sample).mapInArrow(count, "doc_id long, ids binary, shares binary, label int")
    rows = materialize(rows, "quality-train", 200).repartition(1)  # `sample` rows of at most BUCKETS features
    found = rows.mapInArrow(train, "weight binary, bias double").collect()  # one row
    return Model(np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]) if found else learn([])


def score_batch(texts: list[str | None], model: Model) -> list[float]:
    """Probabilities of label 1, of some texts."""
    total, n = np.full(len(texts), float(model.weight[0])), np.ones(len(texts))
    held, whose, size = [], [], 0

    def add() -> None:
        ids, owner = features(held)
        of = np.array(whose)[owner] if len(owner) else owner
        np.add(total, np.bincount(of, model.weight[ids], len(texts)), out=total)
        np.add(n, np.bincount(of, minlength=len(texts)), out=n)

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            whose.append(i)
            size += len(piece)
            if size >= PIECE:
                add()
                held, whose, size = [], [], 0
    if held:
        add()
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in (total / n + model.bias).tolist()]


def score_texts(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with their scores in a last column `name`; where a column has that name in any case, see `fresh`."""
    name, text = fresh(docs, name), docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [s for (texts,) in slices_of(b.select([text])) for s in score_batch(texts, held.value)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(scored, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
