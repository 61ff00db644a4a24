"""Quality by supervised subword embeddings.

A text is the bag of its words, of all pairs of neighbouring words and of the 3- and 4-grams of code points in
words (with their borders), each hashed to a row of one table of vectors; pairs of a word with itself share a row besides, as
hashing tells nothing of a word that was never seen repeated. Its vector is their average, and a softmax over two classes
stands on it; table and softmax are learnt together by stochastic gradient descent in numpy, on a
bounded sample of labelled texts (``TrainSize``, in texts and bytes). Case and marks are kept: they tell junk from prose.

The softmax is linear in the average, so scoring needs one number for each row of the table, the
difference of the two classes' logits; whole texts are scored by hashing and one gather.

Defined results: a null text is an empty one; a text without features has the score of the biases.
Repeated rows each get a row, and of several texts with one id the smallest is learnt from; a null doc_id
counts as the empty text when folds are dealt. With labels
of one class only (or none) every score is that class's share (0.5 without labels). Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, arrow, first_by_hash, id_crc, labels_of, mix, parts, read, utf8, word_hashes

BITS, WIDTH, GRAMS = 18, 12, (3, 4)
CHUNK = 1 << 22
PAIR = U64(0x9E3779B97F4A7C15)  # odd, so that a pair and its reverse differ


@dataclass(frozen=True)
class TrainSize:
    """texts, bytes: labelled texts at most, and bytes of them together; the rest steers the descent."""

    texts: int = 4000
    bytes: int = 64 << 20
    epochs: int = 12
    batch: int = 16
    rate: float = 0.4
    seed: int = 17


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and n-gram, in no order; off[0] is 0."""
    h, _, _, row = word_hashes(data, off, lower=False)
    bucket, rows = [(h >> U64(64 - BITS)).astype(np.int32)], [row.astype(np.int32)]
    pair = np.flatnonzero(row[1:] == row[:-1])
    again = pair[h[pair] == h[pair + 1]]  # a word that is the one before it: one more feature, whatever the word
    bucket += [(mix(h[pair] * PAIR + h[pair + 1]) >> U64(64 - BITS)).astype(np.int32), np.full(len(again), 0, np.int32)]
    rows += [row[pair].astype(np.int32), row[again].astype(np.int32)]
    # code points, one number each: the bytes that continue one are put to the byte that leads it
    lead = (data & 0xC0) != 0x80
    lead[off[:-1][np.diff(off) > 0]] = True  # no row continues the one before it
    at = np.flatnonzero(lead)
    x = data[at].astype(np.uint32)
    run = np.diff(np.append(at, len(data)))
    for j in range(1, int(run.max(initial=1))):
        more = np.flatnonzero(run > j)
        x[more] = x[more] << np.uint32(6) | (data[at[more] + j] & 0x3F)
    # a blank before and after each row marks borders of words at its ends
    n = np.diff(np.searchsorted(at, off))
    pad = np.full(len(x) + 2 * len(n), 32, np.uint32)
    pad[np.arange(len(x)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = x
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
    space = SPACE[np.minimum(pad, 255)]
    x = np.where(space, 1, pad + 2).astype(np.uint32)
    for k in GRAMS:
        m = len(pad) - k + 1
        if m <= 0:
            continue
        code = np.full(m, k, np.uint32)
        inner = np.zeros(m, bool)
        for j in range(k):
            code = code * np.uint32(0x01000193) ^ x[j : j + m] * np.uint32(0x9E3779B1)
            if 0 < j < k - 1:
                inner |= space[j : j + m]
        ok = ~inner & (owner[:m] == owner[k - 1 :]) & ~(space[:m] & space[k - 1 :])
        code = code[ok]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        bucket.append((code >> np.uint32(32 - BITS)).astype(np.int32))
        rows.append(owner[:m][ok])
    return np.concatenate(bucket), np.concatenate(rows)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def of_bytes(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = []
        for a, b in parts(off, CHUNK):
            bucket, row = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            total = np.bincount(row, weights=self.weight[bucket], minlength=b - a)
            out.append(total / np.maximum(np.bincount(row, minlength=b - a), 1))
        z = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different buckets and their shares."""
    for batch in batches:
        data, off = utf8(batch.column(0))
        y = np.asarray(batch.column(1), dtype=np.int32)
        for a, b in parts(off, CHUNK):
            bucket, row = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            key, n = np.unique((row.astype(np.int64) << 32) | bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << 32)
            total = np.bincount(key >> 32, weights=n, minlength=b - a)
            share = (n / total[key >> 32]).astype(np.float32) if len(n) else n.astype(np.float32)
            ids = (key & 0xFFFFFFFF).astype(np.int32)
            cut = [(ids[i:j].tobytes(), share[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), pa.array(y[a:b])], ["ids", "share", "y"])


def descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: TrainSize) -> Model:
    """Stochastic gradient descent on the softmax loss, in small batches, with a rate that falls to nothing."""
    rng = np.random.default_rng(size.seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out = np.zeros((2, WIDTH), np.float32)
    bias = np.log(np.maximum(np.bincount(y, minlength=2), 1) / len(y)).astype(np.float32)
    steps, done = size.epochs * -(-len(bags) // size.batch), 0
    for _ in range(size.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), size.batch):
            rate = np.float32(size.rate * (1 - done / steps))
            done += 1
            pick = [i for i in order[at : at + size.batch] if len(bags[i][0])]
            if not pick:
                continue
            ids = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])
            start = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in pick])])
            mean = np.add.reduceat(table[ids] * share[:, None], start[:-1], axis=0)
            logit = mean @ out.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = np.repeat(p @ out, np.diff(start), axis=0)
            # as for a mean of few features: the step of a row is not divided by how often it occurs
            scale = np.repeat(1 / np.sqrt(np.add.reduceat(share**2, start[:-1])), np.diff(start))
            out -= rate * (p.T @ mean)
            bias -= rate * p.mean(0)
            np.subtract.at(table, ids, rate * back * (share * scale)[:, None])
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: TrainSize = TrainSize()) -> Model:
    """learn: over doc_id, the rows whose labels may be learnt from."""
    known = first_by_hash(labels_of(labels, "quality").where(learn).withColumn("y", F.least("y", F.lit(1))), size.texts)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).persist()  # at most size.texts rows
    try:
        long = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).toPandas().sort_values(["h", "doc_id"])
        over = long.h[long.n.cumsum() > size.bytes]
        used = rows.where(F.xxhash64("doc_id") < int(over.iloc[0])) if len(over) else rows
        got = arrow(used.select("text", "y"), _bags, "ids binary, share binary, y int").toArrow()
    finally:
        rows.unpersist()
    y = np.asarray(got.column("y"), dtype=np.int64)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for i, s in zip(got.column("ids").to_pylist(), got.column("share").to_pylist(), strict=True)]
    order = sorted(range(len(bags)), key=lambda i: (bags[i][0].tobytes(), y[i]))  # the same however rows were dealt
    return descend([bags[i] for i in order], y[order], size)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.of_bytes(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def apply_to(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs, score the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), _scorer(shared), f"doc_id {kind}, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all of documents; see the module for the cases."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(id_crc("doc_id"), F.lit(5))
    model = train(docs, read(spark, sf_dir, "labels"), fold != 0)
    return apply_to(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
