"""Toxicity by class-conditional Kneser-Ney models.

Two byte n-gram models of order 5, one of toxic and one of ordinary text. Orders 3 to 5 hold the
counts of their own class (below the top, the number of different bytes that precede an n-gram);
orders 1 and 2 are counted over both classes together, so an expression that is rare in either falls
back to the same estimate and says nothing. Every n-gram of the sample counts, those seen once too. The
discount of an order is n1 / (n1 + 2 n2) of its n-grams counted once and twice. A text's score is the
difference of the two log-likelihoods for each byte, put on a probability scale by a logistic fit on
labelled texts, each scored by counts that leave out its fold of four.

Training reads a bounded sample of labelled rows (``TrainSize``, in rows and in bytes). What reaches the
driver is a table of distinct n-grams of that sample; what is broadcast is made of it. Scoring reads every
whole text.

Defined results: a null text is an empty one; an empty text has no bytes, so its difference is 0 and
its score is the intercept's. Repeated rows each get a row. A null doc_id is allowed and counts as
the empty text when folds are dealt. Without labels of both classes every score is the share of
toxic labels (0 without any). Other columns, whatever their names, are kept by ``apply_to``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, arrow, first_by_hash, fresh, id_crc, labels_of, parts, utf8

ORDER, SHARED, BITS = 5, 2, 8
CHUNK, FOLDS = 1 << 20, 4
#: A byte's symbol: itself in lower case; 0 for white space and for what precedes a text.
SYMBOL = np.where(SPACE, 0, LOWER)


@dataclass(frozen=True)
class TrainSize:
    """Bounds of the labelled sample: texts counted of each class, texts for the logistic fit, and bytes in all."""

    toxic: int = 3000
    ordinary: int = 6000
    fit: int = 4000
    bytes: int = 1 << 26


def codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the n-gram of ORDER symbols that it ends, the first in the top bits; a text is preceded by blanks."""
    x = SYMBOL[data].astype(np.int64)
    out = x.copy()
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER):
        back = np.zeros(len(x), np.int64)
        back[k:] = x[:-k]
        back[place < k] = 0
        out |= back << (BITS * k)
    return out


class Table:
    """Open addressing in flat arrays: keys to rows of values, read for whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # one key for each free slot and round, the others move on
            free = self.keys[slot[left]] == -1
            to, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[to], self.values[to] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there; absent ones have value 0."""
        slot = self.slot(keys)
        at = self.keys[slot]
        found = at == keys
        out = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (at != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[left]]
            hit = at == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (at != -1)]
        return out, found


@dataclass
class Model:
    """ratio[k]: log ratio of the classes for n-grams of order k seen in either; weight[k]: that of the back-off weights of contexts of k symbols."""

    ratio: dict[int, Table]
    weight: dict[int, Table]
    scale: float = 1.0
    shift: float = 0.0

    def of_bytes(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Each row's mean log ratio."""
        return np.concatenate([self._run(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in parts(off, CHUNK)]) if len(off) > 1 else np.zeros(0)

    def _run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        code = codes(data, off)
        total = np.zeros(len(code), np.float32)
        left = np.arange(len(code))
        for k in range(ORDER, SHARED, -1):
            own = code[left] & ((1 << BITS * k) - 1)
            got, found = self.ratio[k].get(own)
            total[left] += got
            left, own = left[~found], own[~found]
            if not len(left):
                break
            total[left] += self.weight[k - 1].get(own >> BITS)[0]
        sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
        return (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * mean + self.shift, -40, 40)))


def estimate(gram: np.ndarray, count: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order its n-grams, their probability in each class, contexts, and the back-off weights of each class.

    gram: sorted distinct n-grams of ORDER; count[c]: how often class c has each. Shared orders have one
    row for both classes.
    """
    keys = {ORDER: gram}
    tally = {ORDER: count.astype(np.float64)}
    for k in range(ORDER - 1, 0, -1):  # different symbols before an n-gram, for each class, or over both where shared
        low = keys[k + 1] & ((1 << BITS * k) - 1)
        keys[k], at = np.unique(low, return_inverse=True)
        if k == SHARED:  # distinct over both, counted once
            tally[k] = np.bincount(at, minlength=len(keys[k]))[None].astype(np.float64)
        else:
            tally[k] = np.stack([np.bincount(at, weights=x > 0, minlength=len(keys[k])) for x in tally[k + 1]])
    prob = np.full((1, 1), 1.0 / (1 << BITS))
    out = {}
    for k in range(1, ORDER + 1):
        n, of = tally[k], keys[k] >> BITS
        once, twice = (n == 1).sum(1, keepdims=True), (n == 2).sum(1, keepdims=True)
        discount = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.75)
        context, at = np.unique(of, return_inverse=True)
        total = np.stack([np.bincount(at, weights=x) for x in n])
        kinds = np.stack([np.bincount(at, weights=x > 0) for x in n])
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        low = np.zeros(len(of), np.int64) if k == 1 else np.searchsorted(keys[k - 1], keys[k] & ((1 << BITS * (k - 1)) - 1))
        prob = np.maximum(n - discount, 0) / np.maximum(total, 1)[:, at] + gamma[:, at] * prob[:, low]
        out[k] = keys[k], prob, context, gamma
    return out


def kneser_ney(gram: np.ndarray, count: np.ndarray) -> Model:
    """gram: sorted distinct n-grams of ORDER; count[c]: how often class c has each."""
    ratio, weight = {}, {}
    for k, (keys, prob, context, gamma) in estimate(gram, count).items():
        if k > SHARED:
            ratio[k] = Table(keys, np.log(prob[1] / prob[0]))
            weight[k - 1] = Table(context, np.log(gamma[1] / gamma[0]))
    return Model(ratio, weight)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Scale and shift of a logistic fit in one variable, by Newton's steps."""
    spread = float(x.std()) or 1.0
    z = np.stack([x / spread, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return float(w[0] / spread), float(w[1])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n-gram and class of the text, how often) in each chunk."""
    for batch in batches:
        data, off = utf8(batch.column(0))
        y = np.asarray(batch.column(1), dtype=np.int64)
        for a, b in parts(off, CHUNK):
            o = off[a : b + 1] - off[a]
            key, n = np.unique((codes(data[off[a] : off[b]], o) << 3) | np.repeat(y[a:b], np.diff(o)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["k", "n"])


def _sample(docs: DataFrame, known: DataFrame, size: TrainSize) -> DataFrame:
    """(text, y, fold, use, fit): the labelled texts to count (use) and to fit the scale on; copies of a text count once and stay in one fold."""
    counted = first_by_hash(known.where("y > 0"), size.toxic, 2).unionAll(first_by_hash(known.where("y <= 0"), size.ordinary, 2))
    plan = counted.withColumn("use", F.lit(1)).unionAll(first_by_hash(known, size.fit, 1).withColumn("use", F.lit(0)))
    plan = plan.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("use").alias("use"), (F.min("use") == 0).alias("fit"))
    # at most 13,000 rows by the bounds above
    rows = docs.select("doc_id", "text").join(F.broadcast(plan), "doc_id").where("text is not null")
    rows = rows.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("h2")).agg(F.first("text").alias("text"), F.max("y").alias("y"), F.max("use").alias("use"), F.max("fit").alias("fit"))
    return rows.select("h", "text", "y", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "use", "fit")


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: TrainSize = TrainSize()) -> Model | float:
    """learn: over doc_id, the rows whose labels may be learnt from. A number if one class is missing."""
    sc = docs.sparkSession.sparkContext
    known = labels_of(labels, "toxic").where(learn).withColumn("y", F.least("y", F.lit(1)))
    rows = _sample(docs, known, size).persist()
    try:
        long = rows.select("h", F.octet_length("text").alias("n")).toPandas().sort_values(["h", "n"])  # as many rows as the sample
        over = long.h[long.n.cumsum() > size.bytes]
        used = rows.where(F.col("h") < int(over.iloc[0])) if len(over) else rows
        part = [F.sum(F.when(F.col("k").bitwiseAND(F.lit(2 * FOLDS - 1)) == i, F.col("n"))).cast("int").alias(f"n{i}") for i in range(2 * FOLDS)]
        grams = arrow(used.where("use = 1").select("text", (F.col("fold") * 2 + F.col("y")).alias("y")), _partials, "k long, n long")
        grams = grams.groupBy(F.shiftright("k", 3).alias("gram")).agg(*part).toArrow()
        share = used.agg(F.avg("y")).first()[0] or 0.0
        gram = grams.column("gram").to_numpy()
        order = np.argsort(gram)
        gram = gram[order]
        seen_in = [grams.column(f"n{i}").fill_null(0).to_numpy().astype(np.float32)[order] for i in range(2 * FOLDS)]
        del grams, order

        def model_of(folds: list[int]) -> Model | None:
            count = np.stack([sum(seen_in[2 * k + c] for k in folds) for c in (0, 1)])
            there = count.any(0)
            return kneser_ney(gram[there], count[:, there]) if count.any(1).all() else None

        if not all(any(seen_in[2 * k + c].any() for k in range(FOLDS)) for c in (0, 1)):
            return float(share)
        mean, truth = [], []
        for k in range(FOLDS):  # each text is scored by counts that leave its fold out
            part_model = model_of([j for j in range(FOLDS) if j != k])
            if part_model is None:
                continue
            shared = sc.broadcast(part_model)
            got = arrow(used.where("fit").where(F.col("fold") == k).select("text", "y"), _scorer(shared, "mean", False, False), "y int, mean double").toPandas()
            shared.destroy()
            mean.append(got["mean"].to_numpy())
            truth.append(got.y.to_numpy(float))
        model = model_of(list(range(FOLDS)))
        if mean and len(np.unique(np.concatenate(truth))) == 2:
            model.scale, model.shift = logistic(np.concatenate(mean), np.concatenate(truth))
        return model
    finally:
        rows.unpersist()


def _scorer(shared, name: str, keep: bool, final: bool):
    """Adds a column of scores, final ones or mean log ratios, to all others; text comes first and goes unless it is to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            mean = model.of_bytes(*utf8(batch.column(0)))
            a = 0 if keep else 1
            yield pa.RecordBatch.from_arrays([*batch.columns[a:], pa.array(model.probability(mean) if final else mean, pa.float64())], [*batch.schema.names[a:], name])

    return run


def apply_to(docs: DataFrame, model: Model | float, score: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a column of P(toxic), which must not be there yet; without text if keep_text is False."""
    if isinstance(model, float):
        out = docs.withColumn(score, F.lit(model))
        return out if keep_text else out.drop("text")
    fields = [docs.schema["text"], *[f for f in docs.schema if f.name != "text"]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields if keep_text or f.name != "text"], f"`{score}` double"])
    out = arrow(docs.select(*[f"`{f.name}`" for f in fields]), _scorer(shared, score, keep_text, True), schema)
    return out.select(*[f"`{c}`" for c in docs.columns if keep_text or c != "text"], f"`{score}`")


def without_toxic(docs: DataFrame, model: Model | float, least: float = 0.7) -> DataFrame:
    """docs without the rows whose P(toxic) is least or more."""
    score = fresh(docs, "score")
    return apply_to(docs, model, score).where(F.col(score) < least).select(*[f"`{c}`" for c in docs.columns])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all of documents; see the module for the cases."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), F.pmod(id_crc("doc_id"), F.lit(3)) != 1)
    return apply_to(docs, model, keep_text=False).select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
