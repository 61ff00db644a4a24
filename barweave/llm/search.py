"""Exact top-k search by inner product, by MaxScore over shards of postings.

A term is a component; its posting in a shard holds the rows where the query's weight times the value is
most. A query's terms are split by their bounds: the weakest ones, which together can't lift a row over
the score to beat, are non-essential. Rows of the essential terms' postings are traversed; where values lie
so densely that rows outside all postings could still win, a posting is its whole shard. The terms are
then probed strongest first, and after every few of them the rows go that the bounds of the terms left
keep below the score to beat: the sum of the terms' largest products, and the product of the two vectors'
norms over these terms. The score to beat starts with the best of the strongest postings and rises once
the most promising rows are scored in full. The shards' best are merged by rank.

Queries meet shards in blocks of both, so that a task holds a bounded number of each.

Defined results: vectors null or holding null or non-finite components take no part, nor do rows without
an id. Every other row is a candidate, and a query where its id is one, rows of one id too; a query's own row
alone is no candidate for it. Vectors of different lengths are compared as if the shorter ended in zeros.
Ties go to the smaller id. An empty table gives no rows. Scores are exact as long as they fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import read, staged

SHARD, BLOCK, POSTING, STEP = 32_768, 16_384, 5, 8


def usable(col: str) -> Column:
    """Not null, and every component a finite number."""
    return F.coalesce(F.col(col).isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones with zeros at the end."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


class Shard:
    """Candidates with a posting for each term: the POSTING-th part of the rows with most, either way."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")  # rows by id: among equal scores the first is the smallest
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.own = self.ids if own is None else own[order]
        self.terms = np.ascontiguousarray(self.x.T)
        self.energy = (self.x.astype(np.float64) ** 2).sum(1)
        n = len(ids)
        depth = max(1, n // POSTING)
        rank = np.argsort(self.x, axis=0, kind="stable")
        value = np.take_along_axis(self.x, rank, 0)
        # for a positive weight the largest values, for a negative one the smallest
        self.best = {1: rank[::-1][:depth].T.copy(), -1: rank[:depth].T.copy()}
        self.most = {1: value[-1], -1: value[0]}
        self.base = {1: value[max(0, n - depth - 1)], -1: value[min(n - 1, depth)]}
        #: Products worked out, and rows scored in full, over all queries so far.
        self.products = self.full = 0

    def _score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.products += len(rows) * len(q)
        self.full += len(rows)
        return self.x[rows] @ q

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows but the one whose number is own, best first."""
        sign = np.where(q >= 0, 1, -1)
        up = q * np.where(sign > 0, self.most[1], self.most[-1])
        base = q * np.where(sign > 0, self.base[1], self.base[-1])
        strong = np.argsort(-np.abs(up - base), kind="stable")
        seeds = np.unique(np.concatenate([self.best[sign[d]][d][:4] for d in strong[:STEP]]))
        bar = self._beat(seeds[self.own[seeds] != own], q, k, -np.inf)
        # non-essential: the weakest terms, as many as leave a row outside all essential postings below the bar
        weak = strong[::-1]
        bound = base.sum() + np.cumsum((up - base)[weak])
        free = int(np.searchsorted(bound, bar, "left")) if base.sum() < bar else 0
        rows = None  # all of them
        if base.sum() < bar:
            hit = np.zeros(len(self.ids), bool)
            for d in weak[free:]:
                hit[self.best[sign[d]][d]] = True
            rows = np.flatnonzero(hit)
        score, energy = 0, self.energy if rows is None else self.energy[rows]
        left, norm, raised = float(up.sum()), float((q.astype(np.float64) ** 2).sum()), False
        for at in range(0, len(q), STEP):
            some = strong[at : at + STEP]
            x = self.terms[some] if rows is None else self.terms[some[:, None], rows]
            rows = np.arange(len(self.ids)) if rows is None else rows
            self.products += x.size
            score = score + q[some] @ x
            energy = energy - np.einsum("ij,ij->j", x, x, dtype=np.float64)
            left -= float(up[some].sum())
            norm -= float((q[some].astype(np.float64) ** 2).sum())
            if not raised and 2 * norm <= (q.astype(np.float64) ** 2).sum():  # the most promising rows tell what there is to beat
                likely = rows[np.argpartition(-score, min(4 * k, len(rows) - 1))[: 4 * k]] if len(rows) else rows
                bar, raised = self._beat(likely[self.own[likely] != own], q, k, bar), True
            far = np.sqrt(np.maximum(energy, 0) * max(norm, 0)) * (1 + 1e-9) + 1
            keep = score + np.minimum(left, far) >= bar
            rows, score, energy = rows[keep], score[keep], energy[keep]
        self.full += len(rows)
        keep = self.own[rows] != own
        rows, score = rows[keep], score[keep]
        if len(rows) > k:
            at_least = np.partition(score, len(rows) - k)[len(rows) - k]
            keep = score >= at_least
            rows, score = rows[keep], score[keep]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]

    def _beat(self, rows: np.ndarray, q: np.ndarray, k: int, bar: float) -> float:
        """The k-th best score of some rows, or bar if that is more."""
        return max(bar, np.partition(self._score(rows, q), len(rows) - k)[len(rows) - k]) if len(rows) >= k else bar


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all rows of vectors (vec_id, embedding) but its own."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = staged(rows.withColumn("u", F.monotonically_increasing_id()), "vectors")  # written down: a row's number stays
    queries = rows.where(is_query)
    n, m, width = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("embedding"))).first()
    shards, blocks, width = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK)), width or 0
    left = rows.withColumn("s", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("weights"), F.col("u").alias("row"))
    right = right.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            x, q = np.floor(scale * matrix(a.column("embedding"), width)), np.floor(scale * matrix(b.column("weights"), width))
            if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, width) >= 2**53:
                x, q = x.astype(np.int64), q.astype(np.int64)  # slower, exact beyond what doubles hold
            shard = Shard(a.column("vec_id").to_numpy(), x, a.column("u").to_numpy())
            for own, name, v in zip(b.column("row").to_numpy(), b.column("query_id").to_numpy(), q, strict=True):
                ids, score = shard.top(own, v, k)
                found.append((np.full(len(ids), own, np.int64), np.full(len(ids), name, np.int64), ids, score.astype(np.int64)))
        got = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("u", "query_id", "vec_id", "score"), got, strict=True)})

    best = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, "u long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op2_maxscore(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of embeddings: queries are the ids divisible by 50; see the module for the cases."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256.0)


OP2_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.u <> c.u WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
