"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors form a class first; classes alone go on, each with its number of rows. Every tree splits
recursively along random directions, near the median of a bounded sample and where the sample leaves
the widest gap, and what lies within a margin of a split goes to both sides (spill). Rows of a leaf are
compared with each other and the pairs of cosine ``least`` or more united; a leaf sends on one edge for
each row, to the smallest id it is united with there, never its pairs. Leaves beyond ``LEAF_CAP`` rows
are compared block by block, all blocks with all, so no pair of a leaf is left out.

Links are then counted within each component, again in blocks: every pair of classes of a component is
verified, those that no leaf held together too.

What is fitted on the sample are split points only; every row is indexed. Trees have at most
2^MAX_DEPTH leaves, which bounds what is broadcast (split points, and blocks of the large leaves).

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without
an id, link with nothing; such a row is its own component and kept. Vectors of different lengths are
compared as if the shorter ended in zeros. Repeated rows are vectors of their own. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow, components, read, staged
from .search import matrix, usable

TREES, LEAF, LEAF_CAP, MAX_DEPTH, MARGIN, SAMPLE = 14, 256, 2048, 14, 0.012, 20_000


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, width: int, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.way = rng.standard_normal((trees, width, max(1, depth)))
        self.way /= np.maximum(np.linalg.norm(self.way, axis=1, keepdims=True), 1e-12)
        self.cut = np.zeros((trees, (1 << depth) - 1 or 1))
        for t in range(trees):
            p = sample @ self.way[t]
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                order = np.lexsort((p[:, level], node))
                ends = np.searchsorted(node[order], np.arange(first, first + (1 << level) + 1))
                for k in range(1 << level):
                    v = p[order[ends[k] : ends[k + 1]], level]
                    if len(v) < 2:  # nothing to go by: the parent's rows were few, any split will do
                        self.cut[t, first + k] = v[0] if len(v) else 0.0
                        continue
                    a, b = int(len(v) * 0.4), max(int(len(v) * 0.4) + 2, int(len(v) * 0.6) + 1)
                    mid = v[a:b] if b - a >= 2 and len(v[a:b]) >= 2 else v
                    g = int(np.argmax(np.diff(mid)))
                    self.cut[t, first + k] = (mid[g] + mid[g + 1]) / 2
                node = 2 * node + 1 + (p[:, level] >= self.cut[t, node])

    def leaves(self, x: np.ndarray, t: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for tree t, a row more than once where it spills."""
        p = x @ self.way[t]
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            d = p[row, level] - self.cut[t, node]
            low, high = d < margin, d >= -margin
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
        return row, node


def unit(column, width: int) -> np.ndarray:
    x = matrix(column, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fold(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest node of its component in the graph of edges (a, b)."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _pairs(x: np.ndarray, y: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of cosine least or more, in strips; within x (i < j) if y is None."""
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ (x if y is None else y).T >= least
        i, j = np.nonzero(s)
        i = i + at
        if y is None:
            i, j = i[i < j], j[i < j]
        yield i, j


def _unite(width: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        ids, blk = t.column("id").to_numpy(), t.column("blk").to_numpy()
        order = np.lexsort((ids, blk))
        ids, blk = ids[order], blk[order]
        x = unit(t.column("embedding"), width)[order]
        if len(ids) and blk[0] != blk[-1]:
            k = int(np.searchsorted(blk, blk[-1]))
            got = [(i, j + k) for i, j in _pairs(x[:k], x[k:], least)]
        else:
            got = list(_pairs(x, None, least))
        i, j = (np.concatenate([g[z] for g in got]) if got else np.zeros(0, np.int64) for z in (0, 1))
        by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # so that the smallest node is the smallest id
        lab = _fold(len(ids), by_id[i], by_id[j])
        s = np.sort(ids)
        u = np.flatnonzero(lab != np.arange(len(ids)))
        return pa.table({"u": pa.array(s[u], pa.int64()), "v": pa.array(s[lab[u]], pa.int64())})

    return run


def _count(width: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        ids, blk, comp, n = (t.column(c).to_numpy() for c in ("id", "blk", "component", "n"))
        x = unit(t.column("embedding"), width)
        links = np.zeros(len(ids), np.int64)
        order = np.lexsort((blk, comp))
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1) if len(ids) else []:
            b = blk[part]
            cross = b[0] != b[-1]
            k = int(np.searchsorted(b, b[-1])) if cross else 0
            for i, j in _pairs(x[part[:k]], x[part[k:]], least) if cross else _pairs(x[part], None, least):
                j = j + k
                links += np.bincount(part[i], weights=n[part[j]], minlength=len(ids)).astype(np.int64)
                links += np.bincount(part[j], weights=n[part[i]], minlength=len(ids)).astype(np.int64)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links)})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = F.col("vec_id").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("h", F.when(ok, F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.hex(F.xxhash64(x)))), 256)))
    reps = staged(rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vector-classes")
    total, width = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = width or 1
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, total) / LEAF)))))
    sample = reps.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    forest = Forest(unit(sample.column("embedding"), width) if sample.num_rows else np.zeros((0, width)), depth, width)
    shared = spark.sparkContext.broadcast(forest)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros((TREES, 1 << (depth + 1)), np.int64)
        for batch in batches:
            x = unit(batch.column(0), width)
            for t in range(TREES):
                many[t] += np.bincount(shared.value.leaves(x, t, MARGIN)[1], minlength=many.shape[1])
        t, leaf = np.nonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), pa.array(many[t, leaf])], ["t", "leaf", "n"])

    large = arrow(reps.select("embedding"), counts, "t int, leaf int, n long").groupBy("t", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > LEAF_CAP).toPandas()  # at most TREES x 2^MAX_DEPTH
    blocks = {(int(t), int(leaf)): -(-int(n) // (LEAF_CAP // 2)) for t, leaf, n in zip(large.t, large.leaf, large.n, strict=True)}
    shared_blocks = spark.sparkContext.broadcast(blocks)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(1), width)
            ids = batch.column(0).to_numpy()
            for t in range(TREES):
                row, leaf = shared.value.leaves(x, t, MARGIN)
                more = [[], [], [], [], []]
                k = np.array([shared_blocks.value.get((t, int(z)), 1) for z in leaf], np.int64) if shared_blocks.value else np.ones(len(leaf), np.int64)
                own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
                at = np.repeat(np.arange(len(row)), k)  # with each block of its leaf, its own included
                other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                mine = own[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t), pa.int32()), pa.array(leaf[at], pa.int32()), pa.array(np.minimum(mine, other), pa.int32()), pa.array(np.maximum(mine, other), pa.int32()), pa.array(mine, pa.int32()), pa.array(ids[row[at]], pa.int64()), batch.column(1).take(pa.array(row[at]))],
                    ["t", "leaf", "i", "j", "blk", "id", "embedding"],
                )

    kind = reps.schema["embedding"].dataType.simpleString()
    routed = arrow(reps.select("id", "embedding"), route, f"t int, leaf int, i int, j int, blk int, id long, embedding {kind}")
    edges = routed.groupBy("t", "leaf", "i", "j").applyInArrow(_unite(width, least), "u long, v long").distinct()
    comp = staged(components(edges, "vector-cc"), "vector-components")

    linked = reps.join(comp, "id")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    k = F.ceil(F.col("size") / F.lit(LEAF_CAP // 2)).cast("int")
    small = F.col("size") <= LEAF_CAP // 2
    buckets = max(1, total // LEAF_CAP)
    dealt = (
        linked.join(sizes, "component")
        .withColumn("k", F.when(small, F.lit(1)).otherwise(k))
        .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("bucket", F.when(small, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.lit(buckets) + F.col("component")))
        .withColumn("i", F.least("blk", "other"))
        .withColumn("j", F.greatest("blk", "other"))
    )
    links = dealt.select("bucket", "i", "j", "id", "blk", "component", "n", "embedding").groupBy("bucket", "i", "j").applyInArrow(_count(width, least), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    classes = reps.select("h", "id", "n").join(comp, "id", "left").join(links, "id", "left").select("h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "h").join(classes, "h", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_vector_neardup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all of embeddings; see the module for the cases."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
