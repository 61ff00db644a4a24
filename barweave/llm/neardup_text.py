"""Near-duplicate texts by BagMinHash.

A text is the multiset of its shingles, runs of five words in lower case (all its words, if fewer). For
each shingle Poisson processes run over its weight: one over each of the unit intervals [0,1), [1,2),
then [2,4), [4,8) and so on, which are halved again and again, each half keeping the points that fall
in it, down to unit intervals; halves above the weight are left out. A point has a time and one of the signature's components; the
component keeps its earliest time. Two texts agree in a component as often as the shares of their
multisets overlap (weighted Jaccard), and nearly all points of heavy or many shingles are never drawn,
because they come later than every component's time.

Components form bands; texts that agree in a band are candidates. Equal texts are one class first.
Candidates are compared with one text of their band's bucket, then, across components only, with each
other (in a large bucket block by block, without listing pairs), so that of the links in a bucket none
is lost; each comparison counts the exact overlap of the two multisets. Nothing about all documents reaches the driver but a bitmap of fixed size, which
tells the second scan which texts to send on.

Defined results: null and empty texts, and such of white space only, have no shingles and resemble
nothing, not even each other. Rows without an id are neither compared nor returned. Of rows with one id
the texts all count; the id's component is the smallest of them. Texts of any length are read whole. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow, components, mix, parts, read, small_batches, staged, unstage, utf8, word_hashes

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 20, 5
FEW, BLOCK = 32, 192
BITMAP = 26  # bits of an id's hash: 8 MB
CHUNK = 1 << 19


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle, by row; off[0] is 0."""
    h, _, _, row = word_hashes(data, off)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    out = h.copy()
    left = n[row] - (np.arange(len(h)) - first[row])  # words from here to the row's end
    for k in range(1, words):
        nxt = np.zeros(len(h), U64)
        nxt[: len(h) - k] = h[k:]
        out = np.where(left > k, mix(out * U64(0x9E3779B97F4A7C15) + nxt), out)
    keep = (left >= words) | ((n[row] < words) & (left == n[row]))
    return out[keep], row[keep]


def counted(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, key) with how often each occurs, by row and key."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return key[at], row[at], np.diff(np.append(at, len(key)))


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _slot(seed: np.ndarray, size: int) -> np.ndarray:
    return (mix(seed ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(33)).astype(np.int64) % size


def bag_minhash(key: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """rows x size times; a row without elements has infinite ones."""
    sign = np.full(rows * size, np.inf)
    top = np.full(rows, np.inf)
    # processes over [0,1), [1,2), [2,4), ... up to the weight; a longer one goes on only by its halves, the same
    # ones whatever the weight, so that a point below two weights is the same for both
    seed, own, low, high = [], [], [], []
    a, b = 0, 1
    left = np.arange(len(key))
    while len(left):
        seed.append(mix(key[left] + U64(a * 0xD6E8FEB86659FD93 & (1 << 64) - 1) + U64(b)))
        own.append(left)
        low.append(np.full(len(left), a, np.int64))
        high.append(np.full(len(left), b, np.int64))
        left = left[weight[left] > b]
        a, b = b, 2 * b
    seed, own, low, high = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seed, U64), (own, np.int64), (low, np.int64), (high, np.int64)))
    time = -np.log(_uniform(mix(seed))) / (high - low)
    slot = _slot(seed, size)
    while len(seed):
        r = row[own]
        unit = high - low == 1  # all of these lie below the weight
        np.minimum.at(sign, (r * size + slot)[unit], time[unit])
        seen = np.unique(r[unit])
        top[seen] = sign.reshape(rows, size)[seen].max(1)
        # a unit interval's next point
        s1 = mix(seed[unit] + U64(0x632BE59BD9B4E019))
        nxt = [(s1, own[unit], low[unit], high[unit], time[unit] - np.log(_uniform(mix(s1))), _slot(s1, size))]
        if not unit.all():  # halve: the pending point falls in one half, the other waits for its own
            s, o, lo, hi, t, k = (x[~unit] for x in (seed, own, low, high, time, slot))
            mid = (lo + hi) // 2
            in_low = (mix(s ^ U64(0x5555555555555555)) >> U64(63)) == 0
            for c0, c1, here, keep in ((lo, mid, in_low, np.ones(len(s), bool)), (mid, hi, ~in_low, mid < weight[o])):
                sc = mix(s + U64(3) * c0.astype(U64) + U64(0x2545F4914F6CDD1D) * c1.astype(U64))
                tc = np.where(here, t, t - np.log(_uniform(mix(sc))) / (c1 - c0))
                nxt.append((sc[keep], o[keep], c0[keep], c1[keep], tc[keep], np.where(here, k, _slot(sc, size))[keep]))
        seed, own, low, high, time, slot = (np.concatenate([x[i] for x in nxt]) for i in range(6))
        alive = time < top[row[own]]
        seed, own, low, high, time, slot = (x[alive] for x in (seed, own, low, high, time, slot))
    return sign.reshape(rows, size)


def band_keys(sign: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(sign).view(U64).reshape(len(sign), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for a, b in parts(off, CHUNK):
            o = off[a : b + 1] - off[a]
            own = data[off[a] : off[b]]
            key, row, weight = counted(*shingles(own, o), b - a)
            n = np.bincount(row, weights=weight, minlength=b - a).astype(np.int64)
            keys = band_keys(bag_minhash(key, row, weight, b - a)).view(np.int64)
            raw = own.tobytes()
            sha = [hashlib.blake2b(raw[o[i] : o[i + 1]], digest_size=16).digest() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sha, pa.binary()), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel()))],
                ["id", "sha", "n", "bands"],
            )


def _multisets(bitmap):
    """Of the rows whose id may be wanted: the sorted hashes of (shingle, its how-manieth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            pos = batch.column(2).to_numpy()
            take = np.flatnonzero(bits[pos >> 3] >> (pos & 7) & 1)
            if not len(take):
                continue
            batch = batch.take(pa.array(take))
            data, off = utf8(batch.column(1))
            for a, b in parts(off, CHUNK):
                key, row, weight = counted(*shingles(data[off[a] : off[b]], off[a : b + 1] - off[a]), b - a)
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                full, row = mix(np.repeat(key, weight) + nth.astype(U64) * U64(0xD6E8FEB86659FD93)), np.repeat(row, weight)
                order = np.lexsort((full, row))
                full, ends = full[order], np.searchsorted(row[order], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([full[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "bag"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                z = np.concatenate([np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                ok[i] = both >= least * (len(z) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok))

    return run


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each of x has in common with each of y: a product of two 0/1 matrices, some columns at a time."""
    common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)

    def cells(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        col = np.searchsorted(common, flat := np.concatenate(bags))
        hit = (col < len(common)) & (common[np.minimum(col, len(common) - 1)] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (rx, cx), (ry, cy) = cells(x), cells(y)
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), 4096):
        m = []
        for r, c, n in ((rx, cx, len(x)), (ry, cy, len(y))):
            a, b = np.searchsorted(c, [at, at + 4096])
            part = np.zeros((n, min(4096, len(common) - at)), np.float32)
            part[r[a:b], c[a:b] - at] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out


def _across(least: float):
    """Links between components within a block, or between two blocks, of one bucket; one for each two components."""

    def run(t: pa.Table) -> pa.Table:
        key, blk, ids, n, comp = (t.column(c).to_numpy() for c in ("key", "blk", "id", "n", "c"))
        bags = [np.frombuffer(b.as_buffer(), U64) for b in t.column("bag")]
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        first, last = np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max())
        got = []
        for at in range(0, len(first), BLOCK):
            for to in range(0, len(last), BLOCK):
                a, b = first[at : at + BLOCK], last[to : to + BLOCK]
                # once for each two texts: in the first band that they share
                same = bands[a][:, None, :] == bands[b][None, :, :]
                here = (np.take_along_axis(bands[a], same.argmax(2), 1) == key[0]) & (comp[a][:, None] != comp[b][None, :])
                if here.any():
                    both = _overlaps([bags[i] for i in a], [bags[i] for i in b])
                    i, j = np.nonzero(here & (both >= least * (n[a][:, None] + n[b][None, :] - both)))
                    got += [(ids[a[p]], ids[b[q]]) for p, q in {(comp[a[p]], comp[b[q]]): (p, q) for p, q in zip(i, j, strict=True)}.values()]
        return pa.table({"u": pa.array([x for x, _ in got], pa.int64()), "v": pa.array([y for _, y in got], pa.int64())})

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Which hash values of ids occur: 2^BITMAP bits, however many ids."""
    pos = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP)) + 1  # Spark's buckets of 32,768 bits count from 1
    rows = ids.select(pos.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for b, m in rows:
        at = (b - 1) * 4096
        out[at : at + len(m)] = np.frombuffer(bytes(m), np.uint8)
    return out


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, component_id) for each row of docs (doc_id, text) with an id.

    class_id: the smallest id of the same text; component_id: the smallest reachable by texts of which
    each resembles the next by least or more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    made = staged(arrow(rows, _signatures, "id long, sha binary, n long, bands array<long>"), "signatures")
    classes = staged(made.groupBy("sha").agg(F.min("id").alias("id")), "text-classes")
    # a row for each class: of rows with the same text and id, one
    reps = made.where("n > 0").join(classes, ["sha", "id"], "left_semi").dropDuplicates(["sha", "id"])
    member = staged(reps.select("id", "n", F.explode("bands").alias("key")), "bands")

    def bags_of(ids: DataFrame) -> DataFrame:
        """(id, bag) of the ids, which are written down already; the second scan sends on few other texts."""
        bits = spark.sparkContext.broadcast(_bitmap(ids))
        bags = arrow(rows.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP)).alias("p")), _multisets(bits), "id long, bag binary")
        return staged(bags.join(ids.distinct(), "id", "left_semi"), "bags")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (u, v), written down already, those of similarity least or more."""
        bags = bags_of(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))))
        both = pairs.join(bags.select(F.col("id").alias("u"), F.col("bag").alias("a")), "u").join(bags.select(F.col("id").alias("v"), F.col("bag").alias("b")), "v")
        out = staged(arrow(both.select("u", "v", "a", "b"), _verify(least), "u long, v long"), "links")
        unstage(bags)
        return out

    near = (F.col("n") >= F.col("m") * least) & (F.col("m") >= F.col("n") * least)
    # first with one text of each bucket: that whose own buckets hold most, which copies of it share with it
    full = member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = staged(member.join(full, "key"), "shared")  # only rows that share a bucket go on
    known = shared.groupBy("id").agg(F.sum("c").alias("w"))
    best = shared.join(known, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("v"), "n")).alias("s")).select("key", (-F.col("s.v")).alias("v"), F.col("s.n").alias("m"))
    best = staged(best, "buckets")
    star = shared.join(best, "key").where((F.col("id") != F.col("v")) & near)
    star = staged(star.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct(), "pairs")
    links = verified(star)
    comp = staged(components(links, "text-cc"), "components")
    # then, where a bucket still holds several components, across them: pair by pair where it is small,
    # and block by block, without listing pairs, where it is large
    placed = shared.select("key", "id", "n").join(comp.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("key", "size")
    split = staged(placed.join(mixed, "key"), "split")
    few = split.where(F.col("size") <= FEW)
    other = few.select("key", F.col("id").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"))
    across = few.join(other, "key").where((F.col("id") > F.col("v")) & (F.col("c") != F.col("d")) & near)
    across = staged(across.select(F.col("id").alias("u"), "v").distinct().join(star, ["u", "v"], "left_anti"), "across")
    more = verified(across)
    many = split.where(F.col("size") > FEW)
    bags = bags_of(many.select("id"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = many.join(bags, "id").join(reps.select("id", "bands"), "id").withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "id", "n", "c", "bands", "bag")
    most = staged(dealt.groupBy("key", "i", "j").applyInArrow(_across(least), "u long, v long").distinct(), "links")
    comp = staged(components(links.unionAll(more).unionAll(most), "text-cc"), "components")
    unstage(member, shared, best, split, star, across, bags, links, more, most)
    rep = classes.select("sha", F.col("id").alias("class_id"))
    out = made.select("id", "sha", "n").join(rep, "sha").join(comp.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    nothing = F.col("n") == 0
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(nothing, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(nothing, F.col("id")).otherwise(F.coalesce("component", "class_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those whose component has a smaller id; rows without an id stay."""
    found = near_duplicates(docs, least)
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("c < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


def op10_bagminhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, component_id, kept of all of documents; see the module for the cases."""
    return near_duplicates(read(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
