"""Shared pieces: tables, staging in the cluster's shared folder, hashing of words, components.

Everything that cuts lineage goes to the folder named by ``spark.checkpoint.dir`` as Parquet, so a
lost executor costs a re-read and never a recomputation of what led there.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

U64 = np.uint64
#: What an executor holds of texts at once: a batch between Spark and Python in bytes, one from Parquet in rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2097152b", "spark.sql.parquet.columnarReaderBatchSize": "512"}
_DEFAULTS = {"spark.sql.execution.arrow.maxBytesPerBatch": "67108864b", "spark.sql.parquet.columnarReaderBatchSize": "4096"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Hands freed memory back: workers are reused, and two of them share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a worker keeps from one task to the next, by name.
_kept: dict[str, object] = {}


def kept(name: str, make):
    """make(), or what it gave before in this worker; arrow() says which tasks keep it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget(name: str | None = None) -> None:
    """Lets go of all that this worker keeps but the one named."""
    gone = [_kept.pop(k) for k in list(_kept) if k != name]
    if gone:
        gone.clear()
        _trim()


def arrow(df: DataFrame, run, schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow where the workers are sure to know this package and give memory back after each partition.

    What other tasks left in the worker by kept(), but for the one named ``keeps``, goes first: workers outlive a query.
    """
    ship(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(trimmed, schema)


def small_batches(spark: SparkSession) -> None:
    """From now on the session moves rows in batches of BATCHES; a setting that is not Spark's default stays.

    Large batches of texts leave holes in the memory of the JVM, on its heap and beside it, that it does not give back.
    """
    for key, most in BATCHES.items():
        if spark.conf.get(key) == _DEFAULTS[key]:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; one of our own only where the session names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barweave-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from these files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*dfs: DataFrame) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    for df in dfs:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, y) per labelled document: nulls are no label, of repeated rows the largest."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def first_by_hash(df: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """A bounded sample of rows with doc_id: the n of smallest hash, the same at every partitioning."""
    return df.withColumn("_h", F.xxhash64(F.lit(salt), "doc_id")).orderBy("_h", "doc_id").limit(n).drop("_h")


# --- words and their hashes, whole batches at a time -------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW = np.ones(1, U64)
_BASE = U64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        _POW = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _BASE, U64))])
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row begins (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def parts(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row stands alone."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each maximal run of bytes other than ASCII white space: 64-bit hash, first byte, end, and row.

    off[0] must be 0 and off[-1] the number of bytes.
    """
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[off[:-1][off[:-1] < len(data)]] = True  # a row is a border too
    start = np.empty(len(data), bool)
    start[0] = True
    start[1:] = space[:-1]
    start |= begins
    start &= ~space
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.diff(np.append(s, len(data)))
    inside = np.arange(len(data) - s[0]) - np.repeat(s - s[0], run)
    x = (LOWER[data[s[0] :]] if lower else data[s[0] :]).astype(U64)
    x += U64(1)
    x *= _powers(int(run.max()))[inside]
    blank = space[s[0] :]
    x[blank] = 0
    h = np.add.reduceat(x, s - s[0])
    n = np.add.reduceat((~blank).astype(np.int64), s - s[0])
    row = np.searchsorted(off, s, "right") - 1
    return mix(h + n.astype(U64)), s, s + n, row


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (u, v): component is the smallest id reachable.

    Alternates large-star and small-star (Kiveris and others, 2014), which ends in O(log^2) rounds
    with no more edges than at the start. Each round is one aggregation and one join on a node, both
    of which Spark splits when a hub is hot; nothing about the graph reaches the driver but two sums.
    """
    now = staged(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = staged(small, label)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count(F.when(F.col("u") < F.col("v"), 1))).first()
        unstage(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
