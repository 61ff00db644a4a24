"""Best-fit packing by exact-complement hashing.

Documents become token ids and an end mark; only those longer than a sequence are cut, into full
pieces and one shorter rest. Which pieces share a sequence depends on lengths alone, so the plan is
made on the driver from one number for each length (at most ``capacity`` of them, however many
documents there are): longest first, the gap is looked up in an index of sums of one, two and three
lengths (``Sums``), and a combination that fills it exactly is used as often as its counts allow; what no
combination completes goes to the open sequence where it leaves least room. Pieces of one length are
interchangeable, so each takes the place of its rank among them.

Ranks come from counts of (length, salt) with the salt drawn from the document's id, more salts the more
pieces there are: a length that a third of all pieces share is ranked in many tasks. The table of pieces is written to the shared
folder first, so ranks can't change when an executor is lost.

Defined results: a null or empty text is the end mark alone, one piece of length 1. Repeated rows and
null ids are packed like others. No documents give no pieces. Texts of any length are cut whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow, kept, read, staged, utf8

CAPACITY, END = 2048, 0
SALTS, EACH = (64, 2048), 1 << 20  # salts at least and at most; pieces a salt would hold if all had one length
MEMO, GROUP, MARKS = 900_000, 1 << 21, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Byte-level coders write bytes as letters: printable Latin-1 as itself, the others from U+0100 on in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """The ids of words in little-endian 32-bit numbers, worked out when first met and kept for MEMO words at most."""

    def __init__(self, coder):
        self.coder, self.merges = coder, coder.model

    def __missing__(self, w: bytes) -> bytes:
        base = w.rstrip(MARKS)
        if base is not w and base and len(base) < len(w) and b"<|" not in w and (base[-1] < 128 and base[-1:].isalnum() or base[-1] >= 128 and base.decode("utf-8", "replace")[-1].isalpha()):
            ids = self[base] + self[w[len(base) :]]  # a tail of ASCII marks is a token sequence of its own
        else:
            s = w.decode("utf-8", "replace")
            if s.isalpha() and s.islower() and (s.isascii() or max(s) < "\u0250" and is_normalized("NFC", s)):
                # one run of lower-case Latin letters: nothing to normalise or to split before the merges
                ids = array("I", [t.id for t in self.merges.tokenize(s if s.isascii() else "".join(map(BYTE.__getitem__, w)))]).tobytes()
            else:
                ids = array("I", self.coder.encode(s, add_special_tokens=False).ids).tobytes()
        if len(self) < MEMO:
            self[w] = ids
        return ids


def _coder(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(path))


def encode(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, as the tokenizer in path gives them without special tokens.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words
    one after another; it lower-cases, so words are met in lower case (but where the text of a special
    token could appear).
    """
    get = kept(path, lambda: _coder(path)).__getitem__
    for t in texts:
        yield b"".join(map(get, (t if b"<|" in t else t.lower()).split()))


def _pieces(path: str, capacity: int):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = data.tobytes()
            rows, piece, start, length, crc = [], [], [], [], []
            at = 0
            while at < len(off) - 1:
                to = max(at + 1, int(np.searchsorted(off, off[at] + GROUP, "right")) - 1)
                for i, ids in enumerate(encode([raw[off[k] : off[k + 1]] for k in range(at, to)], path), at):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        rows.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), _pieces(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", keeps=path)


class Sums:
    """The index of sums below the capacity: which one, two or three of the lengths there are make each.

    left, which the owner lowers, says how many there are of each length. Counts never rise, so a
    combination that has run out is taken from the index for good. Sums of three are kept as their largest
    part and the sum of the other two, which is looked up in turn: all parts listed would be some 10^8.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        n = len(left)
        have = np.flatnonzero(left > 0).astype(np.int32)
        have = have[have > 0][::-1]  # combinations stand longest part first
        even = np.full(n, n, np.int32)  # the larger part of the most even pair of each sum
        self.pairs: list[np.ndarray] = []
        for s in range(n):
            a = have[(have < s) & (2 * have >= s)]
            a = a[left[s - a] > 0]
            self.pairs.append(a)
            if len(a):
                even[s] = a[-1]
        self.triples = [a[even[s - a] <= a] for s, a in ((s, have[have < s]) for s in range(n))]

    def _alive(self, s: int) -> np.ndarray:
        a = self.pairs[s]
        return a[(self.left[a] > 0) & (self.left[s - a] > (a == s - a))]

    def filling(self, gap: int, long: int) -> list[int] | None:
        """Up to three lengths of sum gap, there beside one of long; the caller then uses them or gives long up."""
        left = self.left
        left[long] -= 1
        try:
            if left[gap] > 0:
                return [gap]
            self.pairs[gap] = self._alive(gap)
            if len(self.pairs[gap]):
                a = int(self.pairs[gap][0])
                return [a, gap - a]
            for k, a in enumerate(self.triples[gap].tolist()):
                if left[a] > 0:
                    left[a] -= 1
                    b = self._alive(gap - a)
                    left[a] += 1
                    b = b[b <= a]
                    if len(b):
                        self.triples[gap] = self.triples[gap][k:]
                        return [a, int(b[0]), gap - a - int(b[0])]
            self.triples[gap] = self.triples[gap][:0]
            return None
        finally:
            left[long] += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths that share a sequence, how many sequences are so), using exactly counts[length] of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []

    def use(lengths: list[int], times: int) -> None:
        out.append((lengths, times))
        for x in lengths:
            left[x] -= times

    if left[capacity]:
        use([capacity], int(left[capacity]))

    def times(lengths: list[int]) -> int:
        return int(min(left[x] // lengths.count(x) for x in set(lengths)))

    sums = Sums(left)
    residual: dict[int, int] = {}
    for long in range(capacity - 1, 0, -1):
        while left[long] > 0:
            found = sums.filling(capacity - long, long)
            if not found:
                residual[long] = int(left[long])
                left[long] = 0
                break
            use([long, *found], max(1, times([long, *found])))

    # best fit, longest first: open sequences of one filling stand together, with their number
    rooms: list[int] = []
    at_room: dict[int, list[list]] = {}

    def put(room: int, lengths: list[int], n: int) -> None:
        if room not in at_room:
            at_room[room] = []
            insort(rooms, room)
        at_room[room].append([lengths, n])

    for length, n in sorted(residual.items(), reverse=True):
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # none has room: new ones, filled with as many as fit
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, [length] * each, full)
                if rest:
                    put(capacity - rest * length, [length] * rest, 1)
                break
            room = rooms[k]
            lengths, m = at_room[room][-1]
            take = min(n, m)
            at_room[room][-1][1] -= take
            if m == take:
                at_room[room].pop()
                if not at_room[room]:
                    del at_room[room]
                    rooms.pop(k)
            put(room - length, [*lengths, length], take)
            n -= take
    out += [(lengths, n) for room in sorted(at_room) for lengths, n in at_room[room]]
    return out


def places(made: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length rows (rank from, sequence id of it, offset): the ranks from one row's to the next's follow on."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in made:
        at = 0
        for x in lengths:
            rows.setdefault(x, []).append((taken.get(x, 0), base, at))
            taken[x] = taken.get(x, 0) + n
            at += x
        base += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, which must be written down already, with sequence_id and offset."""
    spark = cut.sparkSession
    ship(spark)
    salts = int(np.clip(cut.count() // EACH, *SALTS))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toPandas()  # at most capacity x salts rows
    table = places(plan({int(k): int(v) for k, v in counts.groupby("length").n.sum().items()}, capacity), capacity)
    counts = counts.sort_values(["length", "_salt"])
    counts["_before"] = counts.groupby("length").n.cumsum() - counts.n
    before = np.zeros((capacity + 1, salts), np.int64)
    before[counts.length, counts._salt] = counts._before
    shared = spark.sparkContext.broadcast((table, before))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, before = shared.value
        n, s = length.to_numpy(), salt.to_numpy()
        r = before[n, s] + rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            rows = table[int(n[part[0]])]
            k = np.searchsorted(rows[:, 0], r[part], "right") - 1
            seq[part] = rows[k, 1] + r[part] - rows[k, 0]
            off[part] = rows[k, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(w) - 1)
    return ranked.withColumn("_at", place("length", "_salt", "_rank")).select(*cut.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) as packed pieces."""
    return pack(staged(pieces(docs, path or tokenizer_file(), capacity), "pieces"), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all of documents; see the module for the cases."""
    return pack_documents(read(spark, sf_dir, "documents"))
