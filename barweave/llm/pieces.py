"""SentencePiece encoding and decoding of byte-pair models by suffix-array matching.

A batch's different words (a word begins with the blanks before it; no piece reaches across) are
concatenated and indexed by a suffix array over their first 16 symbols, which is as long as pieces get.
Every piece is binary-searched for its range of occurrences; the ranges, sorted by position, give the
edges (position, length) of all pieces in the text. Relaxing follows the model's rule: of the
neighbouring parts of a word that an edge joins, the one of best rank is joined, the leftmost of equals,
until no edge joins any. All words of a batch relax together, a step of each at a time; a long word has
a queue of its own. What is left without a piece becomes the pieces of its bytes.

Defined results: a null text is an empty one, without ids. Repeated rows each get a row, ids of rows may
be null, texts of any length are taken whole. Decoding gives back any text that was encoded, exactly,
but for the blank symbol U+2581 in it, which comes back as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, read, utf8

BLANK = "▁"
WIDTH, SHORT, CHUNK, BATCH, MEMO = 16, 48, 1 << 22, 1 << 19, 700_000
_models: dict[str, Model] = {}


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or len(proto.normalizer_spec.precompiled_charsmap):
            raise ValueError("a byte-pair model without normalisation rules is needed")
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.piece = [p for _, p, _ in normal]
        self.id = np.array([i for i, _, _ in normal], np.int64)
        # equal scores have equal rank, the best is 1
        scores = np.array([s for _, _, s in normal])
        self.rank = (np.unique(-scores, return_inverse=True)[1] + 1).astype(np.int32)
        self.bytes = np.zeros(256, np.int64)
        self.surface = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                self.surface[i] = p.piece.replace(BLANK, " ").encode()
        # where no piece reaches across, words end: before blanks, around a line feed that stands alone in
        # all pieces, and before marks that no piece has after another symbol than a blank or such a mark
        pairs = {(a, b) for p in self.piece for a, b in zip(p, p[1:])}
        self.pairs = {a + b for a, b in pairs}
        marks = {c for p in self.piece for c in p if not c.isalnum() and c not in (BLANK, "\n")}
        while bad := {b for a, b in pairs if b in marks and a != BLANK and a not in marks}:
            marks -= bad
        own = any("\n" in pair for pair in pairs)
        m, stop = re.escape("".join(sorted(marks))) if marks else "\0", BLANK + ("" if own else "\n")
        if any(b == BLANK and a != BLANK for a, b in pairs):
            raise ValueError("pieces reach across the begin of a word")
        self.alone = re.compile(f"{BLANK}*[^{stop}{m}]+|{BLANK}*[{m}]+[^{stop}]*|{BLANK}+" + ("" if own else "|\n"))
        self.wide = max(map(len, self.piece))
        if self.wide > WIDTH:
            raise ValueError("pieces are longer than the index is deep")
        self.points = np.zeros((len(self.piece), WIDTH), np.uint32)
        for i, p in enumerate(self.piece):
            self.points[i, : len(p)] = [ord(c) for c in p]
        self.memo: dict[str, bytes] = {}
        table = np.array([len(s) for s in self.surface], np.int64)
        self.size, self.at = table, np.concatenate([[0], np.cumsum(table)[:-1]])
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.alone.findall((BLANK if self.dummy else "") + text.replace(" ", BLANK))

    # --- edges ---

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, index of the piece) of every occurrence in points, by position; 0 separates words."""
        symbols = np.unique(points)
        text = np.searchsorted(symbols, points).astype(np.uint64)  # 0 stays 0
        bits = max(1, int(len(symbols)).bit_length())
        per = 63 // bits  # symbols in one key
        keys = []
        padded = np.concatenate([text, np.zeros(WIDTH + per, np.uint64)])
        for first in range(0, WIDTH, per):
            k = np.zeros(len(text), np.uint64)
            for j in range(first, min(first + per, WIDTH)):
                k = (k << np.uint64(bits)) | padded[j : j + len(text)]
            k <<= np.uint64(bits * (per - (min(first + per, WIDTH) - first)))
            keys.append(k)
        order = np.lexsort(keys[::-1])  # the suffix array
        keys = [k[order] for k in keys]
        at = np.minimum(np.searchsorted(symbols, self.points), len(symbols) - 1)
        there = symbols[at] == self.points
        which = np.flatnonzero((there | (self.points == 0)).all(1))
        if not len(which):
            return (np.zeros(0, np.int64),) * 3
        rows = np.where(self.points[which] == 0, -1, at[which])
        length = (rows >= 0).sum(1)
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(text), np.int64)
        for n, first in enumerate(range(0, WIDTH, per)):
            k = np.zeros((2, len(which)), np.uint64)
            for j in range(first, min(first + per, WIDTH)):
                for side, other in ((0, 0), (1, (1 << bits) - 1)):
                    k[side] = (k[side] << np.uint64(bits)) | np.where(rows[:, j] >= 0, rows[:, j], other).astype(np.uint64)
            shift = np.uint64(bits * (per - (min(first + per, WIDTH) - first)))
            k[0] <<= shift
            k[1] = (k[1] << shift) | ((np.uint64(1) << shift) - np.uint64(1))
            low, high = _bisect(keys[n], k[0], low, high, False), _bisect(keys[n], k[1], low, high, True)
        found = high - low
        at = order[np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())]
        size, piece = np.repeat(length, found), np.repeat(which, found)
        by = np.argsort(at, kind="stable")
        return at[by], size[by], piece[by]

    # --- relaxing ---

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at, size, piece = self.edges(points)
        n = len(points)
        table = np.full((n, WIDTH + 1), 0, np.int32)  # 1 + piece by position and length
        table[at, size] = piece + 1
        length = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        cuts = np.zeros(n + 1, bool)  # where a part begins
        short = np.flatnonzero((length > 0) & (length <= SHORT))
        for k in np.flatnonzero(length > SHORT):
            cuts[self._queue(table, int(begin[k]), int(begin[k] + length[k]))] = True
        if len(short):
            cuts[self._together(table, begin[short], length[short])] = True
        cuts[begin + length] = True  # the separators
        start = np.flatnonzero(cuts[:n])
        end = np.append(start[1:], n)
        inner = points[start] != 0
        start, end = start[inner], end[inner]
        which = table[start, np.minimum(end - start, WIDTH)]
        which[end - start > WIDTH] = 0
        ids: list[np.ndarray] = [self.id[which - 1]]
        reps = np.ones(len(start), np.int64)
        missing = np.flatnonzero(which == 0)
        raw = [chr(points[i]).encode("utf-8", "surrogatepass") for i in start[missing]]
        reps[missing] = [len(r) for r in raw]
        flat = np.repeat(ids[0], reps)
        if len(missing):
            first = np.cumsum(reps) - reps
            for i, r in zip(missing, raw, strict=True):
                flat[first[i] : first[i] + len(r)] = self.bytes[list(r)]
        owner = np.searchsorted(begin, start, "right") - 1
        total = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=reps, minlength=len(words)).astype(np.int64))])
        out = flat.astype("<u4").tobytes()
        return [out[4 * total[k] : 4 * total[k + 1]] for k in range(len(words))]

    def _rank_of(self, table: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The rank of the edge from a to c, a large number if there is none."""
        w = np.where(c - a <= WIDTH, table[a, np.minimum(c - a, WIDTH)], 0)
        return np.where(w > 0, self.rank[w - 1], np.iinfo(np.int32).max)

    def _together(self, table: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        none = np.iinfo(np.int32).max
        word = np.repeat(np.arange(len(begin)), length)
        part = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + begin[word]
        stop = begin + length
        done: list[np.ndarray] = []
        while len(part):
            same = np.append(word[1:] == word[:-1], False)
            after = np.where(same, np.append(part[1:], 0), 0)
            after2 = np.where(np.append(same[1:], False) & same, np.append(part[2:], [0, 0])[: len(part)], stop[word])
            rank = np.where(same, self._rank_of(table, part, np.where(same, after2, part + 1)), none)
            del after
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(part)))
            # words that nothing joins are finished
            live = np.repeat(best < none, sizes)
            hit = np.flatnonzero(live & (rank == np.repeat(best, sizes)))
            left = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit
            done.append(part[~live])
            keep = live.copy()
            keep[left + 1] = False
            part, word = part[keep], word[keep]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def _queue(self, table: np.ndarray, a: int, b: int) -> list[int]:
        """The same for one long word: parts as a linked list, joins in a queue by rank, then place."""
        right = {i: i + 1 for i in range(a, b)}
        left = {i + 1: i for i in range(a, b)}
        queue: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right.get(i)
            if j is not None and j < b:
                c = right[j]
                if c - i <= WIDTH and (w := table[i, c - i]):
                    heapq.heappush(queue, (int(self.rank[w - 1]), i, j, c))

        for i in range(a, b):
            push(i)
        while queue:
            _, i, j, c = heapq.heappop(queue)
            if right.get(i) != j or right.get(j) != c:
                continue
            right[i] = c
            left[c] = i
            del right[j]
            left.pop(j, None)
            push(i)
            if i in left and left[i] in right:
                push(left[i])
        return list(right)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; words are kept in a memo of MEMO words at most."""
        split = [self.words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        # no piece reaches over a pair of symbols that no piece has: a word and its form with a mark share the work
        ends = {w: (w[:-1], w[-1]) for w in {*flat} if w not in self.memo and len(w) > 1 and w[-2:] not in self.pairs and "\0" not in w}
        new = [w for w in {*flat, *chain.from_iterable(ends.values())} if w not in self.memo and w not in ends]
        got: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (size < BATCH or to == at):
                size += len(new[to]) + 1
                to += 1
            some = new[at:to]
            plain = [w for w in some if "\0" not in w]
            got.update(zip(plain, self.encode_words(plain), strict=True))
            for w in some:
                if "\0" in w:  # the separator itself: its pieces are those of the text around it and its byte
                    got[w] = np.array([self.bytes[0]], "<u4").tobytes().join(self.encode_words(w.split("\0")))
            at = to
        for w in sorted(ends, key=len):  # the shorter first: a word's begin may be one of them
            a, b = ends[w]
            got[w] = (got[a] if a in got else self.memo[a]) + (got[b] if b in got else self.memo[b])
        room = MEMO - len(self.memo)
        for w in list(got)[: max(room, 0)]:
            self.memo[w] = got[w]
        for ws in split:
            yield b"".join([got[w] if w in got else self.memo[w] for w in ws])

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.size[i]
        out = self.flat[np.repeat(self.at[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        return out[1:] if self.dummy and out[:1] == b" " else out


def _bisect(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """For each wanted key its place between low and high, where keys are in order."""
    a, b = low.copy(), high.copy()
    while (a < b).any():
        mid = (a + b) >> 1
        k = keys[np.minimum(mid, len(keys) - 1)]
        go = ((k <= wanted) if right else (k < wanted)) & (a < b)
        b = np.where(go | (a >= b), b, mid)
        a = np.where(go, mid + 1, a)
    return a


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = data.tobytes()
            n, crc, same = [], [], []
            at = 0
            while at < len(off) - 1:
                to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
                texts = [raw[off[i] : off[i + 1]] for i in range(at, to)]
                for t, ids in zip(texts, model(path).encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                    n.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    same.append(model(path).decode(ids) == t)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian 32-bit numbers) of each row of docs (doc_id, text)."""
    path = path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(model(path).encode(texts)), pa.binary())], ["doc_id", "ids"])

    return arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of rows (doc_id, ids)."""
    path = path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model(path).decode(i or b"").decode("utf-8", "replace") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow(rows.select("doc_id", "ids"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding gives the text again) of all of documents; see the module for the cases."""
    docs = read(spark, sf_dir, "documents")
    return arrow(docs.select("doc_id", "text"), _encoded(model_file()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
