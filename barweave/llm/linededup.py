"""Line de-duplication by a deletion-neighbourhood join.

Two lines are the same if few edits (a code point inserted, deleted or replaced) lie between them: at
most one for every ``SHARE`` code points of the longer line, one and one more for every ``STEP`` of them,
and ``MOST``; so lines under ``SHARE`` code points only if they are equal. A line goes when an earlier line
is the same, earlier by doc_id and then by place in the document; what is earlier need not stay itself.
Lines of white space only are neither removed nor compared.

Equal lines meet by their hash. Where one edit is allowed (under ``STEP`` code points), every variant with
one code point deleted is a hashed key, together with where it was deleted: two lines that share a variant
and the place differ by a replacement there, and a line that equals another's variant by an insertion, so
the earliest line of a key is a witness and no pairs of a key are listed. Since nearly no line has a
neighbour, the variants of single code points come last: first a half of the line is deleted, then a
sixteenth, and only lines that share such a coarse variant with another line, hence may have a neighbour
there, go on, and only with the variants of the part deleted. No neighbour within the bound is lost by
this: whatever part holds the edit, the rest is equal.

Where 2 t or 2 t + 1 edits are allowed, one end of the line has t at most. It is cut into t + 1 parts, of
which one is equal, after no more edits than parts: the variants are those with all but the part i of an
end deleted, moved by up to i. The size of a part depends on the class of the longer line's length alone; a
line near a border has the keys of two classes. Lines that share a part are compared where they meet,
``LARGE`` of them at most, each with the earlier ones until one is a neighbour: sets of three code points
first, which few edits change little, then the edit distance, diagonal by diagonal. Of more, each is
compared with the earliest, and while some are open the shared part is deleted and the rest, within the
same number of edits, is cut again; what is still large after ``DEPTH`` rounds is compared block by block.
No neighbour within the bound is lost by this.

Texts are read twice (hashes of lines; then the few lines that may have a neighbour) and once more when
lines are taken out. Nothing about all documents reaches the driver but a bitmap of fixed size.

Defined results: a null text has no lines and stays null; an empty one is one blank line. Rows without
an id, or with one that is no whole number, stay as they are and witness nothing. Rows of one id count as
one document; a line at the same place of two such rows does not remove itself. Lines of any length are
read whole. Columns other than text and n_chars stay as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow, fresh, mix, read, staged, unstage

SHARE, STEP, MOST = 8, 40, 5
PARTS, BITMAP = 16, 26
LARGE, DEPTH, SHORTEST = 2048, 4, 4
CHUNK, SEEN = 1 << 18, 1 << 17
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_up, _down = np.ones(1, U64), np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _up, _down
    if len(_up) < n:
        size = max(n, 2 * len(_up))
        _up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _BASE, U64))])
        _down = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _INVERSE, U64))])
    return _up, _down


_plane: dict[int, np.ndarray] = {}
_INK = np.ones(1 << 14, bool)
_INK[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = False


def _spread(points: np.ndarray, salt: int) -> np.ndarray:
    """A number of 64 bits for each code point; those of the first plane are looked up."""

    def made(x: np.ndarray) -> np.ndarray:
        return mix(x.astype(U64) + U64(salt) * U64(0x632BE59BD9B4E019) + U64(1))

    if salt not in _plane:
        _plane[salt] = made(np.arange(1 << 16))
    out = _plane[salt][points & 0xFFFF]
    high = np.flatnonzero(points >= 1 << 16)
    out[high] = made(points[high])
    return out


class Hashed:
    """Code points end to end, with the hash of any stretch of them, and of two stretches joined, in a few operations."""

    def __init__(self, points: np.ndarray, salt: int):
        self.up, self.down = _powers(len(points) + 1)
        c = _spread(points, salt)
        self.sum = np.concatenate([np.zeros(1, U64), np.cumsum(c * self.up[: len(points)])])

    def joined(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Hash of [a, b) followed by [c, d)."""
        first = (self.sum[b] - self.sum[a]) * self.down[a]
        then = (self.sum[d] - self.sum[c]) * self.down[c] * self.up[b - a]
        return mix(first + then + (b - a + d - c).astype(U64) * U64(0xD6E8FEB86659FD93))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """That of [a, b), as joined gives it with nothing to follow."""
        return mix((self.sum[b] - self.sum[a]) * self.down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each ended by a line feed, and for each line its text, number, begin and end."""
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10)
    begin = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    count = np.array([t.count("\n") + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(ends)) - np.repeat(np.cumsum(count) - count, count)
    return points, text, number, begin, ends


def _blank(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_INK[np.minimum(points, len(_INK) - 1)])])
    return seen[end] == seen[begin]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _coarse(h: Hashed, a: np.ndarray, b: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, from, to) of the variants with a part deleted, for each part and for the line as the shorter and as the longer of a pair.

    A pair of lengths n and n, or n and n + 1, cuts at the same places counted from the left before the
    edit and from the right behind it: part k of n points is [n k / parts, n (k + 1) / parts), of the
    longer line one point more.
    """
    out = []
    for longer in (0, 1):
        n = b - a - longer
        for k in range(parts):
            p, q = n * k // parts, n * (k + 1) // parts
            key = h.joined(a, a + p, a + q + longer, b)
            out.append((mix(key + n.astype(U64) * U64(2 * PARTS) + U64(k)), a + p, a + q + longer))
    return out


def edits(n: int) -> int:
    """How many edits are allowed where the longer line has n code points."""
    return min(n // SHARE, 1 + n // STEP, MOST)


def _grid() -> np.ndarray:
    """Borders of the classes of lengths: at least MOST + 1 apart, and one wherever the tier changes."""
    fixed = [n for n in range(STEP, STEP * MOST + 1, STEP) if edits(n) // 2 != edits(n - 1) // 2]
    out = [STEP % (MOST + 1)]
    while out[-1] < 1 << 31:
        nxt = max(out[-1] + MOST + 1, out[-1] * 8 // 7)
        ahead = [f for f in fixed if out[-1] < f < nxt + MOST + 1]
        out.append(ahead[0] if ahead else nxt)
    return np.array(out, np.int64)


GRID = _grid()


def _cuts(h: Hashed, a: np.ndarray, b: np.ndarray, tier: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(which line, key, from, to, tier) of the parts of each line, and the lines too short to cut in one of their classes; tier: of rests of lines, or else as lengths give it."""
    out, short = [], [np.zeros(0, np.int64)]
    n = b - a
    low = np.searchsorted(GRID, n, "right") - 1
    high = np.searchsorted(GRID, n + MOST, "right") - 1
    for c, use in ((low, np.ones(len(n), bool)), (high, high > low)):
        at = GRID[np.maximum(c, 0)]
        t = np.minimum(1 + at // STEP, MOST) // 2 if tier is None else tier
        for each in np.unique(t):
            q = (at - 4 * each - 1) // (2 * each + 2)
            line = np.flatnonzero(use & (c >= 0) & (t == each) & (q >= (1 if tier is None else SHORTEST)))
            if tier is None:
                line = line[at[line] >= STEP]
            else:
                short.append(np.flatnonzero(use & (t == each) & ((c < 0) | (q < SHORTEST))))
            x, y, size = a[line], b[line], q[line]
            for i in range(each + 1):
                for j in range(i + 1):
                    for side in (0, 1):
                        p = y - (i + 1) * size - j if side else x + i * size + j
                        key = mix(h.of(p, p + size) + at[line].astype(U64) * U64(64) + U64(i * 2 + side))
                        out.append((line, key, p, p + size, np.full(len(line), each)))
    made = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
    return *made, np.unique(np.concatenate(short))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line that counts: id, line, two hashes, and its keys: with a half deleted, or of its parts (none if it is short, or equal to one not long before)."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for x, y in _groups(texts):
            some = [i for i in range(x, y) if texts[i] is not None]
            if not some:
                continue
            points, text, number, begin, end = lines_of([texts[i] for i in some])
            keep = ~_blank(points, begin, end)
            text, number, begin, end = text[keep], number[keep], begin[keep], end[keep]
            h = Hashed(points, 0)
            own, other = h.of(begin, end), Hashed(points, 1).of(begin, end)
            new = []
            for i, x in enumerate(zip(own.tolist(), other.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            new = np.array(new, np.int64)
            size = (end - begin)[new]
            near = new[(size >= SHARE - 1) & (size < STEP)]  # a shorter one may be the neighbour of one of SHARE
            half = [k & ~U64(1) for k, _, _ in _coarse(h, begin[near], end[near], 2)]  # even: halves, odd: parts
            line, key, *_ = _cuts(h, begin[new], end[new])
            line = new[line]
            line, keys = np.concatenate([np.tile(near, len(half)), line]), np.concatenate([*half, key | U64(1)])
            keys = keys[np.argsort(line, kind="stable")].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(begin)))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(some)[text])),
                    pa.array(number, pa.int32()),
                    pa.array(own.view(np.int64)),
                    pa.array(other.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)),
                ],
                ["id", "line", "h", "g", "keys"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, h), in order, that share their key with another h."""
    key, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, h = np.append(key[-1:], np.asarray(batch.column(0))), np.append(h[-1:], np.asarray(batch.column(1)))
        meet = np.flatnonzero((key[1:] == key[:-1]) & (h[1:] != h[:-1]))
        at = np.union1d(meet, meet + 1)
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(h[at])], ["key", "h"])


def _wanted(bitmap):
    """The lines whose hash may be wanted, with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in _groups(texts):
                some = [i for i in range(x, y) if texts[i] is not None]
                if not some:
                    continue
                points, text, number, begin, end = lines_of([texts[i] for i in some])
                h = Hashed(points, 0).of(begin, end)
                pos = (h & U64((1 << BITMAP) - 1)).astype(np.int64)
                take = np.flatnonzero(wanted[pos >> 3] >> (pos & 7) & 1)
                if len(take):
                    strings = [points[begin[i] : end[i]].tobytes().decode("utf-32-le", "replace") for i in take]
                    size = end[take] - begin[take]
                    points = np.concatenate([points[begin[i] : end[i]] for i in take])  # of these lines alone
                    to = np.cumsum(size)
                    g = Hashed(points, 1).of(to - size, to)
                    bits = _triples(points, to - size, to).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(np.array(some)[text[take]])),
                            pa.array(number[take], pa.int32()),
                            pa.array(h[take].view(np.int64)),
                            pa.array(g.view(np.int64)),
                            pa.array(size),
                            pa.array([bits[k : k + 32] for k in range(0, len(bits), 32)], pa.binary()),
                            pa.array(strings),
                        ],
                        ["id", "line", "h", "g", "n", "bits", "s"],
                    )

    return run


def _part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h and the keys with a sixteenth deleted."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for x, y in _groups(texts):
            points, _, _, begin, end = lines_of(texts[x:y])
            keys = [k for k, _, _ in _coarse(Hashed(points, 0), begin, end, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.asarray(batch.column(0).slice(x, y - x)), len(keys))), pa.array(np.repeat(np.arange(len(keys)), y - x), pa.int32()), pa.array(np.concatenate(keys).view(np.int64))], ["h", "part", "key"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, kind of each variant in the parts asked for.

    kind 0: the line with one point deleted, the key with the place; 1: the same without the place; 2: the
    whole line. Kinds 1 and 2 meet in one key.
    """
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for x, y in _groups(texts):
            points, _, _, begin, end = lines_of(texts[x:y])
            h = Hashed(points, 0)
            own = np.asarray(batch.column(0).slice(x, y - x))
            which, part = [], []
            for i, p in enumerate(batch.column(2).slice(x, y - x).to_pylist()):
                which += [i] * len(p)
                part += p
            which, part = np.array(which, np.int64), np.array(part, np.int64)
            longer = part // PARTS
            n = end[which] - begin[which] - longer
            k = part % PARTS
            p, q = n * k // PARTS, n * (k + 1) // PARTS + longer
            size = np.maximum(q - p, 0)
            at = np.repeat(np.arange(len(which)), size)
            place = p[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            line = which[at]
            spot = np.unique(line << 32 | place)  # parts of the shorter and of the longer reading overlap
            place, line = spot & 0xFFFFFFFF, spot >> 32
            gone = h.joined(begin[line], begin[line] + place, begin[line] + place + 1, end[line])
            placed = mix(gone + (place.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
            whole = h.of(begin, end)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own[line], own[line], own])), pa.array(np.concatenate([placed, gone, whole]).view(np.int64)), pa.array(np.repeat(np.array([0, 1, 2]), [len(line), len(line), len(own)]), pa.int32())], ["h", "key", "kind"]
            )


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, tier, key, rest) of each part of (h, root, tier, s) by a key that takes in the root; rest: s without it. Tier -1: a whole line.

    What is too short to cut has its root for key and no rest.
    """
    for batch in batches:
        own, root, tier = (np.asarray(batch.column(i)) for i in range(3))
        texts = batch.column(3).to_pylist()
        for x, y in _groups(texts):
            points, _, _, begin, end = lines_of(texts[x:y])
            whole = points.tobytes()
            h, t = Hashed(points, 0), tier[x:y].astype(np.int64)
            top = bool((t < 0).any())
            line, key, p, q, made, short = _cuts(h, begin, end, None if top else t)
            key = (key | U64(1) if top else mix(key ^ root[x:y].view(U64)[line])).view(np.int64)
            rest = [(whole[4 * begin[i] : 4 * a] + whole[4 * b : 4 * end[i]]).decode("utf-32-le", "replace") for i, a, b in zip(line, p, q, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own[x:y][line], own[x:y][short]])),
                    pa.array(np.concatenate([made, t[short]]), pa.int32()),
                    pa.array(np.concatenate([key, root[x:y][short]])),
                    pa.array(rest + [None] * len(short), pa.string()),
                ],
                ["h", "tier", "key", "rest"],
            )


def _triples(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each line a set of 256 bits of its runs of three code points; an edit changes six bits at most."""
    n = np.maximum(end - begin - 2, 0)
    line = np.repeat(np.arange(len(n)), n)
    at = np.repeat(begin, n) + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    x = points.astype(U64)
    bit = (mix((x[at] * U64(1 << 42)) ^ (x[at + 1] << U64(21)) ^ x[at + 2]) >> U64(56)).astype(np.int64)
    out = np.zeros(len(n) * 256, bool)
    out[line * 256 + bit] = True
    return np.packbits(out.reshape(len(n), 256), axis=1).view(U64)


def edit_distance(h: Hashed, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int | np.ndarray = MOST) -> np.ndarray:
    """Edit distances of the stretches [a, a + n) and [b, b + m), most (of all or of each pair) + 1 where larger: how far each diagonal gets with each number of edits.

    A diagonal further from the last one than edits are left leads nowhere and is not followed.
    """
    most = np.broadcast_to(np.asarray(most, np.int64), len(a))
    out, shift = most + 1, m - n
    live = np.flatnonzero(np.abs(shift) <= most)

    def along(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many code points of the pairs agree from i and j on, by halving."""
        p, q = a[at] + i, b[at] + j
        low, high = np.zeros(len(i), np.int64), np.minimum(n[at] - i, m[at] - j)
        from_p, from_q, down_p, down_q = h.sum[p], h.sum[q], h.down[p], h.down[q]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (h.sum[p + mid] - from_p) * down_p == (h.sum[q + mid] - from_q) * down_q
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    top, none = int(most.max(initial=0)), -(1 << 40)
    d = np.arange(-top, top + 1)  # the diagonals, a column each, and one more at either side
    far, e = np.full((len(live), len(d) + 2), none), 0
    while len(live):
        if e:
            i = np.maximum(np.maximum(far[:, 1:-1] + 1, far[:, :-2]), far[:, 2:] + 1)
            i = np.minimum(i, np.minimum(n[live][:, None], m[live][:, None] - d))
        else:
            i = np.zeros((len(live), len(d)), np.int64)
        row, col = np.nonzero((np.abs(d) <= e) & (np.abs(shift[live][:, None] - d) <= (most[live] - e)[:, None]) & (i >= 0) & (i + d >= 0))
        i = i[row, col]
        far = np.full((len(live), len(d) + 2), none)
        far[row, col + 1] = i + along(live[row], i, i + d[col])
        there = far[np.arange(len(live)), shift[live] + top + 1] >= n[live]
        out[live[there]] = e
        on = ~there & (most[live] > e)
        live, far = live[on], far[on]
        e += 1
    return out


def _witnessed(key: np.ndarray, n: np.ndarray, bits: np.ndarray, texts: pa.ChunkedArray) -> np.ndarray:
    """Which of the lines, in order of key and then of place, have a neighbour before them among those of their key."""
    last = np.searchsorted(key, key, "right")
    allowed = np.minimum(np.minimum(n // SHARE, 1 + n // STEP), MOST)
    done = np.zeros(len(n), bool)
    held: list[tuple[np.ndarray, ...]] = []

    def verify() -> None:
        pairs = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        part = np.cumsum(n[pairs[0]] + n[pairs[1]]) // (4 * CHUNK)  # so many code points at once, a longer pair alone
        for i, j, most in zip(*(np.split(x, np.flatnonzero(np.diff(part)) + 1) for x in pairs), strict=True):
            row, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            points, _, _, begin, end = lines_of(texts.take(pa.array(row)).to_pylist())
            a, b = np.split(at, 2)
            done[j[edit_distance(Hashed(points, 0), begin[a], n[i], begin[b], n[j], most) <= most]] = True

    act, d, size, turn = np.arange(len(n)), 1, 0, 1
    while len(act := act[act + d < last[act]]):
        i = act[~done[act + d]]
        j = i + d
        most = np.maximum(allowed[i], allowed[j])
        near = np.abs(n[i] - n[j]) <= most
        i, j, most = i[near], j[near], most[near]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= 6 * most
        if near.any():
            held.append((i[near], j[near], most[near]))
            size += int((n[i[near]] + n[j[near]]).sum())
        if held and (d == turn or size >= 4 * CHUNK):  # those found need no further witness
            verify()
            size = 0
        turn = 2 * turn if d == turn else turn
        d += 1
    if held:
        verify()
    return done


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g) of the rows (key, h, g, n, bits, s), in order of key and place, that have an earlier neighbour in their key."""

    def out(t: pa.Table) -> pa.RecordBatch:
        h, g, n = (t.column(c).to_numpy() for c in ("h", "g", "n"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(-1, 4)
        done = _witnessed(t.column("key").to_numpy(), n, bits, t.column("s"))
        return pa.RecordBatch.from_arrays([pa.array(h[done]), pa.array(g[done])], ["h", "g"])

    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
        left = t.slice(cut)
        if cut:
            yield out(t.slice(0, cut))
    if left is not None and left.num_rows:
        yield out(left)


def _within(pair: DataFrame, text: DataFrame) -> DataFrame:
    """(h, g) of the pairs (h, g, other, more: the h and g of another line) that are neighbours."""
    pair = pair.join(text.select("h", "g", "s"), ["h", "g"]).join(text.select(F.col("h").alias("other"), F.col("g").alias("more"), F.col("s").alias("t")), ["other", "more"])
    n = F.greatest(F.length("s"), F.length("t"))
    bound = F.least(F.floor(n / SHARE), F.floor(n / STEP) + 1, F.lit(MOST))
    return pair.where(F.abs(F.length("s") - F.length("t")) <= bound).where((F.levenshtein("s", "t", MOST) >= 0) & (F.levenshtein("s", "t", MOST) <= bound)).select("h", "g").distinct()


def _few_edits(text: DataFrame, member: DataFrame) -> DataFrame:
    """(h, g) of the lines (h, g, id, line, s) that have an earlier neighbour among those they share a part with; member: (key, h) of the parts."""
    shared, cut, gone = member.withColumn("whole", F.lit(False)), None, None
    where = F.struct("id", "line", "h", "g")
    for depth in range(DEPTH + 1):
        size = shared.groupBy("key").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).where("n > 1")
        size = staged(size.withColumn("whole", F.col("whole") | (F.col("n") <= LARGE) | F.lit(depth == DEPTH)), "line-groups")
        rows = shared.select("key", "h").join(size.withColumnRenamed("n", "many"), "key").join(text, "h")
        # a large group that can't be cut any more is compared block by block, each two blocks in a task
        blocks = F.when(F.col("many") > LARGE, F.ceil(F.col("many") / F.lit(LARGE // 2))).otherwise(1).cast("int")
        dealt = rows.where("whole").withColumn("b", F.pmod(F.xxhash64("h", "g"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("key", F.when(F.col("many") > LARGE, F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o"))).otherwise(F.col("key")))
        dealt = dealt.select("key", "h", "g", "n", "bits", "s", "id", "line").repartition("key").sortWithinPartitions("key", "id", "line").select("key", "h", "g", "n", "bits", "s")
        found = staged(arrow(dealt, _compare, "h long, g long").distinct(), "line-neighbours")
        gone = found if gone is None else staged(gone.unionAll(found), "line-neighbours")
        large = size.where("not whole").select("key")
        if depth == DEPTH or large.isEmpty():
            unstage(size)
            break
        hot = rows.where("not whole")
        low = hot.groupBy("key").agg(F.min(where).alias("low")).select("key", F.col("low.h").alias("other"), F.col("low.g").alias("more"))
        gone = staged(gone.unionAll(_within(hot.join(low, "key").where("h <> other or g <> more").select("h", "g", "other", "more"), text)).distinct(), "line-neighbours")
        # where lines are still open, all lines of the key go on with the rest that the shared part leaves
        again = staged(hot.select("key", "h", "g").join(gone, ["h", "g"], "left_anti").groupBy("key").agg(F.count("*").alias("open")).where("open > 1").select("key"), "line-open")
        if cut is None:
            cut = arrow(shared.join(again, "key", "left_semi").select("h").distinct().join(text, "h").select("h", F.lit(0).cast("long").alias("root"), F.lit(-1).alias("tier"), "s"), _rests, "h long, tier int, key long, rest string")
        now = cut.where("rest is not null").join(again, "key", "left_semi").select("h", F.col("key").alias("root"), "tier", F.col("rest").alias("s"))
        cut = staged(arrow(now, _rests, "h long, tier int, key long, rest string").dropDuplicates(["h", "key"]), "line-parts")
        shared = cut.select("key", "h", F.col("rest").isNull().alias("whole"))
    return gone


def removed_lines(docs: DataFrame) -> DataFrame:
    """(id, line, near): each line that goes, and whether for a neighbour (or else an equal line)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").try_cast("long").alias("id"), "text").where("id is not null and text is not null")
    every = staged(arrow(rows, _first_pass, "id long, line int, h long, g long, keys array<long>"), "lines")
    where = F.struct("id", "line")
    first = staged(every.groupBy("h", "g").agg(F.min(where).alias("at"), F.count("*").alias("c")), "first-lines")
    # lines that share a key with a different line; equal lines of a task have given their keys once
    keys = every.select(F.explode("keys").alias("key"), "h").repartition("key").sortWithinPartitions("key", "h")
    member = staged(arrow(keys, _shared, "key long, h long").distinct(), "near-lines")
    some = member.select("h").distinct()
    bits = spark.sparkContext.broadcast(_low_bits(some))
    text = arrow(rows, _wanted(bits), "id long, line int, h long, g long, n long, bits binary, s string")
    text = text.join(some, "h", "left_semi").join(first.select("h", "g", F.col("at.id").alias("id"), F.col("at.line").alias("line")), ["h", "g", "id", "line"], "left_semi")
    both = staged(text.dropDuplicates(["h", "g"]), "near-texts")
    text = both.where(F.length("s") < STEP)
    keys = staged(arrow(text.select("h", "s"), _part_keys, "h long, part int, key long"), "part-keys")
    twice = keys.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key")
    asked = keys.join(twice, "key", "left_semi").groupBy("h").agg(F.sort_array(F.collect_set("part")).alias("parts"))  # at most 2 x PARTS
    made = arrow(text.join(asked, "h").select("h", "s", "parts"), _variants, "h long, key long, kind int")
    made = staged(made.join(text.select("h", "g", F.struct("id", "line").alias("at")), "h"), "variants")
    # the earliest line of each key: among those with the same place, and of either side of an insertion
    best = made.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.struct("at", "h", "g"))).alias(f"w{k}") for k in range(3)])
    pair = made.join(best, "key").select("h", "g", "at", F.when(F.col("kind") == 0, F.col("w0")).when(F.col("kind") == 1, F.col("w2")).otherwise(F.col("w1")).alias("w"))
    pair = pair.where("w is not null and w.at < at and (w.h <> h or w.g <> g)").select("h", "g", F.col("w.h").alias("other"), F.col("w.g").alias("more")).distinct()
    more = _few_edits(both.where(F.length("s") >= STEP - MOST), member.where("key % 2 <> 0"))
    gone = staged(_within(pair, text).unionAll(more).distinct(), "neighbours")
    # a line with a neighbour goes wherever it stands; an equal line but for the first place
    out = every.join(first.where("c > 1").select("h", "g", "at"), ["h", "g"]).where(F.col("at") < where).select("id", "line", F.lit(False).alias("near"))
    out = out.unionAll(first.join(gone, ["h", "g"], "left_semi").select("at.id", "at.line", F.lit(True)))
    out = staged(out.distinct(), "removed")
    unstage(every, first, member, both, keys, made, gone, more)
    return out


def _low_bits(hashes: DataFrame) -> np.ndarray:
    """Which low bits of h occur: 2^BITMAP bits, however many rows."""
    pos = F.col("h").bitwiseAND(F.lit((1 << BITMAP) - 1)) + 1  # Spark's bitmap buckets count from 1
    got = hashes.select(pos.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for b, m in got:
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(m)] = np.frombuffer(bytes(m), np.uint8)
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column's texts without the lines in the second."""
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and gone:
                drop = set(gone)
                text = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in drop)
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the lines (id, line) taken out of text, and n_chars, where there is one, counted again."""
    own, lines = fresh(docs, "id"), fresh(docs, "gone")
    listed = gone.groupBy(F.col("id").alias(own)).agg(F.collect_list("line").alias(lines))
    rest = [c for c in docs.columns if c != "text"]
    both = docs.join(listed, docs["doc_id"].try_cast("long") == listed[own], "left")
    changed = both.where(F.col(lines).isNotNull()).select("text", lines, *[f"`{c}`" for c in rest])
    schema = ", ".join(["text string", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]])
    out = arrow(changed, _without, schema)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    names = [f"`{c}`" for c in docs.columns]
    same = both.where(F.col(lines).isNull()).select(*names)
    return same.unionByName(out.select(*names))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a document that had lines and has none left but blank ones goes."""
    gone = removed_lines(docs)
    out = without_lines(docs, gone)
    blank = out.where(F.col("text").isNotNull() & ~F.col("text").rlike(r"\S")).select(F.col("doc_id").try_cast("long").alias("id")).join(gone.select("id").distinct(), "id", "left_semi").distinct()
    return out.join(blank, out["doc_id"].try_cast("long") == blank["id"], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lists = batch.column(2).to_pylist()
        n, crc = [], []
        for text, gone in zip(texts, lists, strict=True):
            if text is None:
                n.append(0)
                crc.append(0)
                continue
            drop = {g["line"] for g in gone or ()}
            lines = text.split("\n")
            n.append(len(lines))
            crc.append(zlib.crc32("\n".join(s for i, s in enumerate(lines) if i not in drop).encode("utf-8", "surrogatepass")))
        equal = [sum(not g["near"] for g in x or ()) for x in lists]
        near = [sum(g["near"] for g in x or ()) for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, equal, near, crc)]], ["doc_id", "n_lines", "n_equal", "n_near", "kept_crc32"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near (lines that go, of each kind), kept_crc32 (of what stays) of each row of docs."""
    docs = docs.select("doc_id", "text")
    gone = removed_lines(docs).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("line", "near")).alias("_gone"))
    both = docs.join(gone, docs["doc_id"].try_cast("long") == gone["_id"], "left").select("doc_id", "text", "_gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(both, _digest, f"doc_id {kind}, n_lines long, n_equal long, n_near long, kept_crc32 long")


def op9_linededup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near, kept_crc32 of all of documents; see the module for the cases."""
    return digest(read(spark, sf_dir, "documents"))
