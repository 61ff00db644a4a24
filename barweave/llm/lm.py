"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

The model predicts a word from the two before it: their vectors, each weighted by its place, add up to
a predicted vector, whose products with the vectors of all units, plus their biases, are the logits. Units
are the end of a text, the ``WORDS`` most frequent words, and ``FAMILIES`` families of all other words,
however many there are, by how they end; a family has as many branches, by how its words begin, with vectors
of their own. So every word has a probability that depends on its context: that of its unit, for a
word of a family times that of the branch in the family, times the word's share of the branch's counts,
with one half for a word never seen. The probabilities of all words add up to 1.

Training is by noise-contrastive estimation in numpy, units against noise from all units, branches
against noise from their family, over every training text, each used once: every task descends on its own
rows from the same start, and the parameters are averaged by their number of tokens, first on an eighth
of the texts, then on the rest. Scoring normalises exactly: over all units for all pairs of preceding words
by one matrix product a task, and for each word of a family over its branches.

Counts are exact over all training texts, those of branches too. The most frequent words, ``HEAD`` at most
(as many as a histogram of counts shows to fit), go to every worker; the others' counts meet their texts in
a join, which no word is frequent enough to make uneven.

Defined results: a null text is an empty one, the end alone. Repeated rows each get a row; a null doc_id
counts as the empty text when folds are dealt. Without training texts the base gives every token
probability 1, and the model is uniform over units and branches. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, arrow, id_crc, parts, read, staged, utf8

WORDS, WIDTH, HEAD = 1000, 24, 400_000
BATCH, NOISE, RATE, SHARES = 2048, 64, 0.08, 8
CHUNK, FLUSH = 1 << 21, 250_000
FAMILIES, FEW_NOISE = 32, 4
END, FIRST = 0, 1 + FAMILIES  # units: the end, families, words


#: The family or branch that a word's last or first bytes say: of two bytes, and of one.
OF_TWO = np.array([zlib.crc32(bytes(divmod(i, 256))) % FAMILIES for i in range(1 << 16)])
OF_ONE = np.array([zlib.crc32(bytes([i])) % FAMILIES for i in range(256)])


def branch_of(w: bytes) -> int:
    """The branch of a word, its family in the higher bits."""
    return zlib.crc32(w[-2:]) % FAMILIES * FAMILIES + zlib.crc32(w[:2]) % FAMILIES


def branches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """branch_of each word of the rows that begin at off, in order."""
    if not len(data):
        return np.zeros(0, np.int64)
    ink = np.concatenate([[False], ~SPACE[data], [False]])
    begins = np.zeros(len(data) + 1, bool)
    begins[off] = True  # a row is a border too
    first = np.flatnonzero(ink[1:-1] & (~ink[:-2] | begins[:-1]))
    last = np.flatnonzero(ink[1:-1] & (~ink[2:] | begins[1:]))
    x = data.astype(np.int64)
    nxt, before = x[np.minimum(first + 1, last)], x[np.maximum(last - 1, first)]
    end = np.where(first == last, OF_ONE[x[last]], OF_TWO[before << 8 | x[last]])
    return end * FAMILIES + np.where(first == last, OF_ONE[x[first]], OF_TWO[x[first] << 8 | nxt])


def units_of(words: list[bytes], branch: np.ndarray, index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's unit, and its branch or -1."""
    unit = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    return np.where(unit < 0, 1 + branch // FAMILIES, unit), np.where(unit < 0, branch, -1)


def texts(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """(first row, row after the last, their words, their bytes, where each begins in them), some rows at a time. A text's words are followed by its end, b""."""
    data, off = utf8(column)
    raw = data.tobytes().lower()  # bytes: A-Z alone
    for a, b in parts(off, CHUNK):
        words = [[*raw[off[i] : off[i + 1]].split(), b""] for i in range(a, b)]
        yield a, b, words, np.frombuffer(raw, np.uint8)[off[a] : off[b]], off[a : b + 1] - off[a]


def tokens(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray]]:
    """(first row, row after the last, their words, the words' branches), as texts gives them; the end is of branch -1."""
    for a, b, words, data, off in texts(column):
        ends = np.cumsum([len(w) for w in words])
        branch = np.full(ends[-1], -1, np.int64)
        inside = np.ones(len(branch), bool)
        inside[ends - 1] = False
        branch[inside] = branches(data, off)
        yield a, b, words, branch


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])
        seen.clear()
        return made

    for batch in batches:
        for _, _, words, *_ in texts(batch.column(0)):
            for w in words:
                seen.update(w)
            if len(seen) > FLUSH:
                yield out()
    yield out()


class Params:
    """C: weights of the two places; R, Q: vectors of units as context and as target; b: biases; Q2, b2: those of branches. One more context, for what precedes a text."""

    def __init__(self, flat: np.ndarray, k: int):
        self.k, d, m = k, WIDTH, FAMILIES * FAMILIES
        cut = np.cumsum([2 * d, (k + 1) * d, k * d, k, m * d])
        c, r, q, self.b, q2, self.b2 = np.split(flat, cut)
        self.c, self.r, self.q, self.q2 = c.reshape(2, d), r.reshape(k + 1, d), q.reshape(k, d), q2.reshape(m, d)

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c[0] + self.r[two] * self.c[1]


def start(prob: np.ndarray, inner: np.ndarray, seed: int = 11) -> np.ndarray:
    """inner: the probabilities of branches, those of each family adding up to 1."""
    rng = np.random.default_rng(seed)
    k = len(prob)
    return np.concatenate([np.ones(WIDTH), np.full(WIDTH, 0.5), rng.normal(0, 0.1, (2 * k + 1) * WIDTH), np.log(prob), rng.normal(0, 0.1, len(inner) * WIDTH), np.log(inner)]).astype(np.float32)


def contexts(ids: np.ndarray, ends: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each, blank before a text's first; two places before, all families are one."""
    one, two = np.full(len(ids), blank, ids.dtype), np.full(len(ids), blank, ids.dtype)
    one[1:], two[2:] = ids[:-1], np.where((ids[:-2] > END) & (ids[:-2] < FIRST), 1, ids[:-2])
    first = np.concatenate([[0], ends[:-1]])
    one[first] = blank
    two[first] = blank
    second = first[first + 1 < ends] + 1
    two[second] = blank
    return one, two


def sums(m: int):
    """A function that adds up rows by their places below m. Two neighbouring components go as one complex number, which halves what is added one by one."""
    half = WIDTH // 2
    place = np.arange(m)[:, None] * half + np.arange(half)

    def run(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(m * half, np.complex64)
        np.add.at(out, place.take(at, axis=0).ravel(), rows.view(np.complex64).ravel())
        return out.view(np.float32).reshape(m, WIDTH)

    return run


def drawn(cumulated: np.ndarray, cells: int = 1024):
    """np.searchsorted(cumulated, x) for x from 0 to FAMILIES: where its cell begins is looked up, and few have a border to pass."""
    guide = np.searchsorted(cumulated, np.arange(FAMILIES * cells + 1) / cells)
    ends = np.append(cumulated, np.inf)

    def run(x: np.ndarray) -> np.ndarray:
        flat = x.ravel()
        at = guide.take((flat * cells).astype(np.int64))
        on = np.flatnonzero(ends.take(at) < flat)
        while len(on):
            at[on] += 1
            on = on[ends[at[on]] < flat[on]]
        return at.reshape(x.shape)

    return run


def descend(flat: np.ndarray, prob: np.ndarray, inner: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray, branch: np.ndarray, square: np.ndarray, rng) -> None:
    """One pass in batches; flat and the sums of squared gradients change in place."""
    k, d, m = len(prob), WIDTH, FAMILIES * FAMILIES
    p, g = Params(flat, k), np.zeros_like(flat)
    into, step = Params(g, k), np.empty_like(flat)
    shift = (np.log(prob) + np.log(NOISE)).astype(np.float32)
    shift2 = (np.log(inner) + np.log(FEW_NOISE)).astype(np.float32)
    cumulated = np.cumsum(prob)
    draw = drawn(np.cumsum(inner.reshape(FAMILIES, FAMILIES), 1).ravel() + np.repeat(np.arange(FAMILIES), FAMILIES))
    by_unit, by_branch = sums(k + 1), sums(m)
    order = rng.permutation(len(target))
    rows = np.stack([one, two, target, branch], 1, dtype=np.int32, casting="same_kind")  # of a token, side by side

    def error(x: np.ndarray, y: float) -> np.ndarray:
        e = np.negative(x, dtype=np.float32)
        with np.errstate(over="ignore"):  # an infinite one stands for a probability of 0
            np.exp(e, out=e)
        e += 1
        np.reciprocal(e, out=e)
        return np.subtract(np.float32(y), e, out=e)

    for a in range(0, len(order), BATCH):
        c1, c2, t, own = rows.take(order[a : a + BATCH], axis=0).T.astype(np.int64)
        noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), k - 1)
        h = (p.r * p.c[0]).take(c1, axis=0) + (p.r * p.c[1]).take(c2, axis=0)
        qt, qn = p.q.take(t, axis=0), p.q[noise]
        up = error(np.einsum("nd,nd->n", h, qt) + (p.b - shift)[t], 1)
        down = error(h @ qn.T + (p.b[noise] - shift[noise]), 0)
        dh = up[:, None] * qt + down @ qn
        into.q[:] = by_unit(np.concatenate([t, noise]), np.concatenate([up[:, None] * h, down.T @ h]))[:k]
        into.b[:] = np.bincount(t, weights=up, minlength=k)
        np.add.at(into.b, noise, down.sum(0))
        # branches of the words that stand in a family, against some of the same family
        far = np.flatnonzero(own >= 0)
        own = own[far]
        first = (own // FAMILIES * FAMILIES)[:, None]
        other = np.clip(draw(rng.random((len(far), FEW_NOISE)) + (own // FAMILIES)[:, None]), first, first + FAMILIES - 1)
        some = np.concatenate([own[:, None], other], 1)
        q2, hf = p.q2.take(some, axis=0), h.take(far, axis=0)
        off = np.einsum("nsd,nd->ns", q2, hf) + (p.b2 - shift2)[some]
        pull = np.concatenate([error(off[:, :1], 1), error(off[:, 1:], 0)], 1)
        dh[far] += np.matmul(pull[:, None, :], q2)[:, 0]
        into.q2[:] = by_branch(some.ravel(), (pull[:, :, None] * hf[:, None, :]).reshape(-1, d))
        into.b2[:] = np.bincount(some.ravel(), weights=pull.ravel(), minlength=m)
        near, before = by_unit(c1, dh), by_unit(c2, dh)
        into.r[:] = near * p.c[0] + before * p.c[1]
        into.c[0], into.c[1] = (near * p.r).sum(0), (before * p.r).sum(0)
        square += np.multiply(g, g, out=step)
        np.sqrt(np.add(square, np.float32(1e-6), out=step), out=step)
        flat += np.float32(RATE) * np.divide(g, step, out=step)


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, prob, inner, flat = shared.value
        flat, square, n = flat.copy(), np.full(len(flat), 1.0, np.float32), 0
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for _, _, words, branch in tokens(batch.column(0)):
                ids, branch = units_of(list(chain.from_iterable(words)), branch, index)
                one, two = contexts(ids, np.cumsum([len(w) for w in words]), len(prob))
                descend(flat, prob, inner, one, two, ids, branch, square, rng)
                n += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["p", "n", "flat"])

    return run


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray | None]:
    total, flat = 0, None
    for n, raw in rows:
        if n:
            x = np.frombuffer(raw, np.float32).astype(np.float64) * n
            total, flat = total + n, x if flat is None else flat + x
    return total, None if flat is None else (flat / total).astype(np.float32)


def _averages(t: pa.Table) -> pa.Table:
    n, flat = _mean(list(zip(t.column("n").to_pylist(), t.column("flat").to_pylist(), strict=True)))
    return pa.table({"n": pa.array([n], pa.int64()), "flat": pa.array([b"" if flat is None else flat.tobytes()], pa.binary())})


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, count, prob, flat, mass = shared.value
        rank = _rank(head)
        k = len(prob)
        p = Params(flat, k)
        logits = Logits(p)
        log_count = np.log10(count + 0.5)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, words, branch in tokens(batch.column(1)):
                flat_words = list(chain.from_iterable(words))
                ends = np.cumsum([len(w) for w in words])
                doc = np.repeat(np.arange(b - a), np.diff(ends, prepend=0))
                at = np.fromiter(map(rank.get, flat_words, repeat(-1)), np.int64, len(flat_words))
                # ranks from 0 in order of counts; the end has its own unit wherever its rank is
                ids = np.where((at >= 0) & (at < k - FIRST), at + FIRST, -1)
                ids[ends - 1] = END
                far = np.flatnonzero(ids < 0)
                ids[far] = 1 + branch[far] // FAMILIES
                branch = np.where((ids >= 1) & (ids < FIRST), branch, -1)
                one, two = contexts(ids, ends, k)
                score = log_probability(p, one, two, ids, branch, logits)
                in_head = at >= 0
                base = np.where(in_head, log_count[np.maximum(at, 0)], 0.0)
                score[far] += base[far] - mass[branch[far]]
                tail = np.flatnonzero(~in_head)
                lists: list[dict[bytes, int]] = [{} for _ in range(b - a)]
                for i in tail.tolist():
                    d = lists[doc[i]]
                    d[flat_words[i]] = d.get(flat_words[i], 0) + 1
                sums = [np.bincount(doc, weights=x, minlength=b - a) for x in (base, score, in_head & (count[np.maximum(at, 0)] > 0))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(b - a)),
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(ends, prepend=0)),
                        pa.array(sums[2].astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([list(d.keys()) for d in lists], pa.list_(pa.binary())),
                        pa.array([list(d.values()) for d in lists], pa.list_(pa.int32())),
                    ],
                    ["row", "doc_id", "n", "known", "base", "score", "w", "m"],
                )
                row += b - a

    return run


_ranks: dict[int, dict[bytes, int]] = {}


def _rank(head: list[bytes]) -> dict[bytes, int]:
    if id(head) not in _ranks:
        _ranks.clear()
        _ranks[id(head)] = {w: i for i, w in enumerate(head)}
    return _ranks[id(head)]


class Logits:
    """What the unit before and the one before that add to the logits of units and of branches, and the log of the sum over all units for each two of them.

    The exponential of a sum is a product, so the sums of all pairs are one matrix product.
    """

    def __init__(self, p: Params):
        one, two = p.r * p.c[0], p.r * p.c[1]
        self.one, self.two = one @ p.q.T + p.b, two @ p.q.T
        self.one2, self.two2 = ((one @ p.q2.T + p.b2).reshape(-1, FAMILIES), (two @ p.q2.T).reshape(-1, FAMILIES))
        top = [x.max(1).astype(np.float64)[:, None] for x in (self.one, self.two)]
        a, b = np.exp(self.one - top[0]), np.exp(self.two - top[1])
        z = a @ b.T
        low = np.argwhere(z < 1e-200)  # the two have no large logit in common
        with np.errstate(divide="ignore"):
            self.log_z = np.log(z, out=z)
        self.log_z += top[0] + top[1].T
        for x in np.array_split(low, len(low) // 1024 + 1):
            both = self.one[x[:, 0]].astype(np.float64) + self.two[x[:, 1]]
            most = both.max(1)
            self.log_z[x[:, 0], x[:, 1]] = most + np.log(np.exp(both - most[:, None]).sum(1))


def log_probability(p: Params, one: np.ndarray, two: np.ndarray, target: np.ndarray, branch: np.ndarray, logits: Logits | None = None) -> np.ndarray:
    """log10 of the probability of each target unit after its two preceding ones, normalised over all units, and of its branch in its family."""
    by = logits or Logits(p)
    out = by.one[one, target].astype(np.float64) + by.two[two, target] - by.log_z[one, two]
    far = np.flatnonzero(branch >= 0)
    for a in range(0, len(far), 8192):
        i = far[a : a + 8192]
        family = branch[i] // FAMILIES
        z = by.one2.take(one[i] * FAMILIES + family, axis=0) + by.two2.take(two[i] * FAMILIES + family, axis=0)
        z -= z.max(1)[:, None]
        own = z[np.arange(len(i)), branch[i] % FAMILIES]
        out[i] += own - np.log(np.exp(z, out=z).sum(1))
    return out / np.log(10)


def _most_frequent(vocab: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, HEAD at most, by falling count: those above a count that a histogram tells."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(vocab.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True)  # eight for each doubling
    room, least = HEAD, None
    for b, n in sizes:
        room -= n
        if room < 0:
            break
        least = b
    top = (vocab.where("false") if least is None else vocab.where(step >= least)).toArrow()
    w, c = top.column("w").to_pylist(), top.column("c").to_numpy().astype(np.float64)
    order = sorted(range(len(w)), key=lambda i: (-c[i], w[i]))
    return [w[i] for i in order], c[order] if order else c


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text); learn: over doc_id, the training rows."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", "text")
    training = rows.where(learn)
    vocab = staged(arrow(training.select("text"), _counts, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c")), "lm-counts")
    total, kinds, ends = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("w") == 0, F.col("c"))), F.lit(0))).first()
    head, count = _most_frequent(vocab.where(F.length("w") > 0))
    words = min(WORDS, len(head))
    # the end goes last in rank so that ranks below WORDS are words
    head, count = [*head, b""], np.append(count, float(ends))
    # how much each branch's words count, the frequent ones apart, and one half for words never seen
    end, begin = (F.pmod(F.crc32(x), F.lit(FAMILIES)) for x in (F.substring("w", -2, 2), F.substring("w", 1, 2)))
    mass = np.full(FAMILIES * FAMILIES, 0.5)
    for b, c in vocab.where(F.length("w") > 0).groupBy((end * FAMILIES + begin).alias("b")).agg(F.sum(F.col("c") + 0.5)).collect():  # a row for each branch
        mass[b] += c
    np.subtract.at(mass, [branch_of(w) for w in head[:words]], count[:words] + 0.5)
    mass = np.maximum(mass, 0.5)
    by_family = mass.reshape(FAMILIES, FAMILIES)
    prob = np.concatenate([[ends + 0.5], by_family.sum(1), count[:words] + 0.5])
    prob /= prob.sum()
    inner = (by_family / by_family.sum(1, keepdims=True)).ravel()
    flat = start(prob, inner)
    index = {w: i + FIRST for i, w in enumerate(head[:words])} | {b"": END}
    share = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(SHARES)) == 0
    for part in (training.where(share), training.where(~share)):
        shared = sc.broadcast((index, prob, inner, flat))
        made = arrow(part.select("text"), _train(shared), "p long, n long, flat binary")
        groups = int(np.ceil(np.sqrt(max(1, part.rdd.getNumPartitions()))))
        made = made.groupBy(F.pmod("p", F.lit(groups)).alias("g")).applyInArrow(_averages, "n long, flat binary").toArrow()
        _, new = _mean(list(zip(made.column("n").to_pylist(), made.column("flat").to_pylist(), strict=True)))
        flat = flat if new is None else new
        shared.unpersist()
    shared = sc.broadcast((head, count, prob, flat, np.log10(mass)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = staged(arrow(rows, _scores(shared), f"row long, doc_id {kind}, n long, known long, base double, score double, w array<binary>, m array<int>"), "lm-scored")
    tail = scored.where(F.size("w") > 0).select("row", F.explode(F.arrays_zip("w", "m")).alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.m").alias("m"))
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(vocab, "w", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10(c + 0.5)).alias("t"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("k"), F.sum("m").alias("m"))
    denominator = float(np.log10(total + 0.5 * (kinds + 1)))
    t, k, m = (F.coalesce(x, F.lit(0)) for x in ("t", "k", "m"))
    out = scored.join(tail, "row", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + k).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + t - F.col("n") * denominator).alias("base_score"),
        (F.col("score") + t).alias("score"),
    )


def op3_lm(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all of documents; see the module for the cases."""
    fold = F.pmod(id_crc("doc_id"), F.lit(5))
    out = score_texts(read(spark, sf_dir, "documents"), fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
