"""Toxicity, quality and language model: held-out results on the test tables, normalisation, odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import lm, quality, toxicity

def everything():
    return F.lit(True)


def documents(spark, n=400):
    rng = np.random.default_rng(3)
    words = ["tar", "mel", "sov", "rin", "kap", "lon", "bed", "fis"]
    rows = []
    for i in range(n):
        text = [words[k] + words[j] for k, j in rng.integers(0, 8, (40, 2))]
        toxic, junk = i % 4 == 0, i % 3 == 0
        if toxic:
            for k in range(0, 40, 8):
                text[k] = "zurg" + words[int(rng.integers(0, 8))]
        if junk:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), int(not junk), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_toxicity_finds_held_out_expressions(spark):
    docs, labels = documents(spark)
    got = toxicity.apply_to(docs, toxicity.train(docs, labels, F.col("doc_id") % 2 == 0)).join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95


def grams_of(texts):
    """Counts of n-grams in plain Python: white space and what precedes a text are 0."""
    seen = Counter()
    for t in texts:
        x = [0] * (toxicity.ORDER - 1) + [0 if c in b" \t\n\r\x0b\x0c" else c for c in t.encode().lower()]
        seen.update(tuple(x[k : k + toxicity.ORDER]) for k in range(len(x) - toxicity.ORDER + 1))
    return seen


def brute_kneser_ney(classes):
    """P(class, n-gram's last symbol | its others) by the textbook's recursion; lower orders shared by the classes."""
    counts = {toxicity.ORDER: [grams_of(t) for t in classes]}
    for k in range(toxicity.ORDER - 1, 0, -1):
        if k == toxicity.SHARED:
            counts[k] = [Counter(g[1:] for g in set(counts[k + 1][0]) | set(counts[k + 1][1]))]
        else:
            counts[k] = [Counter(g[1:] for g in c) for c in counts[k + 1]]

    def prob(c, gram):
        if not gram:
            return 1 / 256
        n = counts[len(gram)][min(c, len(counts[len(gram)]) - 1)]
        ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        after = {g: v for g, v in n.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        low = prob(c, gram[1:])
        return max(n.get(gram, 0) - d, 0) / total + d * len(after) / total * low if total else low

    return prob


CLASSES = (["the cat sat on the mat", "a cat and a dog", "Caf\u00e9 \u0416"], ["you cat you rat", "rat on the mat, rat", "you you"])


def test_toxicity_equals_textbook_kneser_ney():
    per_class = [grams_of(t) for t in CLASSES]
    code = {g: sum(c << toxicity.BITS * (toxicity.ORDER - 1 - k) for k, c in enumerate(g)) for n in per_class for g in n}
    data = [c for t in CLASSES for x in t for c in x.encode()]
    texts = [x.encode() for t in CLASSES for x in t]
    off = np.cumsum([0, *map(len, texts)])
    assert set(toxicity.codes(np.array(data, np.uint8), off).tolist()) == set(code.values())
    gram = np.array(sorted(code.values()))
    by_code = {v: g for g, v in code.items()}
    count = np.array([[n[by_code[v]] for v in gram.tolist()] for n in per_class], float)
    prob = brute_kneser_ney(CLASSES)
    made = toxicity.estimate(gram, count)
    for k in range(1, toxicity.ORDER + 1):
        keys, p, _, _ = made[k]
        for i, v in enumerate(keys.tolist()):
            g = tuple(v >> toxicity.BITS * (k - 1 - j) & 255 for j in range(k))
            for c in range(len(p)):
                assert p[c, i] == pytest.approx(prob(c, g), abs=1e-9)
    model = toxicity.kneser_ney(gram, count)
    for t in ("rat the", "zebra cat", "Caf\u00e9"):
        raw = np.frombuffer(t.encode(), np.uint8)
        x = [0] * (toxicity.ORDER - 1) + [0 if c == 32 else c for c in t.encode().lower()]
        want = np.mean([math.log(prob(1, tuple(x[k : k + toxicity.ORDER])) / prob(0, tuple(x[k : k + toxicity.ORDER]))) for k in range(len(raw))])
        assert model.of_bytes(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-5)


def test_toxicity_probabilities_add_up():
    prob = brute_kneser_ney(CLASSES)
    for context in ((0, 0, 0, 0), tuple(b"cat "[:3]) + (0,), tuple(b"zzzz"), tuple(b"you") + (0,)):
        for c in (0, 1):
            assert sum(prob(c, (*context, x)) for x in range(256)) == pytest.approx(1, abs=1e-9)


def test_toxicity_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 5000))
    t = toxicity.Table(keys, keys / 7)
    v, found = t.get(keys)
    assert found.all() and v == pytest.approx(keys / 7, rel=1e-6)
    assert not t.get(np.setdiff1d(np.arange(1000), keys))[1].any()


def test_toxicity_odd(spark, odd, empty):
    _, labels = documents(spark)
    for df in (odd, empty):
        model = toxicity.train(df, labels, everything())
        out = toxicity.apply_to(df, model, "_toxic")
        assert out.columns == [*df.columns, "_toxic"] and out.count() == df.count()
        assert all(0 <= r[0] <= 1 for r in out.select("_toxic").collect())
    none = labels.where("false")
    assert {r.score for r in toxicity.apply_to(odd.select("doc_id", "text"), toxicity.train(odd, none, everything())).collect()} == {0.0}


def test_quality_learns_marks_and_case(spark):
    docs, labels = documents(spark)
    got = quality.apply_to(docs, quality.train(docs, labels, F.col("doc_id") % 2 == 0)).join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.95


def test_quality_features_are_words_and_code_point_grams():
    """The same groups of equal features as plain Python finds, text by text."""
    texts = ["the the cat", "", "caf\u00e9 caf\u00e8 \u65e5\u672c\u8a9e\U0001f600x", " a\n", "xyz", "\u00e9", "na\u00efve na"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    bucket, row = quality.features(np.frombuffer(b"".join(raw), np.uint8), off)
    seen = {}
    for r, t in enumerate(texts):
        words = t.split()
        want = [("w", w) for w in words] + [("pair", a, b) for a, b in zip(words, words[1:], strict=False)] + [("again",) for a, b in zip(words, words[1:], strict=False) if a == b]
        for w in words:
            w = f" {w} "
            want += [(k, w[i : i + k]) for k in quality.GRAMS for i in range(len(w) - k + 1) if k < len(w)]  # a whole word is one already
        got = bucket[row == r].tolist()
        assert len(got) == len(want)
        seen.setdefault("got", []).extend(got)
        seen.setdefault("want", []).extend(want)
    # no two features of these few meet in a bucket, so kinds can be matched by how often and where they occur
    assert len(set(seen["got"])) == len(set(seen["want"]))
    assert sorted(seen["got"].count(b) for b in set(seen["got"])) == sorted(seen["want"].count(f) for f in set(seen["want"]))


def test_quality_step_is_the_gradients():
    """One step on one text, in plain Python: the softmax's gradient, a row's own scaled as the docstring of the step says."""
    bag = (np.array([3, 8], np.int32), np.array([0.25, 0.75], np.float32))
    size = quality.TrainSize(epochs=1, batch=1, rate=0.5)
    model = quality.descend([bag, bag], np.array([1, 0]), size)
    rng = np.random.default_rng(size.seed)
    table = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (1 << quality.BITS, quality.WIDTH)).astype(np.float32).astype(float)
    out, bias, truth = [[0.0] * quality.WIDTH, [0.0] * quality.WIDTH], [math.log(0.5)] * 2, [1, 0]
    for step, i in enumerate(rng.permutation(2)):
        rate = 0.5 * (1 - step / 2)
        mean = [sum(s * table[k][d] for k, s in zip(*bag, strict=True)) for d in range(quality.WIDTH)]
        logit = [sum(m * o for m, o in zip(mean, out[c], strict=True)) + bias[c] for c in (0, 1)]
        p = [math.exp(z) / sum(math.exp(q) for q in logit) - (c == truth[i]) for c, z in enumerate(logit)]
        back = [sum(p[c] * out[c][d] for c in (0, 1)) for d in range(quality.WIDTH)]
        for c in (0, 1):
            out[c] = [o - rate * p[c] * m for o, m in zip(out[c], mean, strict=True)]
            bias[c] -= rate * p[c]
        for k, s in zip(*bag, strict=True):
            table[k] -= [rate * b * s / math.sqrt(0.25**2 + 0.75**2) for b in back]
    weight = [sum(table[k][d] * (out[1][d] - out[0][d]) for d in range(quality.WIDTH)) for k in (3, 8)]
    assert model.weight[[3, 8]] == pytest.approx(weight, rel=1e-3) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_quality_sample_is_bounded_in_bytes(spark):
    docs, labels = documents(spark)
    few = quality.train(docs, labels, everything(), quality.TrainSize(bytes=0))
    assert not few.weight.any()


def test_quality_odd(spark, odd, empty):
    docs, labels = documents(spark)
    model = quality.train(docs, labels, everything())
    assert quality.apply_to(odd, model).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in quality.apply_to(odd, model).collect())
    assert quality.apply_to(empty, quality.train(empty, labels, everything())).count() == 0


def lm_start(k, rng):
    prob, inner = rng.random(k), rng.random((lm.FAMILIES, lm.FAMILIES))
    return prob / prob.sum(), (inner / inner.sum(1, keepdims=True)).ravel()


def test_lm_is_normalised_over_units_and_branches():
    rng = np.random.default_rng(2)
    k = lm.FIRST + 30
    p = lm.Params(lm.start(*lm_start(k, rng)), k)
    unit = np.concatenate([[lm.END], 1 + np.repeat(np.arange(lm.FAMILIES), lm.FAMILIES), np.arange(lm.FIRST, k)])
    branch = np.where((unit >= 1) & (unit < lm.FIRST), np.arange(len(unit)) - 1, -1)
    one, two = np.full(len(unit), 4), np.full(len(unit), k)
    assert (10 ** lm.log_probability(p, one, two, unit, branch)).sum() == pytest.approx(1, abs=1e-5)


def test_lm_sums_of_all_pairs_are_those_of_single_ones():
    rng = np.random.default_rng(4)
    k = lm.FIRST + 300
    p = lm.Params(lm.start(*lm_start(k, rng)), k)
    p.r[5], p.r[6] = 400 * np.sign(p.q[40]), 400 * np.sign(p.q[41])  # no large logit in common: products of exponentials vanish
    by, low = lm.Logits(p), 0
    for two in (0, 6, 40, k):
        z = (p.hidden(np.arange(k + 1), np.full(k + 1, two)) @ p.q.T + p.b).astype(np.float64)
        top = z.max(1)
        assert by.log_z[:, two] == pytest.approx(top + np.log(np.exp(z - top[:, None]).sum(1)), rel=1e-5, abs=1e-4)
        parted = by.one.max(1).astype(np.float64) + by.two[two].max()
        low += int((top - parted < -460).sum())
    assert low  # the rule for what vanishes was needed


def test_lm_scoring_a_pair_again_is_no_matrix_product():
    """Over different pairs of words, as of a large table: at most a third of the time of one row over all units for each pair."""
    import time

    rng = np.random.default_rng(6)
    k, n = lm.FIRST + lm.WORDS, 100_000
    p = lm.Params(lm.start(*lm_start(k, rng)), k)
    one, two, target = rng.integers(lm.FIRST, k, (3, n))

    def plain():
        h = p.hidden(one, two)
        for a in range(0, n, 4096):
            z = h[a : a + 4096] @ p.q.T + p.b
            np.exp(z - z.max(1)[:, None], out=z).sum(1)

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    every = took(plain)
    assert took(lambda: lm.log_probability(p, one, two, target, np.full(n, -1))) < every / 3


def test_lm_draws_as_a_search_does_and_sums_rows():
    rng = np.random.default_rng(8)
    inner = rng.random((lm.FAMILIES, lm.FAMILIES)) ** 40 + 1e-12  # most branches far smaller than a cell
    cumulated = np.cumsum(inner / inner.sum(1, keepdims=True), 1).ravel() + np.repeat(np.arange(lm.FAMILIES), lm.FAMILIES)
    x = np.concatenate([rng.random(20_000) * lm.FAMILIES, cumulated, [0.0, float(lm.FAMILIES)]])
    assert (lm.drawn(cumulated)(x) == np.searchsorted(cumulated, x)).all()
    at, rows = rng.integers(0, 50, 999), rng.normal(size=(999, lm.WIDTH)).astype(np.float32)
    want = np.zeros((50, lm.WIDTH), np.float32)
    np.add.at(want, at, rows)
    assert (lm.sums(50)(at, rows) == want).all()
    assert (lm.sums(50)(at[:0], rows[:0]) == 0).all()


def test_lm_branches_are_those_of_the_words():
    import pyarrow as pa

    column = pa.array(["a bc def", "", None, " x\ty\n", "Zz\u00e9 \u00e9", "end"])
    for a, b, words, branch in lm.tokens(column):
        flat = [w for ws in words for w in ws]
        assert (a, b) == (0, 6) and branch.tolist() == [lm.branch_of(w) if w else -1 for w in flat]


def test_lm_training_helps():
    rng = np.random.default_rng(5)
    k = lm.FIRST + 7
    ids = np.array([lm.FIRST + (i * 3 + int(rng.random() < 0.1)) % 7 for i in range(20_000)])
    branch = np.full(len(ids), -1)
    far = np.arange(5, len(ids), 5)  # a word of a family, its branch told by the word before it
    branch[far] = 3 * lm.FAMILIES + ids[far - 1] % lm.FAMILIES
    ids[far] = 4
    prob = np.bincount(ids, minlength=k) + 0.5
    prob, inner = prob / prob.sum(), np.full(lm.FAMILIES**2, 1 / lm.FAMILIES)
    flat = lm.start(prob, inner)
    one, two = lm.contexts(ids, np.array([len(ids)]), k)
    before = lm.log_probability(lm.Params(flat, k), one, two, ids, branch)
    lm.descend(flat, prob, inner, one, two, ids, branch, np.ones(len(flat), np.float32), rng)
    after = lm.log_probability(lm.Params(flat, k), one, two, ids, branch)
    assert after.mean() > before.mean() + 0.2 and after[far].mean() > before[far].mean() + 0.3


def test_lm_words_of_a_context_add_up(spark):
    """Scores of one-word texts: all seen words, the end before them left out, and the unseen share, make 1."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb aa", "cc", "bb aa dd ee", "", "ffz"])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(df, everything()).collect()}
    assert all(s < 0 for s in got.values())
    assert got[3] > got[0]


def test_lm_base_and_totals(spark, odd, empty):
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    got = lm.score_texts(odd, learn).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    words = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, words, strict=True) if i is None or i % 2 == 0 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, words, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score_texts(empty, learn).count() == 0


def test_folds_are_those_of_crc32(spark):
    from barweave.llm.common import id_crc

    df = spark.createDataFrame([(i,) for i in (0, 7, 123, None)], "doc_id long")
    assert [r[0] for r in df.select(id_crc("doc_id")).collect()] == [zlib.crc32(x) for x in (b"0", b"7", b"123", b"")]
