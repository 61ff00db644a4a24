"""Near-duplicate texts, vectors and lines, and search, against brute force; odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import common, linededup, neardup_text, neardup_vectors, search


def unite(ids, links):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def texts(spark, n=120):
    rng = random.Random(1)
    rows, i = [], 0
    for g in range(n // 6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(t)))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, j) for j in range(500, 560)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "u long, v long"), "t").collect())
    assert got == {**{i: 0 for i in range(51)}, **{j: 500 for j in range(500, 560)}, 1000: 500}


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    key = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    keys, rows = np.concatenate([key[a > 0], key[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sign = neardup_text.bag_minhash(keys, rows, np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    assert (sign[0] == sign[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_near_texts_equal_brute_force(spark):
    df = texts(spark)
    rows = {r.doc_id: bag(r.text) for r in df.collect()}
    links = [(a, b) for a in rows for b in rows if b < a and (o := sum((rows[a] & rows[b]).values())) >= 0.8 * sum((rows[a] | rows[b]).values()) and o]
    got = {r.doc_id: r.component_id for r in neardup_text.near_duplicates(df).collect()}
    assert got == unite(rows, links)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup_text, "FEW", 2)
    monkeypatch.setattr(neardup_text, "BLOCK", 3)
    df = texts(spark, 60)
    rows = {r.doc_id: bag(r.text) for r in df.collect()}
    links = [(a, b) for a in rows for b in rows if b < a and sum((rows[a] & rows[b]).values()) >= 0.8 * sum((rows[a] | rows[b]).values())]
    assert {r.doc_id: r.component_id for r in neardup_text.near_duplicates(df).collect()} == unite(rows, links)


def test_near_texts_odd(odd, empty):
    got = {(r.doc_id, r.component_id) for r in neardup_text.near_duplicates(odd).collect()}
    assert {(1, 1), (6, 1), (2, 2), (3, 3), (4, 4), (5, 5)} <= got
    kept = neardup_text.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect())[0] == -1 and kept.where("doc_id = 6").count() == 0
    assert neardup_text.keep_one(empty).count() == 0


def lines_brute(rows):
    every = sorted((i, k, s) for i, t in rows if i is not None and t is not None for k, s in enumerate(t.split("\n")) if s.strip())
    first, gone = {}, {}
    for i, k, s in every:
        if first.setdefault(s, (i, k)) != (i, k):
            gone[i, k] = False

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1 or linededup.edits(len(b)) < 1:
            return False
        j = next((j for j in range(len(a)) if a[j] != b[j]), len(a))
        return a[j + (len(a) == len(b)) :] == b[j + 1 :]

    for a, at in first.items():
        if any(w < at and a != b and one_edit(a, b) for b, w in first.items()):
            gone[at] = True
    return gone


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        made = []
        for _ in range(5):
            s = list("the line number seven of many" if rng.random() < 0.6 else "".join(rng.choice("abé ") for _ in range(rng.randrange(10, 30))))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(s))
                s[k : k + rng.randrange(2)] = rng.choice(["", "x", "😀"])
            made.append("".join(s))
        rows.append((i, "\n".join(made)))
    got = {(r.id, r.line): r.near for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_brute(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_equals_the_table_of_prefixes():
    rng = random.Random(3)
    a = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    b = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) if rng.random() < 0.5 else s[: rng.randrange(12)] + "c" + s[rng.randrange(12) :] for s in a]
    points, _, _, begin, end = linededup.lines_of(a + b)
    h, n = linededup.Hashed(points, 0), end - begin
    got = linededup.edit_distance(h, begin[:400], n[:400], begin[400:], n[400:])
    assert got.tolist() == [min(distance(x, y), linededup.MOST + 1) for x, y in zip(a, b, strict=True)]


def test_edit_distance_stops_at_the_bound_of_each_pair():
    rng = random.Random(5)
    a = ["".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(600)]
    b = [s[: rng.randrange(14)] + rng.choice(["", "c", "ab"]) + s[rng.randrange(14) :] for s in a]
    most = np.array([rng.randrange(linededup.MOST + 1) for _ in a])
    points, _, _, begin, end = linededup.lines_of(a + b)
    h, n = linededup.Hashed(points, 0), end - begin
    got = linededup.edit_distance(h, begin[:600], n[:600], begin[600:], n[600:], most)
    assert got.tolist() == [min(distance(x, y), k + 1) for x, y, k in zip(a, b, most.tolist(), strict=True)]
    assert len(linededup.edit_distance(h, begin[:0], n[:0], begin[:0], n[:0])) == 0


def test_equal_lines_of_a_task_give_their_keys_once():
    import pyarrow as pa

    short, long, once = "a line under forty points", "a line of more than forty code points, which is cut into parts", "one that stands only once"
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([f"{short}\n{long}\n{short}", long])], ["id", "text"]), pa.RecordBatch.from_arrays([pa.array([3]), pa.array([f"{short}\n{once}\n\n{long}"])], ["id", "text"])]
    rows = [r for b in linededup._first_pass(iter(batches)) for r in b.to_pylist()]
    assert [(r["id"], r["line"]) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 3)]
    assert [bool(r["keys"]) for r in rows] == [True, True, False, False, False, True, False]
    alone = [r for b in linededup._first_pass(iter([pa.RecordBatch.from_arrays([pa.array([9]), pa.array([long])], ["id", "text"])])) for r in b.to_pylist()]
    assert rows[1]["keys"] == alone[0]["keys"] and rows[1]["h"] == rows[3]["h"] == alone[0]["h"] and rows[1]["g"] == alone[0]["g"]


def few_edits_brute(rows):
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    return {i for a, i in first.items() if any(j < i and abs(len(a) - len(b)) <= 5 and distance(a, b) <= linededup.edits(max(len(a), len(b))) for b, j in first.items())}


@pytest.mark.parametrize("large", [2048, 4])
def test_longer_lines_allow_more_edits(spark, monkeypatch, large):
    monkeypatch.setattr(linededup, "LARGE", large)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (36, 39, 44, 80, 81, 118, 122, 165, 240)]
    rows = []
    for i in range(140):
        s = list(base[rng.randrange(len(base))])
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "x", "😀"])
        rows.append((i, "".join(s)))
    word = "It is a truth long known that of all those who came to see the show none ever went"
    rows += [(1000, word), (1001, word.replace(" of ", " in ")), (1002, word.replace("none", "kids"))]
    got = {r.id for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("near").collect()}
    assert got == few_edits_brute(rows)
    assert 1001 in got and 1002 not in got


def test_short_lines_allow_one_edit_for_each_eighth(spark):
    rows = [(1, "a"), (2, "b"), (3, "nine: 01."), (4, "nine: 02."), (5, "seven 1"), (6, "seven 2"), (7, "item 0001"), (8, "item 001")]
    got = {r.id for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {4, 8}


def test_digest_equals_the_lines_taken_out(spark):
    import zlib

    rows = [(1, "one line that stands here\nb"), (2, "one line that stands her\nb\nc"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = lines_brute(rows)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n") if t is not None else []
        left = "\n".join(s for k, s in enumerate(lines) if (i, k) not in gone)
        want.append((i, len(lines), sum(gone.get((i, k)) is False for k in range(9)), sum(gone.get((i, k)) is True for k in range(9)), zlib.crc32(left.encode())))
    assert sorted(tuple(r) for r in linededup.digest(df).collect()) == want


def test_lines_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {(r.id, r.line): r.near for r in linededup.removed_lines(odd).collect()}
    assert {k for k in got} == {k for k in lines_brute(list(dict.fromkeys(rows)))}
    out = linededup.dedup(odd)
    assert out.columns == odd.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert 6 not in kept and kept[2].text is None and kept[3].text == "" and kept[7].text.startswith("The quick brown cat") and kept[7].n_chars == len(kept[7].text)
    assert linededup.dedup(empty).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, h string, n long")


def odd_vectors():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 16))
    rows = [(k, [float(np.float32(x)) for x in base[k % 20] + 0.12 * rng.standard_normal(16)], 1, 1, "h", 2) for k in range(200)]
    rows += [(200 + k, rows[0][1], None, None, None, None) for k in range(30)]
    rows += [(300, None, 1, 1, "h", 2), (301, [0.0] * 16, 1, 1, "h", 2), (302, [float("nan")] + [1.0] * 15, 1, 1, "h", 2), (303, [None] + [1.0] * 15, 1, 1, "h", 2), (304, [], 1, 1, "h", 2), (305, [float("inf")] * 16, 1, 1, "h", 2)]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = odd_vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(vectors(spark, rows)).collect()}
    x = np.array([r[1] for r in rows[:230]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = unite(range(230), [(int(a), int(b)) for a, b in np.argwhere(near)])
    assert {i: got[i][:2] for i in comp} == {i: (int(near[i].sum()), comp[i]) for i in comp}
    assert all(got[i] == (0, i, True) for i in range(300, 306))


def test_large_leaves_lose_no_pair(spark, monkeypatch):
    rows = odd_vectors()
    want = sorted(map(tuple, neardup_vectors.near_duplicates(vectors(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(neardup_vectors, "LEAF_CAP", 16)
    assert sorted(map(tuple, neardup_vectors.near_duplicates(vectors(spark, rows)).collect()), key=repr) == want


def test_search_equals_brute_force(spark):
    rows = odd_vectors()
    got = sorted(tuple(r) for r in search.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, 5, 256.0).collect())
    ok = {r[0]: np.floor(256 * np.array(r[1])) for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])}
    want = []
    for q in ok:
        if q % 10 == 0:
            pad = lambda v: np.pad(v, (0, 16 - len(v)))
            best = sorted((-int(pad(ok[c]) @ pad(ok[q])), c) for c in ok if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_search_probes_few_rows_to_the_end():
    """Most rows fall out on the way: counted on vectors of the kind of the test tables, without structure, and on clustered ones."""
    rng = np.random.default_rng(3)
    flat = np.floor(256 * rng.standard_normal((4000, 64)) / 8)
    near = np.floor(256 * (rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 64))) / 8)
    for x, most in ((flat, 0.65), (near, 0.5)):
        shard = search.Shard(np.arange(4000), x)
        for q in range(0, 4000, 200):
            ids, score = shard.top(q, x[q], 5)
            all_ = x @ x[q]
            all_[q] = -np.inf
            want = np.lexsort((np.arange(4000), -all_))[:5]
            assert ids.tolist() == want.tolist() and score.tolist() == all_[want].tolist()
        assert shard.products < most * 20 * 4000 * 64 and shard.full < 0.1 * 20 * 4000, (shard.products / (20 * 4000 * 64), shard.full / 80_000)


def test_search_keeps_rows_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [3.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [9.0, 0.0]), (8, None)]
    got = sorted(tuple(r) for r in search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, 1.0).collect())
    assert got == sorted([(50, 1, 50, 3), (50, 2, 7, 2), (50, 3, 7, 2), (50, 1, 7, 6), (50, 2, 7, 6), (50, 3, 50, 3)])


def test_search_and_vectors_on_empty_tables(spark):
    none = vectors(spark, [])
    assert search.top_k(none, F.col("vec_id") % 50 == 0, 5, 256.0).count() == 0
    assert neardup_vectors.near_duplicates(none).count() == 0


def test_hash_of_one_stretch_is_that_of_two_of_which_the_second_is_empty():
    rng = np.random.default_rng(3)
    h = linededup.Hashed(rng.integers(0, 70000, 5000).astype(np.uint32), 1)
    a = np.append(rng.integers(0, 5000, 999), 5000)
    b = np.append(rng.integers(a[:-1], 5001), 5000)
    assert (h.of(a, b) == h.joined(a, b, b, b)).all()
