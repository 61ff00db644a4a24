"""License scans, spelling variants and the conversation trie, each against plain Python that compares everything with everything."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barweave.llm import licenses, registry, spelling, trie  # noqa: E402
from oracle import connect, of_duck, of_spark  # noqa: E402


@pytest.mark.parametrize("name", ["op11_licenses", "op12_spelling", "op13_trie"])
def test_query_equals_sql(spark, sf_dir, name):
    got, want = of_spark(registry.queries()[name](spark, sf_dir)), of_duck(connect(sf_dir), registry.oracle_sql()[name])
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [r for r, w in zip(got[1], want[1], strict=True) if r != w] == []


def at(tmp_path, df, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- licenses ---------------------------------------------------------------------------------------


def scanned(text, notices):
    w = licenses.words(text or "")
    phrases = sorted((i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    blocks = []
    for label, notice in notices:
        t, s = licenses.words(notice), licenses.span(len(licenses.words(notice)))
        for k in range(0, len(w), s):
            n = len(set(t) & set(w[k : k + 2 * s]))
            if n >= licenses.SHARE * len(set(t)) - 1e-9:
                blocks.append((k, min(k + 2 * s, len(w)), label, n / len(set(t))))
    return len(w), phrases, sorted(blocks)


def test_licenses_equal_all_blocks_by_all_notices(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(licenses, "AT_ONCE", 5000)
    monkeypatch.setattr(licenses, "PAIRS", 300)
    rng = random.Random(5)
    common = [w for _, t in licenses.NOTICES for w in t.split()]
    texts = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < i / 150 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.NOTICES)[1].split()
            for _ in range(rng.randrange(4)):
                notice[rng.randrange(len(notice))] = "other"
            k = rng.randrange(len(words) + 1)
            words[k:k] = notice
        texts.append(rng.choice([" ", "\n", " - "]).join(words))
    texts += [licenses.NOTICES[0][1].upper(), "CC BY CC-BY cc.by ccby", "general public license general public", "all rights reserved" * 2, "ÀLL rights reserved", "the mit license", None, ""]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, license long, n_words long")
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) and all(r.license == 1 and r.n_words == 2 for r in got)
    hit = 0
    for r in got:
        found = r["license_"]
        have = found.n_words, sorted((p.start, p.label) for p in found.phrases), sorted((b.start, b.end, b.label, b.share) for b in found.blocks)
        assert have == scanned(texts[r.doc_id], licenses.NOTICES), r.doc_id
        hit += bool(have[2])
    assert 60 < hit < 150
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == odd.count()


def test_licenses_digest_of_odd_rows(spark, odd, tmp_path):
    more = spark.createDataFrame([(20, "x All rights\nReserved. y all rights reserved"), (21, "x\nReleased under the MIT License."), (22, "mit license under the sea, released")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in licenses.op11_licenses(spark, at(tmp_path, odd.unionByName(more, allowMissingColumns=True), "documents")).collect()}
    assert len([1 for i, _ in got]) == odd.select("doc_id", "text").distinct().count() + 3
    r = got[20, 8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 1, 5, "reserved", "reserved", 1.0)
    r = got[21, 6]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, None, None, "", "mit", 1.0)
    assert got[2, 0].score == 0 and got[2, 0].labels == ""


def test_licenses_refuse_too_many_words(monkeypatch):
    monkeypatch.setattr(licenses, "MOST_WORDS", 5)
    with pytest.raises(ValueError, match="several calls"):
        licenses.Index(licenses.NOTICES, [])
    with pytest.raises(ValueError, match="without words"):
        licenses.Index([("x", "...")], [])


# --- spelling ---------------------------------------------------------------------------------------


def are_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def respelt(n):
    near = {w: [o for o in n if are_near(w, o)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(3)
    n = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(7, 10)))
        n[w] = rng.choice([2, 3, 40, 500, 500, 6000, 70000])
        for _ in range(4):
            k = rng.randrange(len(w))
            v = w[:k] + rng.choice(["", "a", "bb", "ÿ"]) + w[k + 1 :]
            if len(v) >= 7:
                n.setdefault(v, rng.choice([2, 4, 50, 700]))
    long = "".join(rng.choice("acgt") for _ in range(3000))
    n |= {long: 100, long[:-1]: 7, long[1:]: 10, long[:1500] + "x" + long[1501:]: 10, long[:1500] + long[1501:]: 9, "aaaaaaaa": 100, "aaaaaaa": 5, "aaaaaaaaa": 5}
    return n


def test_variants_equal_all_pairs(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 1000)
    words = spark.createDataFrame([(w, n, 0) for w, n in vocabulary.items()], "word string, n long, rank long")
    got = spelling.variants(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = respelt(vocabulary)
    assert set(map(tuple, got.collect())) == want
    assert max(n for *_, n, _ in want) > 3 and any(form and root != form for _, form, root, *_ in want)  # chains too
    assert spelling.variants(words.limit(0)).count() == 0


def test_words_of_texts(spark, odd, empty, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Ananble", "ÀNANBLE", "ananbles", "straße×ab", "thinthin", "thinthim", "short", "abcdefg9"]) + rng.choice([".", "", "1"]) for _ in range(60)) for _ in range(40)]
    rows = [(i % 37 if i else None, t) for i, t in enumerate([*texts, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd, allowMissingColumns=True)
    n = Counter()
    for r in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    want = respelt({w: k for w, k in n.items() if len(w) >= 7 and k >= 2})
    assert len(want) > 8
    assert set(map(tuple, spelling.op12_spelling(spark, at(tmp_path, docs, "documents")).collect())) == want
    assert spelling.op12_spelling(spark, at(tmp_path / "none", empty, "documents")).count() == 0


# --- trie -------------------------------------------------------------------------------------------


def nodes(sequences):
    """Each node of the trie of {conv_id: tuple of (role, text)} by comparing every prefix with every other."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, sha))
    return out


def in_order(rows):
    key = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        key.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    return {c: tuple(x[-1] for x in sorted(v)) for c, v in key.items() if c is not None}


def test_trie_equals_all_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 4)
    monkeypatch.setattr(trie, "HOT", 9)
    rng = random.Random(2)
    rows = []
    for c in [*range(130), *range(199, 330, 2), 100, 1000, None, None]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "😀", "", None]), c, "x"))
    rows += [(5, 3, "user", "a", 1, "k")] * 3
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, key string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order([r[:4] for r in rows])
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, ())[:h] + s[h:]
    assert () in built.values() or any(len(s) == 0 for s in built.values())  # turnless ones
    got = trie.op13_trie(spark, str(tmp_path)).collect()
    assert set(map(tuple, got)) == nodes(built) and len(got) == len(nodes(built))


def test_trie_of_long_and_equal_conversations(spark):
    """A chain of beginnings, copies, one long conversation twice: plain sums, and no explosion by the square of the length."""
    sequences = {c: tuple(("u", f"{k % 7}") for k in range(c % 40)) for c in range(60)}
    sequences[100] = sequences[101] = tuple(("u", f"long {k}") for k in range(400))
    rows = [(c, k + 1, f"{r}{x}".encode(), len(x)) for c, s in sequences.items() for k, (r, x) in enumerate(s)] + [(c, 0, None, 0) for c in sequences]
    got = trie.trie(spark.createDataFrame(rows, "conv_id long, pos int, key binary, chars long"))
    assert set(map(tuple, got.collect())) == nodes(sequences)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op13_trie(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
