"""Personal data, packing, pieces and the pipeline: against plain Python and the tokenizers' own libraries; odd inputs."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from barweave.llm import packing, pieces, pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
HARD = [
    "a@b.c_d@e.f g%h@i-j.k.l. x@y @z.w a.b@c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 9999999999999.1.1.1",
    "4111 1111 1111 1111 41111111-11111111 4111  1111 5",
    "+1 (988) 555-2485 +12 +123456789012345678 +1 23 45 67 8) +1+234567890",
    "é😀 a@b.co 😀1.2.3.4",
    None,
    "",
    "1" * 20_000 + " 4111111111111111",
    "a" * 20_000 + "@" + "b" * 20_000,
    "a@" * 10_000,
    "1.2." * 5_000,
    "1 " * 20_000 + "x",
]


def base(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x or 256) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.extract(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(HARD)}


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"words before them and member id: user{i}@mail{i % 7}.org then more") for i in range(30)] + [(100 + i, f"words before them and member id: QX-{i}77 then more") for i in range(4)] + [(200, "chapter 12 of 30, version 4.0.")]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[100 + i]) == 1 and rows[30 + i][1][got[100 + i][0][1] : got[100 + i][0][2]] == f"QX-{i}77" for i in range(4))
    assert got[200] == [] and all(not got[i] for i in range(30))


def test_contexts_reach_over_neighbouring_candidates(spark):
    rows = [(i, f"words then ids: {i} user{i}@mail{i % 7}.org more") for i in range(30)] + [(100 + i, f"words then ids: {i} QX-{i}77 more") for i in range(4)]
    rows += [(200 + i, f"see list a{i}@b.org c{i}@d.org e{i}@f.org end") for i in range(30)] + [(300, "see list a1@b.org c1@d.org ZZ-4471 end")]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert [[text[k][a:b] for _, a, b in got[k]] for k in (100, 101, 102, 103, 300)] == [["QX-077"], ["QX-177"], ["QX-277"], ["QX-377"], ["ZZ-4471"]]


def test_what_is_found_finds_more(spark):
    """Context one has seeds; what it finds makes context two, which has none, known; a context of mixed words stays unknown."""
    rows = [(i, f"the member id: user{i}@mail{i}.org then") for i in range(30)] + [(100 + i, f"the member id: QX-{i}77 then") for i in range(5)]
    rows += [(200 + i, f"we charge account QX-{i}77 for it") for i in range(5)] + [(300, "we charge account ZZ-4412 for it")]
    rows += [(400 + i, f"see page {i}0 of it") for i in range(20)] + [(500, "see page QX-077 of it")]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert [[text[k][a:b] for _, a, b in got[k]] for k in (100, 200, 300)] == [["QX-077"], ["QX-077"], ["ZZ-4412"]]
    assert all(not got[400 + i] for i in range(20)) and got[500] == []


def test_masking_odd(spark, odd, empty):
    df = spark.createDataFrame([(1, "mail é a@b.co, call +1 234 567 8901 now", 0), (1, "mail é a@b.co, call +1 234 567 8901 now", 0), (None, "1.2.3.4", 0), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id or -1, r.text, r.n_chars) for r in pii.masked(df).where("text is not null").collect())
    t = "mail é <EMAIL>, call <PHONE> now"
    assert got == [(-1, "<IP>", 4), (1, t, len(t)), (1, t, len(t))]
    assert pii.masked(odd).columns == odd.columns and pii.masked(odd).count() == odd.count() and pii.masked(empty).count() == 0


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    texts = ["<|ENDOFTEXT|> İ'S don't été, —, x<|endoftext|>. ½. á. Å!! ΑΣ. 'll, '.'", "", "  \x1c a\x85b\xa0c. ß. 12.5 '''' _a_. ﬁ, e̸<", "Hello, HELLO hello. naïve naïve... 日本語。😀😀"]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(packing.encode([t.encode() for t in texts], path)) == want


@pytest.mark.parametrize("counts", [{5: 3, 3: 3, 2: 1}, {8: 2, 7: 5, 1: 4, 4: 3, 3: 3}, {3: 10}, {}, {k: k % 3 + 1 for k in range(1, 9)}])
def test_plan_uses_everything_once(counts):
    made = packing.plan(counts, 8)
    used = {}
    for lengths, n in made:
        assert sum(lengths) <= 8 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    assert sum(n for _, n in made) <= -(-sum(k * v for k, v in counts.items()) // 8) + 2


@pytest.mark.parametrize("capacity", [3, 8, 13, 24])
def test_index_of_sums_fills_what_can_be_filled(capacity):
    """Against all combinations of up to three pieces that are there beside the one to complete."""
    rng = np.random.default_rng(capacity)
    for _ in range(100):
        left = rng.integers(0, 4, capacity + 1) * rng.integers(0, 2, capacity + 1)
        left[0] = 0
        for long in np.flatnonzero(left[:capacity]).tolist():
            there = [x for x in range(capacity + 1) for _ in range(left[x] - (x == long))]
            can = any(sum(c) == capacity - long for k in (1, 2, 3) for c in itertools.combinations(there, k))
            found = packing.Sums(left.copy()).filling(capacity - long, long)
            assert bool(found) == can
            if found:
                assert sum(found) == capacity - long and len(found) <= 3 and all(found.count(x) <= there.count(x) for x in found)
        made = packing.plan({x: int(n) for x, n in enumerate(left) if n}, capacity)
        assert sum(n * lengths.count(x) for lengths, n in made for x in set(lengths)) == left.sum()


def test_packing_covers_all_tokens(odd, empty):
    path = packing.tokenizer_file()
    rows = packing.pack_documents(odd).toPandas()
    want = sorted((len(i) // 4 + 1, zlib.crc32(i + b"\0\0\0\0") if len(i) // 4 + 1 <= 2048 else None) for i in packing.encode([(r.text or "").encode() for r in odd.collect()], path))
    assert rows.length.sum() == sum(n for n, _ in want) and len(rows[rows.start == 0]) == odd.count()
    assert sorted(c for n, c in want if c is not None) == sorted(rows[(rows.start == 0) & (rows.length < 2048)].ids_crc32)
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    g = rows.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert packing.pack_documents(empty).count() == 0


def test_pieces_are_the_librarys(odd, empty):
    import sentencepiece

    path = pieces.model_file()
    texts = ["", "a", " a", "  a b   c    d", " " * 40 + "x", "\n\n a\n b\t\tc", "日本語テスト 😀😀 é è 𝒳", "x\0y \0 z\0", "a" * 300, "ab" * 500 + " " + "the" * 100, "<s> </s> <unk> <0x41> ▁▁ ▁a", "12345 3.14 $$$%%% --==>>", " ", "don't stop!!! WORD!!", *[r.text or "" for r in odd.collect()]]
    got = list(pieces.model(path).encode(texts))
    assert got == [np.array(i, "<u4").tobytes() for i in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert all(pieces.model(path).decode(i).decode() == t.replace("▁", " ") for i, t in zip(got, texts, strict=True))
    back = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_texts(odd)).collect()}
    assert all((r.text or "") == back[r.doc_id] for r in odd.collect())
    assert pieces.encode_texts(empty).count() == 0


def test_everything_is_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in e.queries() if re.match(r"op\d+_", q)} and "pipeline" in e.queries()


def bootstrapped(texts, base):
    """What contexts give beyond the spans of base, with plain sets and counts; texts of ASCII alone."""
    seen, edges = [], {}
    for i, text in texts.items():
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", text):
            inner = re.sub(r"^[^A-Za-z0-9+]+", "", m.group())
            word = re.sub(r"[^A-Za-z0-9]+$", "", inner)
            start = m.end() - len(inner)
            end = start + len(word)
            if len(word) < pii.SHORTEST:
                continue
            before = [re.sub("[0-9]+", "#", "@" if "@" in w else w.lower()) for w in text[: m.start()].split()]
            seed = any(a < end and b > start for _, a, b in base[i])
            patterns = {" ".join(before[-k:]) for k in (1, 2) if len(before) >= k}
            seen.append((i, start, end, word.lower(), seed, patterns))
            for p in patterns:
                edges.setdefault(p, {}).setdefault(word.lower(), False)
                edges[p][word.lower()] |= seed
    known, rounds = {w for words in edges.values() for w, seed in words.items() if seed}, 0
    while True:
        held = {p: len(known & set(words)) for p, words in edges.items()}
        trust = {p: n / (len(edges[p]) + 1) for p, n in held.items() if n >= pii.SUPPORT}
        miss = {}
        for p, t in trust.items():
            for w in edges[p]:
                miss[w] = miss.get(w, 1.0) * (1 - t)
        new = known | {w for w, m in miss.items() if 1 - m >= pii.SURE - 1e-9}
        if new == known:
            break
        known, rounds = new, rounds + 1
    found = {i: sorted({("id", a, b) for j, a, b, w, seed, ps in seen if j == i and not seed and w in known and any(trust.get(p, 0) >= pii.SURE for p in ps)}) for i in texts}
    return found, rounds


def test_bootstrapping_equals_a_plain_version(spark):
    """Addresses teach "mail to", what follows it and is no address is learnt, and teaches "handle is" in a later round; the rest stays."""
    rng = random.Random(3)
    plain = "we met there and spoke of prices for the last week again".split()
    handles, texts = [f"{rng.choice('abcdef')}x{n:03}" for n in range(24)], {}
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.4:
                words += ["Mail", "to", f"u{rng.randint(0, 80)}@host{rng.randint(0, 3)}.org,"]
            elif kind < 0.5:
                words += ["mail", "to", f"({rng.choice(handles[:12])})"]
            elif kind < 0.7:
                words += ["handle", "is", rng.choice(handles[: 12 if rng.random() < 0.9 else 24])]
            elif kind < 0.9:
                words += ["order", "no", f"n{rng.randint(0, 300)}{'x' * rng.randint(0, 2)}"]
            else:
                words += ["at", f"{rng.randint(0, 99)}"]
            words += [rng.choice(plain) for _ in range(rng.randint(0, 4))]
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.extract(df).collect()
    want, rounds = bootstrapped(texts, {r.doc_id: [tuple(s) for s in r.base] for r in rows})
    assert {r.doc_id: [tuple(s) for s in r.found] for r in rows} == want
    spotted = {texts[i][a:b] for i, spans in want.items() for _, a, b in spans}
    assert rounds >= 2 and spotted <= set(handles) and len(spotted) > 12
