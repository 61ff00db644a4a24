"""The pipeline's stages, each against the same work in plain Python on a small table."""

import random

import numpy as np
import pytest

import corpus_pipeline
from barweave.llm import common, neardup_text, packing, toxicity
from test_copies import bag, distance
from test_text import base

WORDS = [a + b for a in ("tar", "mel", "sov", "rin", "kap", "lon", "bed", "fis") for b in ("ka", "mo", "ti", "ru", "se")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ordinary and toxic documents of several lines, lines and texts shared exactly and nearly, personal data, odd rows."""
    rng = random.Random(11)

    def line(n=14, toxic=False):
        return " ".join(("zurg" if toxic and k % 4 == 0 else "") + rng.choice(WORDS) for k in range(n))

    docs = []
    for i in range(120):
        docs.append([i, "\n".join(line(toxic=i % 4 == 0) for _ in range(4)), int(i % 4 == 0)])
    footer = line(16)
    for i in range(1, 30, 3):
        docs[i][1] += "\n" + (footer if i % 2 else footer[:40] + "x" + footer[40:])
    for i in range(40, 48):  # near copies, too far apart for their lines
        w = docs[49][1].split("\n")
        docs[i][1], docs[i][2] = "\n".join(s.replace(" ", "  ") if k % 2 else s.upper() for k, s in enumerate(w)), 0
    docs[33][1] += "\nmail a.b@c.org or +1 234 567 8901, card 4111 1111 1111 1111, from 10.0.0.1"
    docs += [[200, None, 0], [201, "", 0], [202, " \n ", 0]]
    at = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(i, t, "en", None if i % 5 else "web", None if t is None else len(t)) for i, t, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in docs], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def without_repeats(docs):
    from barweave.llm.linededup import edits

    first, out = [], {}
    for i, t in sorted(docs.items()):
        if t is None:
            out[i] = None
            continue
        keep = []
        for s in t.split("\n"):
            near = s.strip() and any(abs(len(s) - len(o)) <= 5 and distance(s, o) <= edits(max(len(s), len(o))) for o in first)
            if not near:
                keep.append(s)
            if s.strip():
                first.append(s)
        new = "\n".join(keep)
        if new.strip() or new == t:
            out[i] = new
    return out


def one_of_each(docs):
    bags, gone = {i: bag(t) for i, t in docs.items()}, set()
    for a in docs:
        for b in docs:
            if a < b and bags[a] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                gone.add(b)
    return {i: t for i, t in docs.items() if i not in gone}


def masked(t):
    spans = sorted((s, -e, k) for k, s, e in base(t))
    at, out = 0, ""
    for s, e, k in spans:
        if s >= at:
            out += t[at:s] + f"<{k.upper()}>"
        at = max(at, -e)
    return None if t is None else out + t[at:]


def test_stages_move_texts_in_small_batches(spark, tables, tmp_path, monkeypatch):
    """What goes from Spark to Python at once while near copies are told: 2 MB and a row, unless the session says otherwise."""
    plain, sizes = common.arrow, str(tmp_path / "sizes")

    def seen(df, run, schema):
        def noted(batches):
            def each():
                for b in batches:
                    with open(sizes, "a") as f:
                        f.write(f"{b.nbytes}\n")
                    yield b

            yield from run(each())

        return plain(df, noted, schema)

    monkeypatch.setattr(neardup_text, "arrow", seen)
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(2000))) for i in range(1000)]
    docs = spark.createDataFrame(texts + [(1000 + i, t) for i, t in texts[:20]], "doc_id long, text string").repartition(1)
    for key in common.BATCHES:
        spark.conf.unset(key)
    try:
        assert corpus_pipeline.STAGES[2][1](spark, docs, tables).count() == 1000
        with open(sizes) as f:
            assert 1 << 20 < max(map(int, f)) < 5 << 19
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
        common.small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m"
    finally:
        for key in common.BATCHES:
            spark.conf.unset(key)


def test_workers_let_go_of_the_tokenizer_when_other_tasks_come(spark, tables):
    """The tokenizer and its words, over 100 MB a worker, stay between packing's tasks only."""
    docs, path = common.read(spark, tables, "documents").coalesce(1), packing.tokenizer_file()

    def held(name):
        def run(batches):
            import gc
            import os

            import pyarrow as pa

            for _ in batches:
                pass
            n = sum(type(x).__name__ == "Words" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([n], pa.int64())], ["pid", "n"])

        return common.arrow(docs.select("doc_id"), run, "pid long, n long", keeps=name).collect()[0]

    packed = packing.pieces(docs, path).count()  # a worker alone here: one task at a time
    before, after = held(path), held(None)
    assert packed and before.n == 1 and after.n == 0 and before.pid == after.pid


def test_each_stage_equals_plain_python(spark, tables):
    docs = common.read(spark, tables, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = common.read(spark, tables, "labels")
    model = toxicity.train(docs, labels, common.F.pmod(common.id_crc("doc_id"), common.F.lit(3)) != 1)
    want = {i: t for i, t in texts(docs).items() if model.probability(model.of_bytes(np.frombuffer(raw := (t or "").encode(), np.uint8), np.array([0, len(raw)])))[0] < 0.7}
    assert 100 > len(want) > 80  # the toxic ones go, the others stay
    for name, plain in (("toxicity", None), ("line dedup", without_repeats), ("minhash near-dedup", one_of_each), ("pii", lambda d: {i: masked(t) for i, t in d.items()})):
        docs = common.staged(stages[name](spark, docs, tables), "test")
        want = want if plain is None else plain(want)
        assert docs.columns == columns and texts(docs) == want, name
        assert all(r.text is None or name == "toxicity" or r.n_chars == len(r.text) for r in docs.collect()), name
    packed = stages["packing"](spark, docs, tables).toPandas()
    ids = list(packing.encode([(t or "").encode() for t in want.values()], packing.tokenizer_file()))
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(x) // 4 + 1 for i, x in zip(want, ids, strict=True)}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and packed.sequence_id.nunique() == -(-int(packed.length.sum()) // 2048)


def test_stages_keep_columns_that_clash(spark, tables):
    docs = common.read(spark, tables, "documents")
    names = ["_toxic", "__score", "score", "__k", "__id", "__all", "__gone", "_id", "_key", "_mark", "_spans", "id", "gone"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, common.F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, tables), "test")
        assert out.columns == docs.columns and [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() >= docs.count()
