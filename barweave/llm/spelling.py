"""Spelling variants: for each word of a vocabulary its near words, and the frequent one it is a variant of.

Two words are near if one code point inserted, deleted or replaced makes one of the other. Near words are
found without pairs of words:

- Replaced: each word stands in one group for each of its places, with the words that are equal before and
  after that place. Two words share at most one such group, which has at most one word for each letter. A
  group's size and its two most frequent words tell each of its words how many near words it has there and
  which is the most frequent.
- Inserted and deleted: each word's deletions meet the vocabulary. The word that is met is near to each word
  that meets it; again size and the most frequent one are enough.

Both are one table of keys and one window over it. Keys are 128 bits wide: sums, over a word's code points, of
hashes of place and code point, so that every word without one of its letters is known by a subtraction and a word
costs time by its length, not the square of it. Words are known by their rank (by falling count, then
by code points), so the first of a group is the most frequent one and long words are not copied.

A chain of forms has at most 18 links, as counts grow tenfold with each; roots are found by doubling, until a
round changes nothing.

Defined results: null texts have no words and a null id counts as the empty text; repeated rows count
again. Words of any length are taken whole. Ties of counts go to the smaller word by code points. Empty
tables give no rows. Further columns play no part.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, arrow, mix, parts, read, staged, unstage
from .trie import CRC_TABLE

#: Words have at least so many code points and occurrences; a form is so many times as frequent.
LETTERS, COUNT, TIMES = 7, 2, 10
#: Of the hash of document and word: how seldom a letter is left out.
SELDOM = 31
OWN, DELETED, REPLACED = 0, 1, 2
AT_ONCE = 1 << 18  # code points whose keys are made together


def runs(docs: DataFrame) -> DataFrame:
    """(id, run): every maximal run of at least LETTERS letters of the texts, A-Z in lower case; shorter ones make no words."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LETTERS},}}"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    return found.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("run"))


def misspelt(runs: DataFrame) -> DataFrame:
    """(word): runs, of which one in SELDOM by the hash of its document and itself lacks the letter that the hash names."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SELDOM == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word"))


def counted(words: DataFrame) -> DataFrame:
    """(word, n): words of at least LETTERS code points that occur COUNT times or more."""
    return words.where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def _sums(words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of key halves, kinds and word numbers of a few words at a time."""
    length = np.array([len(w) for w in words], np.int64)
    for a, b in parts(np.concatenate([[0], np.cumsum(length)]), AT_ONCE):
        n = length[a:b]
        c = np.frombuffer("".join(words[a:b]).encode("utf-32-le"), np.uint32).astype(U64)
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(b - a), n)
        place = (np.arange(len(c)) - first[row]).astype(U64)
        keys = []
        for lane in (U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)):
            letter = mix(c * lane + U64(1))
            here = mix(mix(place + lane) + letter)
            back = np.where(place > 0, mix(mix(place - U64(1) + lane) + letter), U64(0))
            total, later = np.add.reduceat(here, first), np.add.reduceat(back, first)
            before, upto = np.cumsum(here) - here, np.cumsum(back)  # from the batch's begin; differences are the word's own
            before -= before[first][row]
            upto -= (upto[first] - back[first])[row]
            keys.append((total, before + later[row] - upto, mix(total[row] - here + mix(place * lane + U64(7)))))
        new = (place == 0) | (c != np.concatenate([c[:1], c[:-1]]))  # within a run of one letter all deletions are equal
        new &= (n > LETTERS)[row]
        lanes = [np.concatenate([k[0], k[1][new], k[2]]).view(np.int64) for k in keys]
        kind = np.repeat(np.array([OWN, DELETED, REPLACED], np.int8), [b - a, int(new.sum()), len(c)])
        yield *lanes, kind, np.concatenate([np.arange(b - a), row[new], row]) + a


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank = batch["rank"].to_numpy()
        for a, b, kind, row in _sums(batch["word"].to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind), pa.array(rank[row])], ["a", "b", "kind", "rank"])


def near(vocabulary: DataFrame) -> DataFrame:
    """(rank, n_near, best) for the words of (rank, word) that have near ones: how many, and the least rank among them."""
    keys = arrow(vocabulary.select("rank", "word"), _keys, "a long, b long, kind tinyint, rank long")
    order = Window.partitionBy("a", "b").orderBy("kind", "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = keys.select("rank", "kind", F.row_number().over(order).alias("no"), F.lead("rank").over(order).alias("second"), F.first("rank").over(whole).alias("top"), F.first("kind").over(whole).alias("least"), F.count("*").over(whole).alias("size"))
    group = group.where((F.col("size") > 1) & (F.col("least") != DELETED))  # deletions alone meet no word
    met = group.select("rank", F.when(F.col("kind") == DELETED, 1).otherwise(F.col("size") - 1).alias("met"), F.when(F.col("no") == 1, F.col("second")).otherwise(F.col("top")).alias("best"))
    return met.groupBy("rank").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), which are different words of at least LETTERS code points."""
    ranked = words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n")
    vocabulary = staged(ranked, "spelling-words")
    named = vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = vocabulary.join(near(vocabulary), "rank", "left").join(named, "best", "left")
    is_form = F.col("form_n") >= TIMES * F.col("n")
    known = known.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    known = staged(known, "spelling-forms")
    link = staged(known.where("best is not null").select("rank", "best"), "spelling-roots")
    while True:
        further = link.select(F.col("rank").alias("best"), F.col("best").alias("next"))
        new = staged(link.join(further, "best", "left").select("rank", F.coalesce("next", "best").alias("best"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(link)
        moved, link = new.where("moved").count(), new
        if not moved:
            break
    root = link.select("rank", F.col("best").alias("last")).join(vocabulary.select(F.col("rank").alias("last"), F.col("word").alias("root")), "last").select("rank", "root")
    out = known.join(root, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = staged(out, "spelling")
    unstage(vocabulary, known, link)
    return out


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents, some of them misspelt; see the module for the cases."""
    return variants(counted(misspelt(runs(read(spark, sf_dir, "documents")))))


OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
u AS (SELECT id, w, count(*) AS k, hex(encode(id || ':' || w)) AS x FROM r WHERE length(w) >= {LETTERS} GROUP BY id, w),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295) AS h FROM u, crc),
d AS (SELECT CASE WHEN h % {SELDOM} = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, k FROM h),
v AS (SELECT w, sum(k)::BIGINT AS n FROM d WHERE length(w) >= {LETTERS} GROUP BY w HAVING sum(k) >= {COUNT}),
g AS (SELECT w, n, i, w[1:i - 1] AS p, w[i + 1:] AS s FROM v, unnest(range(1, length(w) + 1)) AS t(i)),
e AS (SELECT DISTINCT w, n, p || s AS d FROM g),
i AS (SELECT e.w AS w, v.w AS o, v.n AS n, e.n AS m FROM e JOIN v ON v.w = e.d),
pairs AS (
  SELECT a.w AS w, b.w AS o, b.n AS n FROM g AS a JOIN g AS b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.w <> b.w
  UNION ALL SELECT w, o, n FROM i
  UNION ALL SELECT o, w, m FROM i),
best AS (SELECT w, count(*) AS k, first(o ORDER BY n DESC, o) AS o, max(n) AS n FROM pairs GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(k, 0) AS k, CASE WHEN best.n >= {TIMES} * v.n THEN o END AS form, CASE WHEN best.n >= {TIMES} * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.w = v.w),
c AS (SELECT w, w AS o, form AS nxt FROM f UNION ALL SELECT c.w, c.nxt, f.form FROM c JOIN f ON f.w = c.nxt)
SELECT f.w AS word, form, c.o AS root, f.n AS n, f.k::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN c ON c.w = f.w AND c.nxt IS NULL
"""
