"""License scans: every block of a text that holds nearly all words of a known notice, by a set-similarity join.

A notice of m words is met with blocks of twice S words, S the power of two from m up, that start at each
S-th word of a text: any stretch as long as the notice lies whole in one of them. A block meets a notice if it holds at
least ``SHARE`` of its different words. The join is exact and works from the rare end of one order of
all words: those of no notice first, then the notices' own by the number of times that all texts have them.

- Prefix filter: a block that lacks all of the notice's rarest words, as many as may be absent and one more,
  cannot reach the share. Only those words have postings.
- Length filter: a block with fewer notice words than the share asks for is dropped.
- Positional filter: the rarest word that a block shares with a prefix bounds what may still come: the
  block's different notice words from there on in the order.
- What is left is counted.

Counting the words takes one pass over the texts and gives one sum for each word of a notice; the join is a
second pass, in which the notices' index, whose size is checked against ``MOST_WORDS``, is with every task.
So no word and no block of a text is ever shuffled, and a text, source or word that is everywhere costs no task
more than its own rows. Tasks hold a few million bytes of texts, or one longer text.

Beside blocks, the scan gives the places of fixed phrases.

Defined results: a null text is empty, without words. Repeated rows and rows without an id each get a
row. Texts are read whole, whatever their length. Empty tables give no rows. Further columns stay as they are
in scan().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow, fresh, parts, read, utf8, word_hashes

# Words, phrases and notices that are looked for.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
NOTICES = [
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Of a notice's different words, so many must stand in a block.
SHARE = 0.9
#: The smallest S of a block of 2 S words.
LEAST_SPAN = 8
#: Words that the notices of one scan may have together; more are scanned in several calls.
MOST_WORDS = 1 << 20
AT_ONCE = 4 << 20  # bytes of texts
PAIRS = 1 << 21  # notice words of blocks that are counted together

#: Bytes as they are in words, all others as a space.
BREAK = np.full(256, 32, np.uint8)
for part in ((48, 58), (65, 91), (97, 123), (128, 256)):
    BREAK[slice(*part)] = range(*part)

FOUND = "n_words long, phrases array<struct<label:string,start:long>>, blocks array<struct<label:string,share:double,start:long,end:long>>"


def words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def span(n: int) -> int:
    """S for a notice of n words."""
    return max(LEAST_SPAN, 1 << (n - 1).bit_length())


def needed(n: int) -> int:
    """How many of n different words make the share."""
    return math.ceil(round(SHARE * n, 9))


def _hashes(tokens: Sequence[str]) -> np.ndarray:
    raw = [t.encode() for t in tokens]
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))[0] if raw else np.zeros(0, U64)


class Index:
    """Notices by their rare words, and phrases; counts are those of vocabulary, in its order."""

    def __init__(self, notices: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], counts: np.ndarray | None = None):
        each = [words(text) for _, text in notices]
        self.vocabulary = sorted({w for t in each for w in t})
        if sum(map(len, each)) > MOST_WORDS:
            raise ValueError(f"the notices have over {MOST_WORDS} words together; scan for them in several calls")
        if not all(each):
            raise ValueError("a notice without words")
        self.labels = [label for label, _ in notices]
        self.phrases = [(label, _hashes(words(text))) for label, text in phrases]
        n = len(self.vocabulary)
        counts = np.zeros(n, np.int64) if counts is None else counts
        order = np.lexsort((np.arange(n), counts))  # rarest first
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        own = _hashes(self.vocabulary)
        by_hash = np.argsort(own)
        self.hashes, self.rank, self.word = own[by_hash], rank[by_hash], by_hash
        number = {w: int(r) for w, r in zip(self.vocabulary, rank, strict=True)}
        sets = [sorted({number[w] for w in t}) for t in each]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([needed(len(s)) for s in sets], np.int64)
        self.span = np.array([span(len(t)) for t in each], np.int64)
        # membership as sorted numbers (notice, rank); postings of prefixes as rows of a rank
        self.member = np.array([t * n + r for t, s in enumerate(sets) for r in s], np.int64)
        post = sorted((r, t) for t, s in enumerate(sets) for r in s[: len(s) - int(self.need[t]) + 1])
        self.posted = np.array([t for _, t in post], np.int64)
        self.begin = np.searchsorted(np.array([r for r, _ in post], np.int64), np.arange(n + 1))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed words are notice words, and where they stand in self.hashes."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        w = np.flatnonzero(self.hashes[at] == h)
        return w, at[w]

    def blocks(self, rank: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, notice, block, share) of all blocks that reach the share; rank, row and place tell of the notice words of texts, in order."""
        none = np.zeros(0, np.int64)
        many = self.begin[rank + 1] - self.begin[rank]
        if not many.sum():
            return none, none, none, none.astype(float)
        hit = np.repeat(np.arange(len(rank)), many)
        notice = self.posted[np.repeat(self.begin[rank] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        block = place[hit] // self.span[notice]
        hit, notice, block = np.concatenate([hit, hit[block > 0]]), np.concatenate([notice, notice[block > 0]]), np.concatenate([block, block[block > 0] - 1])
        order = np.lexsort((rank[hit], block, notice, row[hit]))  # of each candidate the rarest word first
        hit, notice, block = hit[order], notice[order], block[order]
        own = row[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (own[1:] != own[:-1]) | (notice[1:] != notice[:-1]) | (block[1:] != block[:-1])
        own, notice, block, rarest = own[new], notice[new], block[new], rank[hit][new]
        wide = U64(1) << U64(40)
        key = row.astype(U64) * wide + place.astype(U64)
        low = np.searchsorted(key, own.astype(U64) * wide + (block * self.span[notice]).astype(U64))
        high = np.searchsorted(key, own.astype(U64) * wide + ((block + 2) * self.span[notice]).astype(U64))
        long = high - low >= self.need[notice]  # length filter
        own, notice, block, rarest, low, high = (x[long] for x in (own, notice, block, rarest, low, high))
        shared = np.zeros(len(own), np.int64)
        for a, b in parts(np.concatenate([[0], np.cumsum(high - low)]), PAIRS):
            n = high[a:b] - low[a:b]
            cand = np.repeat(np.arange(a, b), n)
            seen = np.unique(cand * len(self.word) + rank[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            cand, token = seen // len(self.word), seen % len(self.word)
            later = np.bincount(cand - a, token >= rarest[cand], b - a)  # positional filter
            keep = (later >= self.need[notice[a:b]])[cand - a]
            cand, token = cand[keep], token[keep]
            of = notice[cand] * len(self.word) + token
            at = np.minimum(np.searchsorted(self.member, of), len(self.member) - 1)
            shared[a:b] = np.bincount(cand - a, self.member[at] == of, b - a)
        met = shared >= self.need[notice]
        return own[met], notice[met], block[met], shared[met] / self.size[notice[met]]

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple], list[tuple]]:
        """Word counts of texts, phrases as (row, label, start), blocks as (row, label, share, start, end)."""
        h, _, _, row = word_hashes(BREAK[data], off)
        n = np.bincount(row, minlength=len(off) - 1)
        first = np.cumsum(n) - n
        phrases = []
        for label, p in self.phrases:
            i = np.flatnonzero(h[: len(h) - len(p) + 1] == p[0])
            for k in range(1, len(p)):
                i = i[(h[i + k] == p[k]) & (row[i + k] == row[i])]
            phrases += [(r, label, s) for r, s in zip(row[i].tolist(), (i - first[row[i]]).tolist(), strict=True)]
        w, at = self.hits(h)
        own, notice, block, share = self.blocks(self.rank[at], row[w], w - first[row[w]])
        start = block * self.span[notice]
        end = np.minimum(start + 2 * self.span[notice], n[own])
        found = zip(own.tolist(), [self.labels[t] for t in notice.tolist()], share.tolist(), start.tolist(), end.tolist(), strict=True)
        return n, sorted(phrases, key=lambda x: (x[0], x[2], x[1])), sorted(found, key=lambda x: (x[0], x[3], x[4], x[1]))


def _lists(rows: list[tuple], many: int, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.ListArray:
    """An array of lists of structs from rows whose first item is the list's number, in order."""
    off = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(many + 1))
    columns = [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types)]
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(columns, list(names)))


def counts(docs: DataFrame, index: Index) -> np.ndarray:
    """How often all texts have each word of index.vocabulary; as many sums as it has words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            data, off = utf8(batch["text"])
            for a, b in parts(off, AT_ONCE):
                _, at = index.hits(word_hashes(BREAK[data[off[a] : off[b]]], off[a : b + 1] - off[a])[0])
                total += np.bincount(index.word[at], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(index.vocabulary), np.int64)
    for r in arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """docs with a column license: a struct of n_words, phrases (label, start) and blocks (label, share, start, end), words counted from 0."""
    index = Index(notices, phrases)
    index = Index(notices, phrases, counts(docs, index))
    out = fresh(docs, "license")
    rest = [f"`{c}`" for c in docs.columns]
    string, long = pa.string(), pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch["text"])
            for a, b in parts(off, AT_ONCE):
                n, phrase, block = index.scan(data[off[a] : off[b]], off[a : b + 1] - off[a])
                found = [pa.array(n, long), _lists(phrase, b - a, ("label", "start"), (string, long)), _lists(block, b - a, ("label", "share", "start", "end"), (string, pa.float64(), long, long))]
                license = pa.StructArray.from_arrays(found, ["n_words", "phrases", "blocks"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, license], [*part.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` struct<{FOUND.replace(' long', ':long').replace(' array', ':array')}>"])
    return arrow(docs.select(*rest), run, schema)


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents; see the module for the cases."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    phrase, block = F.col("license.phrases"), F.col("license.blocks")

    def label(x):
        return x["label"]

    def text(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.transform(phrase, label)
    score = F.when(F.size(phrase) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(block, lambda x: x["share"])), F.lit(0.0)))
    return found.select(
        "doc_id", "license.n_words", F.size(phrase).cast("long").alias("n_base"), F.get(phrase, F.lit(0))["start"].alias("first_word"), F.when(F.size(phrase) > 0, F.element_at(phrase, -1)["start"]).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, F.transform(block, label))).alias("labels"), score.alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(tokens: Sequence[str]) -> str:
    return "[" + ", ".join(map(_quoted, tokens)) + "]"


def sql() -> str:
    """The same scan with each block of each text compared with each notice."""
    notices = ", ".join(f"({_quoted(label)}, {_listed(sorted(set(words(t))))}, {needed(len(set(words(t))))}, {span(len(words(t)))})" for label, t in NOTICES)
    phrases = ", ".join(f"({_quoted(label)}, {_listed(words(t))})" for label, t in PHRASES)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t(label, tokens, need, s) AS (VALUES {notices}),
p(label, phrase) AS (VALUES {phrases}),
base AS (SELECT r, label, i - 1 AS start FROM w, p, unnest(range(1, len(w) - len(phrase) + 2)) AS u(i) WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
met AS (SELECT r, label, len(list_intersect(tokens, w[k * s + 1:(k + 2) * s])) AS n, need, len(tokens) AS m FROM w, t, unnest(range((len(w) + s - 1) // s)) AS u(k)),
found AS (SELECT r, label, n / m AS share FROM met WHERE n >= need),
b AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
f AS (SELECT r, max(share) AS share FROM found GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN f USING (r) LEFT JOIN l USING (r)
"""


OP11_SQL = sql()
