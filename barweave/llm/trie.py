"""A prefix trie of conversations: which beginnings they share, and what keeping each once would save.

Every conversation's turns are hashed where they lie (SHA-256 of role and text), and the hashes chained:
the digest of the first d turns is the hash of the digest of the first d - 1 and of turn d. So equal
beginnings have equal digests and texts never move. Every prefix becomes a row; rows grouped by (depth,
digest) are the trie's nodes.

A node is known by its smallest member and its depth. As members only go as depth grows, the nodes with one
smallest member lie below one another, from some depth to that conversation's end: a run. For sums over subtrees
each run is exploded to all its ancestors: one row for each run above it, at the depth where it leaves that
run, never more rows than the conversation has turns; within a run sums add up from its end. A plain
explosion of nodes would give a row for each pair of turns of a long conversation.

No group is collected: conversations stream through the chain sorted, nodes are counted before they are
dealt out, copies of a conversation are numbered lists of at most ``IDS`` ids whose text streams through one
hash, and beginnings that very many conversations share, which are few, meet their prefixes by broadcast.

Defined results: rows without a conv_id belong to no conversation and are left out. Turns stand by turn,
null first; equal ones by the hash of role and text, and each repeated row is a turn. Null roles and texts
are empty. An empty table has no nodes. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, read, staged, unstage

#: So many neighbouring ids stand in one row while the ids of a node are put in order.
IDS = 4096
#: So many nodes at most are broadcast: those that have one of as many parts of all prefixes.
HOT = 4096
ROOT = hashlib.sha256(b"root").digest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars): a row for each turn, numbered from 1, with its hash and code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return own.select("conv_id", F.row_number().over(place).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns with the first h of each conversation c replaced by those of c - c % 100, and a row of pos 0 for each; h is crc32(c) % 6."""
    c: Column = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % 6
    each = turns.where("pos = 1").select("conv_id")
    heads = turns.where((c % 100 == 0) & (F.col("pos") <= 5)).select(c.alias("base"), "pos", "key", "chars")
    lent = each.select("conv_id", (c - c % 100).alias("base"), h.alias("h")).where("h > 0").join(heads, "base").where("pos <= h")
    own = turns.where(F.col("pos") > h)
    columns = ("conv_id", "pos", "key", "chars")
    return own.select(*columns).unionAll(lent.select(*columns)).unionAll(started(each))


def started(ids: DataFrame) -> DataFrame:
    """The rows of pos 0 that stand for conversations themselves, turnless ones too."""
    return ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix digests of rows sorted by conversation and place; a row goes out once it is known whether another follows."""
    now, digest, depth, held = None, ROOT, 0, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for b in batches:
        out = []
        for conv, key, chars in zip(b["conv_id"].to_pylist(), b["key"].to_pylist(), b["chars"].to_pylist(), strict=True):
            if held:
                out.append((*held, conv != now))
            if conv != now:
                now, digest, depth = conv, ROOT, 0
            if key is not None:
                digest, depth = hashlib.sha256(digest + key).digest(), depth + 1
            held = (conv, depth, digest, chars)
        if out:
            yield batch(out)
    if held:
        yield batch([(*held, True)])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, chars, last): each conversation's beginnings, the empty one too; node is the chained digest."""
    dealt = turns.select("conv_id", "pos", "key", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return arrow(dealt, _chain, "conv_id long, depth long, node binary, chars long, last boolean")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's comma-joined lists of ids, that come sorted; nothing but the hash is held."""
    now, sha, schema = None, None, pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for node, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if node != now:
                if sha:
                    out.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)


def ends(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes where conversations end: SHA-256 of their ids in order, comma-joined."""
    block = F.floor(F.col("conv_id") / IDS)
    lists = prefixes.where("last").groupBy("node", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return arrow(lists.repartition("node").sortWithinPartitions("node", "block").select("node", "ids"), _digests, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes, a row each, from (conv_id, pos, key, chars), where each conversation has a row of pos 0 without a key."""
    at = staged(prefixes(turns), "trie-prefixes")
    root = at.where("depth = 0").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).first()
    if root.owner is None:
        return at.sparkSession.createDataFrame([], NODES)
    below = at.where("depth > 0")
    node = staged(below.groupBy("depth", "node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "trie-groups")
    # as all n_convs add up to the rows, no more than HOT nodes have a HOT-th of them; those go to every task, the others are dealt out
    hot = F.col("n_convs") * HOT >= F.lit(below.count())
    met = below.join(F.broadcast(node.where(hot)), ["depth", "node"], "left")
    columns = ("conv_id", "depth", "node", "chars", "last", "owner", "n_convs")
    known = met.where("owner is null").drop("owner", "n_convs").join(node.where(~hot), ["depth", "node"]).select(*columns)
    known = known.unionAll(met.where("owner is not null").select(*columns)).unionAll(at.where("depth = 0").withColumns({"owner": F.lit(root.owner), "n_convs": F.lit(root.n)}).select(*columns))
    whole = Window.partitionBy("conv_id").orderBy("depth")
    path = known.withColumns({"up": F.lag("owner").over(whole), "down": F.lead("owner").over(whole), "owns": F.max(F.col("owner") == F.col("conv_id")).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    path = staged(path.where("owns").drop("owns"), "trie-paths")  # of conversations that are a node's smallest member
    above = path.where("owner <> down").select("conv_id", "owner", "depth", (F.col("down") == F.col("conv_id")).alias("direct"))
    branches = above.where("direct").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count("*").alias("branches"))
    children = F.coalesce("branches", F.lit(0)) + (~F.col("last")).cast("long")
    own = path.where("owner = conv_id").join(branches, ["conv_id", "depth"], "left")
    own = own.select("conv_id", "depth", "node", F.col("up").alias("parent_conv_id"), "n_convs", children.alias("n_children"), (children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = staged(own, "trie-nodes")
    runs = own.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    under = above.join(runs, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"all_{c}": F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).over(up) for c in ("leaf", "saved")}
    out = own.join(under, ["conv_id", "depth"], "left").withColumns(sums).join(ends(at), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("all_leaf").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    out = staged(out, "trie")
    unstage(at, node, path, own)
    return out


def op13_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun as rebuilt() has it; see the module for the cases."""
    own = staged(turns(read(spark, sf_dir, "conversations")), "trie-turns")
    out = trie(rebuilt(own))
    unstage(own)
    return out


#: crc32 of a text of ASCII digits in SQL: a table of 256 steps, then one step a byte.
CRC_TABLE = """SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS r(i))"""

OP13_SQL = f"""
WITH crc AS ({CRC_TABLE}),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
cs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t), crc),
re AS (
  SELECT cs.c, i, r, x FROM cs JOIN t ON t.c = cs.c - cs.c % 100 AND i <= h
  UNION ALL SELECT cs.c, i, r, x FROM cs JOIN t ON t.c = cs.c AND i > h),
s AS (SELECT cs.c, coalesce(list({{'r': r, 'x': x}} ORDER BY i) FILTER (i IS NOT NULL), []) AS s FROM cs LEFT JOIN re ON re.c = cs.c GROUP BY cs.c),
p AS (SELECT c, len(s) AS n, d, s[1:d] AS p FROM s, unnest(range(len(s) + 1)) AS u(d)),
n AS (SELECT d, p, min(c) AS c, count(*) AS k, coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '') AS e FROM p GROUP BY d, p),
m AS (SELECT n.*, a.c AS parent, (SELECT count(*) FROM n AS b WHERE b.d = n.d + 1 AND b.p[1:n.d] = n.p) AS children FROM n LEFT JOIN n AS a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1])
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, a.parent::BIGINT AS parent_conv_id, a.k::BIGINT AS n_convs, a.children::BIGINT AS n_children,
       sum((v.children = 0)::INT)::BIGINT AS n_leaves, sum(CASE WHEN v.d = 0 THEN 0 ELSE (v.k - 1) * length(v.p[v.d].x) END)::BIGINT AS saved_tokens, sha256(a.e) AS ends_sha256
FROM m AS a JOIN m AS v ON v.d >= a.d AND v.p[1:a.d] = a.p
GROUP BY ALL
"""
