r"""Operator 13: prefix trie of conversations by ternary search trees per range shard.

1. Turns are ordered within their conversation (null first, ties by the turn's
   digest) and the conversation is rebuilt from its family's head and its own
   tail (``rebuilt``). A turn travels as a 16-byte digest of role and text with
   its number of words; texts stay where they are read.
2. Equal sequences collapse to one row with their members' count, smallest id
   and ``ends_sha256``. A checksum runs over ids in order, so ids are first
   joined in blocks of 1,024 neighbouring ids and then streamed block by block:
   a task never holds more than one Arrow batch of a group.
3. The distinct sequences are range-partitioned and sorted; a shard holds about
   ``SHARD_TURNS`` turns, whatever the input. In a shard digests become dense
   ids (its dictionary), and the sequences go into a ternary search tree in
   median order, which keeps every sibling tree balanced.
4. Tree nodes are laid out parents first, so one backward pass adds up members,
   leaves and savings without recursion. Nodes off the shard's first and last
   sequence are final. The others may continue in a neighbouring shard: they
   go on as partial sums.
5. Partial sums of ``FAN`` neighbouring shards merge, and only what lies on the
   group's first or last sequence goes on, until one group is left.
6. A parent that was not final when its child was emitted is looked up once, by
   node digest.

Memory: a shard's tree, at most ``FAN`` pairs of paths in a merge, and the turn
digests of one conversation, which must fit a task (16 bytes and a count a
turn; the longest conversation bounds it).

Defined cases: null role or text is empty; rows without a conv_id belong to no
conversation and are left out; rows that come twice are two turns; a family's
first conversation that is missing gives no head; c - c % 20 truncates towards
zero; without a conversation there is no root and the result is empty. Columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import join_hot, stored, table, text_or_empty

#: Fixed values of the task: size of a family, modulus of the head's length.
FAMILY, HEADS = 20, 4
TOKEN = r"[^\x20\x09-\x0D]+"
DIGEST = 16
#: Turns of a shard, shards of a merge, ids of a block.
SHARD_TURNS, FAN, BLOCK_BITS = 200_000, 32, 10

NODE = ("key binary, parent_key binary, parent_conv long, depth long, conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends string, "
        "done boolean, shard long, words long, on_first boolean, on_last boolean")
_FIELDS = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("parent_conv", pa.int64()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.string()), ("done", pa.bool_()), ("shard", pa.int64()), ("words", pa.int64()),
    ("on_first", pa.bool_()), ("on_last", pa.bool_())])


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, seq, words): every conversation as the joined digests of its
    turns and their word counts, its first turns taken from its family's first
    conversation. One shuffle, by family."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                     F.struct(F.col("turn").isNotNull().alias("known"),
                              F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                              digest.alias("digest"),
                              F.regexp_count(text, F.lit(TOKEN)).alias("words")).alias("t"))
             .repartition("base"))
    own = turns.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1))
    # At most `family` conversations share a base.
    head = F.first(first, ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    whole = (own.withColumn("head", head).withColumn("h", h)
             .withColumn("head", F.when(F.col("head").isNull(), F.slice("own", 1, 0))
                         .otherwise(F.slice("head", F.lit(1), F.col("h"))))
             .withColumn("all", F.concat("head", F.slice(
                 "own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))))
    return whole.select("conv_id", F.unhex(F.array_join(
        F.transform("all", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("all", lambda t: t["words"].cast("int")).alias("words"))


def _ends_of_batches(batches):
    """(key, n_convs, conv_id, ends) from blocks of ids that come sorted by key
    and block: one running checksum, whatever a group's size."""
    key = None
    done: list = []
    for batch in batches:
        for k, ids, n, least in zip(*(batch.column(c).to_pylist()
                                      for c in ("key", "ids", "n", "least"))):
            if k != key:
                if key is not None:
                    done.append((key, count, small, sha.hexdigest()))  # noqa: F821
                key, count, small, sha = k, 0, least, hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
            count += n
        yield _ends_batch(done)
        done = []
    if key is not None:
        yield _ends_batch([(key, count, small, sha.hexdigest())])


def _ends_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
         pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
        names=["key", "n_convs", "conv_id", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """(seq, words, n_convs, conv_id, ends): the distinct sequences of
    :func:`rebuilt` conversations; copies are combined before the shuffle."""
    convs = stored(convs.withColumn("key", F.unhex(F.md5("seq"))), "conversations")
    blocks = (convs.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")),
                                            lambda c: c.cast("string")), ",").alias("ids"),
                   F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
    ends = (blocks.repartition("key").sortWithinPartitions("key", "block")
            .mapInArrow(_ends_of_batches,
                        "key binary, n_convs long, conv_id long, ends string"))
    return convs.select("key", "seq", "words").dropDuplicates(["key"]).join(ends, "key").drop("key")


def _median_order(n: int):
    """0..n-1, the middle of every range before its halves."""
    ranges = deque([(0, n)])
    while ranges:
        lo, hi = ranges.popleft()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges.append((lo, mid))
            ranges.append((mid + 1, hi))


class TernarySearchTree:
    """Trie over lists of ids whose siblings form binary search trees. Node 0
    is the root; a node's number is larger than its parent's."""

    def __init__(self):
        self.symbol, self.low, self.high = [-1], [-1], [-1]
        self.child, self.parent, self.depth = [-1], [-1], [0]

    def _add(self, symbol: int, parent: int) -> int:
        self.symbol.append(symbol)
        self.low.append(-1)
        self.high.append(-1)
        self.child.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.symbol) - 1

    def insert(self, ids: list[int]) -> int:
        """Node of ``ids``, made if it is not there."""
        at = 0
        for x in ids:
            node = self.child[at]
            if node < 0:
                node = self.child[at] = self._add(x, at)
            while self.symbol[node] != x:
                side = self.low if x < self.symbol[node] else self.high
                if side[node] < 0:
                    side[node] = self._add(x, at)
                node = side[node]
            at = node
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def _node_key(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=DIGEST).digest()


def shard_nodes(rows: list[tuple], shard: int) -> list[tuple]:
    """Nodes of one shard as NODE tuples, from (seq, words, n_convs, conv_id,
    ends) in order of seq."""
    turns = [[seq[i:i + DIGEST] for i in range(0, len(seq), DIGEST)] for seq, *_ in rows]
    digests = sorted({d for t in turns for d in t})
    code = {d: i for i, d in enumerate(digests)}
    size = dict()
    tree, last = TernarySearchTree(), [0] * len(rows)
    for i in _median_order(len(rows)):
        last[i] = tree.insert([code[d] for d in turns[i]])
    for t, (_, words, *_) in zip(turns, rows):
        size.update(zip(t, words))
    count = len(tree.symbol)
    n, conv, ends = [0] * count, [None] * count, [None] * count
    for node, (_, _, m, least, sha) in zip(last, rows):
        n[node], conv[node], ends[node] = m, least, sha
    first_path, last_path = set(tree.path(last[0])), set(tree.path(last[-1]))
    key: dict = {0: b""}
    for p in (tree.path(last[0]), tree.path(last[-1])):
        for node in p[1:]:
            if node not in key:
                key[node] = _node_key(key[tree.parent[node]], digests[tree.symbol[node]])
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    words = [0] + [size[digests[tree.symbol[i]]] for i in range(1, count)]
    for i in range(count - 1, 0, -1):
        p = tree.parent[i]
        n[p] += n[i]
        conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
        if i not in key:  # off the border: final
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * words[i]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    out = []
    for i in range(count):
        p = tree.parent[i]
        border = i in key
        known = not border and p not in key
        out.append((key.get(i), key.get(p) if p >= 0 else None, conv[p] if known else None,
                    tree.depth[i], conv[i], n[i], children[i], leaves[i], saved[i], ends[i],
                    not border, shard, words[i], i in first_path, i in last_path))
    return out


def merged_nodes(rows: list[dict], group: int, whole: bool) -> list[tuple]:
    """Border nodes of neighbouring shards added up. What is not on the group's
    first or last sequence is final, as is all if the group is the ``whole``."""
    lo, hi = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict = {}
    for r in rows:
        own = nodes.get(r["key"])
        at_first = r["on_first"] and r["shard"] == lo
        at_last = r["on_last"] and r["shard"] == hi
        if own is None:
            nodes[r["key"]] = {**r, "on_first": at_first, "on_last": at_last}
            continue
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            own[c] += r[c]
        own["conv_id"] = min(own["conv_id"], r["conv_id"])
        own["ends"] = own["ends"] or r["ends"]
        own["on_first"] = own["on_first"] or at_first
        own["on_last"] = own["on_last"] or at_last
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["done"] = whole or not (r["on_first"] or r["on_last"])
        if r["done"]:
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            up = nodes.get(r["parent_key"])
            if up is not None:
                up["n_children"] += 1
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
    out = []
    for r in nodes.values():
        up = nodes.get(r["parent_key"])
        known = up is not None and r["done"] and up["done"]
        out.append((r["key"], r["parent_key"], up["conv_id"] if known else None, r["depth"],
                    r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"],
                    r["saved_tokens"], r["ends"], r["done"], group, r["words"],
                    r["on_first"], r["on_last"]))
    return out


def _arrow(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows) if rows else [()] * len(_FIELDS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS)],
                                schema=_FIELDS)


def _shard_batches(batches):
    rows: list = []
    for b in batches:
        rows += zip(*(b.column(c).to_pylist()
                      for c in ("seq", "words", "n_convs", "conv_id", "ends")))
    if rows:
        yield from _arrow(shard_nodes(rows, TaskContext.get().partitionId())).to_batches(20_000)


def _merger(fan: int, whole: bool):
    def merge(group: pa.Table) -> pa.Table:
        rows = group.drop_columns(["group"]).to_pylist()
        return _arrow(merged_nodes(rows, rows[0]["shard"] // fan, whole))

    return merge


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS,
               fan: int = FAN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    seqs = stored(sequences(rebuilt(conversations)), "sequences")
    turns = seqs.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    ranged = seqs.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
    level = stored(ranged.mapInArrow(_shard_batches, NODE), "shards")
    finished = [level.where("done")]
    while True:
        border = level.where(~F.col("done"))
        top = border.agg(F.max("shard")).first()[0]
        if top is None:
            break
        level = stored(border.withColumn("group", F.floor(F.col("shard") / fan))
                       .groupBy("group").applyInArrow(_merger(fan, top < fan), NODE), "merged")
        finished.append(level.where("done"))
    nodes = finished[0]
    for f in finished[1:]:
        nodes = nodes.unionByName(f)
    border = nodes.where("key is not null").select(F.col("key").alias("parent_key"),
                                                   F.col("conv_id").alias("up"))
    settled = "parent_conv is not null or parent_key is null"
    # A hot parent (the root) meets its children in several places.
    late = join_hot(nodes.where(f"not ({settled})"), border, ["parent_key"], "conv_id").withColumn(
        "parent_conv", F.col("up")).drop("up")
    return nodes.where(settled).unionByName(late.select(*nodes.columns)).select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role",
                                                                  "text"))


def _sql() -> str:
    from assayline.llm.spelling_variants import CRC_TABLE, crc_sql
    return rf"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                           ORDER BY turn NULLS FIRST) AS own
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
e AS (SELECT o.*, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM o, crc),
q AS (SELECT e.conv_id, coalesce(b.own[1:e.h], []) || e.own[e.h + 1:] AS s
      FROM e LEFT JOIN o b ON b.conv_id = e.conv_id - e.conv_id % {FAMILY}),
m AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM q),
n AS MATERIALIZED (
  SELECT s[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                         FILTER (len(s) = d), '')) AS ends_sha256
  FROM m GROUP BY ALL),
c AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
l AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children,
             CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) *
               len(regexp_extract_all(n.p[depth].t, '[^\x20\x09-\x0D]+')) END AS own
      FROM n LEFT JOIN c ON n.p = c.p),
a AS (SELECT p, n_children, own, unnest(range(depth + 1)) AS d FROM l),
t AS (SELECT p[1:d] AS p, d AS depth, count_if(n_children = 0) AS n_leaves,
             sum(own)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, t.n_leaves,
       t.saved_tokens, l.ends_sha256
FROM l JOIN t ON l.p = t.p AND l.depth = t.depth
LEFT JOIN n u ON l.depth > 0 AND u.depth = l.depth - 1 AND u.p = l.p[1:l.depth - 1]
"""


SQL = _sql()
