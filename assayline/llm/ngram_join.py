"""Operator 4: n-gram Jaccard join by vertical partitioning.

Every document is a set of 64-bit hashes of its distinct five-word shingles;
documents with equal sets are one node. The n-grams have one global order:
rising frequency, then hash. Frequencies are counted over all documents in a
table of ``2**BUCKET_BITS`` buckets (4 MB), the proven size of what is
broadcast; the order only steers the work, so a bucket shared by several
n-grams never changes a result.

1. Candidates. Two sets with Jaccard >= 0.75 share an n-gram among the first
   n - ceil(0.75 n) + 1 of each (prefix principle), and among the first
   n - o + 1 once the other's size, and so the least overlap o, is known. Prefix postings are dealt by n-gram. A short
   posting list gives all its pairs; a longer one gives two stars only, linear
   in its length, and its postings are kept. Their centres have the n-gram
   earliest in their order: a text that others were copied from has no rare
   n-grams of its own, so one star unites its copies.
2. Verification by fragments. The global order is cut into ``FRAGMENTS``
   fragments of equal mass. The sets of candidate nodes are cut alike; each
   (block of pairs, fragment) counts the partial overlaps of its pairs, and
   the sums per pair decide 100 * intersection >= 75 * union exactly.
3. Rest. After the links so far are united, the kept postings give every pair
   whose nodes are still in different components; they are verified the same
   way. A pair never tested is thus inside one component already, so no
   component is lost and no group of near copies is expanded into all pairs.

Skew: an n-gram whose bucket is hot is salted (its list is then kept for step
3, which joins the whole list); equal sets collapse before anything is
paired; a star of many candidate pairs is split into several blocks.

Defined cases: null text, empty text and text without words have an empty
set, no links, and are their own component; repeated rows are copies of each
other; a null id never becomes a component's id unless all its ids are null;
an empty table gives an empty result; other columns are ignored. ``kept_rows``
(the pipeline's stage) tells rows apart by a stored row number, not by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import (bitmaps, components, extended, join_hot, partitions,
                                  stored, table, without_ids)
from assayline.llm.shingles import mix, shingle_hashes, small_columns

BUCKET_BITS = 20
FRAGMENTS = 4
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 8
#: A hot bucket's n-grams get one salt for each so many occurrences.
SALT_EVERY = 200_000
BLOCK_PAIRS = 20_000
NODE_FILTER_BITS = 1 << 25
#: Node-to-block rows that may be broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
#: Nodes a task remembers so as not to send equal sets twice, and entries it
#: holds before it sends them on; both only bound its memory.
SEEN_NODES, HELD_POSTINGS = 500_000, 500_000
_U = np.uint64
_CHUNK = 1 << 12


def least_overlap(n, m):
    """Least intersection of sets of sizes n and m with Jaccard >= 0.75."""
    return -(-3 * (n + m) // 7)


def ngram_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of n-grams per bucket, over all documents (int64)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for _, rows in small_columns(b.column(0)):
                h, _ = shingle_hashes(rows)
                total += np.bincount((h >> _U(64 - BUCKET_BITS)).astype(np.int64),
                                     minlength=1 << BUCKET_BITS)
        parts = total.reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()),
             pa.array([parts[i].astype("<i8").tobytes() for i in some], pa.binary())],
            names=["part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), "<i8") for c in t.column("counts"))
        return pa.table({"part": t.column("part")[:1],
                         "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "part long, counts binary"
    out = np.zeros((1 << BUCKET_BITS) // _CHUNK * _CHUNK, np.int64)
    for r in docs.select(text).mapInArrow(count, schema).groupBy("part").applyInArrow(
            add, schema).collect():
        out[r["part"] * _CHUNK:(r["part"] + 1) * _CHUNK] = np.frombuffer(r["counts"], "<i8")
    return out


def order_key(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place in the global order as one number (ties: by hash)."""
    c = np.minimum(counts[(h >> _U(64 - BUCKET_BITS)).astype(np.int64)], (1 << 24) - 1)
    return (c.astype(np.uint64) << _U(40)) | (h >> _U(24))


def pivots(counts: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Cuts of the global order into fragments of about equal mass."""
    c = np.sort(np.minimum(counts, (1 << 24) - 1))
    mass = np.cumsum(c)
    at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)
    return c[np.minimum(at, len(c) - 1)].astype(np.uint64) << _U(40)


def node_id(sets: np.ndarray) -> np.int64:
    """Id of a set: a hash of its members and size."""
    total = np.array([mix(sets).sum(dtype=np.uint64)])
    size = np.array([len(sets)], np.uint64)
    return mix(total + size * _U(0x9E3779B97F4A7C15)).view(np.int64)[0]


def node_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of rows that have any."""
    for first, rows in small_columns(column):
        h, off = shingle_hashes(rows)
        for i in np.flatnonzero(np.diff(off)):
            yield first + int(i), np.unique(h[off[i]:off[i + 1]])


def document_nodes(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n_shingles, node); node is null for an empty set."""
    rows = docs.select(*keys, text)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in node_sets(b.column(len(keys))):
                n[i], node[i] = len(s), node_id(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n), pa.array(node, mask=n == 0)],
                names=[*keys, "n_shingles", "node"])

    return rows.mapInArrow(nodes, extended(rows.select(*keys), n_shingles="long", node="long"))


def _postings(docs: DataFrame, text: str, counts, parts: int) -> DataFrame:
    """(part, tok, node, n, pos): blobs of prefix postings, dealt by n-gram."""
    def dealt(tok, node, size, pos, freq):
        tok, node, size, pos = map(np.concatenate, (tok, node, size, pos))
        salts = freq[(tok >> _U(64 - BUCKET_BITS)).astype(np.int64)] // SALT_EVERY + 1
        salt = node.view(np.uint64) % salts.astype(np.uint64)
        part = (mix(tok + salt * _U(0x9E3779B97F4A7C15)) % _U(parts)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(part[at]) != 0, True])
        tok, node, size, pos = (x[at] for x in (tok, node, size, pos))
        pieces = list(zip(cuts, cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at][cuts[:-1]], pa.int64()),
             *[pa.array([x[lo:hi].tobytes() for lo, hi in pieces], pa.binary())
               for x in (tok, node, size, pos)]],
            names=["part", "tok", "node", "n", "pos"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen, held, total = counts.value, set(), ([], [], [], []), 0
        for b in batches:
            for _, s in node_sets(b.column(0)):
                v, n = node_id(s), len(s)
                if v in seen:
                    continue
                if len(seen) < SEEN_NODES:
                    seen.add(v)
                p = n - -(-3 * n // 4) + 1
                own = s[np.argsort(order_key(s, freq), kind="stable")[:p]]
                for c, x in zip(held, (own, np.full(p, v, np.int64), np.full(p, n, np.int32),
                                       np.arange(p, dtype=np.int32))):
                    c.append(x)
                total += p
                if total >= HELD_POSTINGS:
                    yield dealt(*held, freq)
                    held, total = ([], [], [], []), 0
        if total:
            yield dealt(*held, freq)

    return docs.select(text).mapInArrow(
        emit, "part long, tok binary, node binary, n binary, pos binary")


def _fits(n1, n2, p1, p2):
    """Whether a pair of sets of these sizes is a candidate by an n-gram at
    these places: sets with the least overlap share one among the first
    n - overlap + 1 of each."""
    need = least_overlap(n1, n2)
    return ((p1 <= n1 - need) & (p2 <= n2 - need)
            & (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)))


def _part_pairs(t: pa.Table, counts) -> pa.Table:
    """Pairs (kind 0: a, b, n, m) of one part, and the postings (kind 1: tok,
    node, n, pos) of the lists that it did not pair completely."""
    blob = lambda c, kind: np.frombuffer(
        b"".join(x.as_py() for x in t.column(c)), kind)
    tok, node = blob("tok", np.uint64), blob("node", np.int64)
    n, pos = blob("n", np.int32).astype(np.int64), blob("pos", np.int32).astype(np.int64)
    at = np.lexsort((node, tok))
    tok, node, n, pos = tok[at], node[at], n[at], pos[at]
    own = np.r_[True, (np.diff(tok) != 0) | (np.diff(node) != 0)]
    tok, node, n, pos = tok[own], node[own], n[own], pos[own]
    # Each list by position: the text that others were copied from has no rare
    # n-grams of its own, so its shared ones come early.
    at = np.lexsort((node, pos, tok))
    tok, node, n, pos = tok[at], node[at], n[at], pos[at]
    begin = np.flatnonzero(np.r_[True, np.diff(tok) != 0])
    length = np.diff(np.r_[begin, len(tok)])
    salted = counts.value[(tok[begin] >> _U(64 - BUCKET_BITS)).astype(np.int64)] >= SALT_EVERY
    left, right = [], []
    for k in range(2, SHORT_LIST + 1):
        first = begin[(length == k) & ~salted]
        for i in range(k):
            for j in range(i + 1, k):
                left.append(first + i)
                right.append(first + j)
    rest = ((length > SHORT_LIST) | salted)
    for centre in range(2):
        some = rest & (length > centre + 1)
        k = length[some] - centre - 1
        first = np.repeat(begin[some] + centre, k)
        left.append(first)
        right.append(first + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k) + 1)
    i, j = np.concatenate(left), np.concatenate(right)
    ok = _fits(n[i], n[j], pos[i], pos[j])
    i, j = i[ok], j[ok]
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    pair = np.unique(np.rec.fromarrays([node[i], node[j], n[i], n[j]]))
    kept = np.repeat(rest, length)
    cols = [np.r_[pair[f], x[kept].astype(np.int64) if x is not tok else x[kept].view(np.int64)]
            for f, x in zip(pair.dtype.names, (tok, node, n, pos))]
    kind = np.r_[np.zeros(len(pair), np.int32), np.ones(int(kept.sum()), np.int32)]
    return pa.table([pa.array(kind), *map(pa.array, cols)], names=["kind", "a", "b", "c", "d"])


def overlaps(docs: DataFrame, text: str, pairs: DataFrame, counts) -> DataFrame:
    """``pairs`` (a, b, n, m) plus ``inter``: exact intersections, counted per
    fragment of the global order and summed per pair."""
    spark = docs.sparkSession
    blocks = max(partitions(spark), -(-pairs.count() // BLOCK_PAIRS))
    # Pairs meet in the block of their a's least neighbour: the members of a
    # star share it, so most sets go to one block only.
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    label = stored(both.groupBy("a").agg(F.min("b").alias("l"))
                       .select("a", F.least("a", "l").alias("label")), "labels")
    sized = pairs.select("a", "b").join(label, "a")
    many = (sized.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
                 .select("label", F.ceil(F.col("k") / BLOCK_PAIRS).alias("k")))
    dealt = stored(join_hot(sized, many, ["label"], "b").select(
        "a", "b", F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("b"), "k")),
                         F.lit(blocks)).alias("block")), "dealt")
    need = stored(dealt.select(F.col("a").alias("node"), "block").union(
        dealt.select(F.col("b").alias("node"), "block")).distinct(), "need")
    low = need.select(F.col("node").bitwiseAND(NODE_FILTER_BITS - 1).alias("p"))
    mask = np.zeros(NODE_FILTER_BITS // 8, np.uint8)
    for r in bitmaps(low).collect():
        mask[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    wanted = spark.sparkContext.broadcast(mask)
    cuts = pivots(counts.value)

    def batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
             pa.array(out[2], pa.binary())], names=["node", "fragment", "members"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bit = counts.value, wanted.value
        seen: set[int] = set()
        for b in batches:
            out, total = ([], [], []), 0
            for _, s in node_sets(b.column(0)):
                v = int(node_id(s))
                p = v & (NODE_FILTER_BITS - 1)
                if not bit[p >> 3] >> (p & 7) & 1 or v in seen:
                    continue
                if len(seen) < SEEN_NODES:
                    seen.add(v)
                f = np.searchsorted(cuts, order_key(s, freq), side="right")
                for k in np.unique(f).tolist():
                    for c, x in zip(out, (v, k, s[f == k].tobytes())):
                        c.append(x)
                total += len(s)
                if total >= HELD_POSTINGS:
                    yield batch(out)
                    out, total = ([], [], []), 0
            yield batch(out)

    def partial(s: pa.Table, p: pa.Table) -> pa.Table:
        """Overlaps of the pairs (sorted by a) of one block in one fragment."""
        p = p.sort_by("a")
        at: dict[int, int] = {}
        for i, v in enumerate(s.column("node").to_pylist()):
            at.setdefault(v, i)
        members = s.column("members")

        def numbers(v):
            i = at.get(v)
            return [] if i is None else np.frombuffer(members[i].as_py(), np.uint64).tolist()

        c, last, own = [], None, frozenset()
        for x, y in zip(p.column("a").to_pylist(), p.column("b").to_pylist()):
            if x != last:
                last, own = x, frozenset(numbers(x))
            c.append(len(own.intersection(numbers(y))) if own else 0)
        got = np.array(c, np.int64)
        return pa.table([p.column("a"), p.column("b"), pa.array(got)],
                        names=["a", "b", "c"]).filter(pa.array(got > 0))

    small = need.count() <= BROADCAST_ROWS
    segs = docs.select(text).mapInArrow(segments, "node long, fragment int, members binary")
    segs = segs.join(F.broadcast(need) if small else need, "node")
    own = dealt.withColumn("fragment", F.explode(F.array(*[F.lit(i) for i in range(FRAGMENTS)])))
    got = (segs.groupBy("block", "fragment").cogroup(own.groupBy("block", "fragment"))
           .applyInArrow(partial, "a long, b long, c long")
           .groupBy("a", "b").agg(F.sum("c").alias("inter")))
    return pairs.join(got, ["a", "b"])


def linked(overlap: DataFrame) -> DataFrame:
    union = F.col("n") + F.col("m") - F.col("inter")
    return overlap.where(100 * F.col("inter") >= 75 * union).select("a", "b")


def node_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, component) of the nodes of ``docs`` that have a link."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(ngram_frequencies(docs, text))
    parts = partitions(spark)
    found = stored(_postings(docs, text, counts, parts).groupBy("part").applyInArrow(
        lambda t: _part_pairs(t, counts), "kind int, a long, b long, c long, d long"), "found")
    pairs = stored(found.where("kind = 0").select("a", "b", F.col("c").alias("n"),
                                                  F.col("d").alias("m")).distinct(), "pairs")
    links = stored(linked(overlaps(docs, text, pairs, counts)), "links")
    same = components(links, "a", "b")

    # Lists that were not paired completely: pairs across components.
    rest = (found.where("kind = 1")
                 .select(F.col("a").alias("tok"), F.col("b").alias("node"),
                         F.col("c").cast("long").alias("n"), F.col("d").alias("pos"))
                 .join(same, "node", "left")
                 .withColumn("component", F.coalesce("component", "node")))
    mixed = rest.groupBy("tok").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    rest = stored(rest.join(mixed.where("x <> y").select("tok"), "tok"), "rest")
    l, r = (rest.select("tok", *[F.col(c).alias(f"{c}_{k}") for c in
                                 ("node", "n", "pos", "component")]) for k in "lr")
    need = F.ceil(3 * (F.col("n_l") + F.col("n_r")) / 7)
    across = (l.join(r, (l["tok"] == r["tok"]) & (F.col("node_l") < F.col("node_r"))
                     & (F.col("component_l") != F.col("component_r"))
                     & (F.col("pos_l") <= F.col("n_l") - need)
                     & (F.col("pos_r") <= F.col("n_r") - need)
                     & (4 * F.least("n_l", "n_r") >= 3 * F.greatest("n_l", "n_r")))
               .select(F.col("node_l").alias("a"), F.col("node_r").alias("b"),
                       F.col("n_l").alias("n"), F.col("n_r").alias("m")).distinct()
               .join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    across = stored(across, "across")
    if across.count():
        more = stored(linked(overlaps(docs, text, across, counts)), "more")
        same = components(links.union(more), "a", "b")
    return same


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    nodes = stored(document_nodes(docs, [id_col], text), "nodes")
    first = stored(nodes.where("node is not null").groupBy("node")
                        .agg(F.min(id_col).alias("least")), "first")
    same = node_components(docs, text)

    # Components by their smallest document.
    own = (first.join(same, "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    member = join_hot(own, least, ["component"], "node").select("node", "component_id")
    return (nodes.join(member, "node", "left")
                 .select(id_col, "n_shingles",
                         F.when(F.col("node").isNull(), F.col(id_col))
                         .otherwise(F.col("component_id")).alias("component_id")))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, unchanged: the smallest id, a null
    id after any other, ties by node and row. Rows are told apart by a stored
    number, so ids may be shared or missing; rows with an empty set all stay."""
    rows = stored(docs.withColumn("_nj_row", F.monotonically_increasing_id()), "rows")
    nodes = stored(document_nodes(rows, [id_col, "_nj_row"], text).where("node is not null")
                   .select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                           "node", F.col("_nj_row").alias("row")), "nodes")
    least = F.min(F.struct("none", "id", "node", "row")).alias("least")
    first = (nodes.groupBy("node").agg(least).join(node_components(rows, text), "node", "left")
                  .select(F.coalesce("component", "node").alias("component"), "least.*"))
    stays = first.groupBy("component").agg(least).select("least.row")
    drop = nodes.join(stays, "row", "left_anti").select(F.col("row").alias("_nj_row"))
    return without_ids(rows, drop, "_nj_row").drop("_nj_row")


def op4_vertical_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
