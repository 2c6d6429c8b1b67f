import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_tables import SF001, edge, empty, small_docs  # noqa: F401

from assayline.llm import packing, sharding


def _check_shards(rows, n):
    rows = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    for k in range(n):
        own = [r for r in rows if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
    # Contiguous in the global order.
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    edge = 0
    for k in range(n):
        edge += sum(r["size"] for r in rows if r["shard"] == k)
        assert abs(edge - total * (k + 1) / n) <= most


def test_shards_are_contiguous_balanced_and_numbered(spark, small_docs):
    got = [r.asDict() for r in sharding.op1_prefix_sum_shards(spark, SF001).collect()]
    _check_shards(got, 40)
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
            for i, t in small_docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)


def test_shards_of_odd_rows(edge, empty):
    def run(docs):
        return sharding.assign(sharding.sizes(docs), ["doc_id", "text_crc32", "size"], "size", 7)
    got = [r.asDict() for r in run(edge).collect()]
    assert len(got) == edge.count()
    _check_shards(got, 7)
    assert run(empty).count() == 0


def _check_packed(rows, capacity=packing.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_matches_the_tokenizer_and_fills_sequences(edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [r.asDict() for r in packing.packed_documents(edge, path).collect()]
    t = Tokenizer.from_file(path)
    texts = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = []
    for i, x in texts:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        n = len(ids)
        first = n if n <= 2048 else n % 2048 or 2048
        cuts = [0, first, *range(first + 2048, n, 2048), n] if n > first else [0, n]
        want += [(i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
                 for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[k] for k in keys)) for r in got)
    total = sum(r["length"] for r in got)
    assert _check_packed(got) <= -(-total // 2048) + 1
    assert packing.packed_documents(empty, path).count() == 0


def test_tree_rounds_keep_every_piece(spark):
    """Many leaves: bins travel up the tree and stay whole."""
    r = np.random.default_rng(5)
    sizes = [int(x) for x in r.integers(1, 1500, 3000)] + [2048] * 5
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long")
    got = [x.asDict() for x in packing.pack(items, leaf_pieces=100, fan_in=3).collect()]
    assert sorted((x["id"], x["length"]) for x in got) == list(enumerate(sizes))
    used = _check_packed(got)
    assert used <= sum(sizes) / 2048 * 1.02 + 1


def test_best_fit_prefers_the_fullest_bin():
    where = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert where == [0, 1, 0, 1, 1]
    assert packing.best_fit([], 10) == []
