import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_tables import SF001, edge, empty, small_docs  # noqa: F401

from assayline.llm import bloom_dedup, ngram_join, shingles, suffix_dedup
from assayline.llm.common import components


def _normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _exact(docs):
    got = bloom_dedup.exact_dedup(bloom_dedup.with_digest(docs)).select(
        "doc_id", "_bd_keep", "_bd_size", "_bd_sha")
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["_bd_keep"], r["_bd_size"],
                   bytes(r["_bd_sha"]).hex()) for r in got.collect())


def test_exact_dedup_brute_force(edge, empty):
    rows = [(r["doc_id"], _normal(r["text"])) for r in edge.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        want.append((i is not None, i or 0, min(ids) if ids else None, len(groups[t]),
                     hashlib.sha256(t.encode()).hexdigest()))
    assert _exact(edge) == sorted(want)
    assert _exact(empty) == []
    kept = bloom_dedup.kept_rows(edge)
    assert kept.columns == edge.columns
    # 0, 1 are both empty; 3 and 18 are equal; 5 comes twice and 6 equals it.
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 1 not in ids and 6 not in ids and 18 not in ids and ids.count(5) == 2


def test_exact_dedup_stage_keeps_one_row_of_each_text(spark, edge, empty):
    """A table loaded twice, a text without ids, shared ids with unlike texts."""
    import corpus_pipeline
    rows = [(4, "a text"), (4, "a text"), (2, "a  text"), (None, "a text"), (4, "other"),
            (None, "no id"), (None, "no\tid"), (None, "no id"), (8, None), (9, ""), (5, "alone")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], _normal(r["text"]))
                  for r in corpus_pipeline.exact_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(2, "a text"), (4, "other"), (None, "no id"), (8, ""), (5, "alone")],
                         key=str)
    kept = corpus_pipeline.exact_dedup(spark, edge.union(edge), "")
    assert kept.columns == edge.columns
    texts = [_normal(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({_normal(r["text"]) for r in edge.collect()})
    assert corpus_pipeline.exact_dedup(spark, empty, "").count() == 0


def test_exact_dedup_with_a_full_filter(edge):
    """A filter far too small only sends more rows the exact way."""
    own = bloom_dedup.with_digest(edge)
    a = bloom_dedup.exact_dedup(own, bits_per_row=1, max_bits=32768)
    key = lambda r: str((r["doc_id"], r["_bd_keep"], r["_bd_size"]))
    b = bloom_dedup.exact_dedup(own)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def _word_sets(rows, size=5):
    sets = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(set(zip(*[w[k:] for k in range(size)])) if len(w) >= size
                    else ({tuple(w)} if w else set()))
    return sets


def _near_brute(rows):
    sets = _word_sets(rows)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            c = len(a & b)
            if a and b and 100 * c >= 75 * (len(a) + len(b) - c):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(str((k, len(sets[i]), least.get(root(i)) if sets[i] else k))
                  for i, (k, _) in enumerate(rows))


def _near(docs):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"]))
                  for r in ngram_join.near_groups(docs).collect())


def test_near_groups_brute_force(edge, empty):
    assert _near(edge) == _near_brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert _near(empty) == []


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Shared ids with unlike texts, null ids, and rows that come twice."""
    from llm_tables import words

    def copy(base, k):
        return " ".join([*base[:k], "changed", *base[k + 1:]])

    a, b, c, d = (words(s, 80) for s in (11, 12, 13, 14))
    rows = [(3, " ".join(a)), (7, copy(a, 40)), (7, " ".join(b)), (None, copy(a, 20)),
            (None, " ".join(c)), (None, copy(c, 30)), (None, copy(c, 50)),
            (9, " ".join(d)), (9, " ".join(d)), (9, copy(d, 30)), (None, None), (None, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(4)
        got = ngram_join.kept_rows(docs)
        assert got.columns == docs.columns
        got = [tuple(r) for r in got.collect()]
        assert len(got) == 6
        assert (3, " ".join(a)) in got and (7, " ".join(b)) in got
        assert [i for i, _ in got].count(9) == 1 and [i for i, _ in got].count(7) == 1
        # One of the null-id copies of c; texts without words have no copies.
        assert sum(i is None for i, _ in got) == 3
        assert sum(r in rows[4:7] for r in got) == 1


def test_near_groups_of_many_copies(spark, monkeypatch):
    """Lists longer than SHORT_LIST, hot n-grams with salts, several blocks:
    chains of near copies whose ends are not alike."""
    from llm_words import chain
    rows = chain()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _near_brute(rows)
    assert _near(docs) == want
    monkeypatch.setattr(ngram_join, "SALT_EVERY", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 50)
    assert _near(docs) == want


def test_shingles_do_not_depend_on_slices(monkeypatch, small_docs):
    col = pa.array([t for _, t in small_docs] + [None, "", " x ", "a b c d e f"])
    h, off = shingles.shingle_hashes(col)
    monkeypatch.setattr(shingles, "SLICE", 300)
    h2, off2 = shingles.shingle_hashes(col)
    assert (h == h2).all() and (off == off2).all()
    sets = _word_sets([(0, x.as_py()) for x in col])
    assert [len(set(h[a:b].tolist())) for a, b in zip(off, off[1:])] == [len(s) for s in sets]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert dict(map(tuple, got.collect())) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _suffix_brute(rows):
    """Documents in order of id; a byte goes when a 100-byte string over it
    starts earlier."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k:k + 100]
            if w in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_CONTEXTS, 2])
def test_suffix_dedup_brute_force(spark, edge, hot, monkeypatch):
    """Odd rows, long texts cut into slices, and hot anchors dealt by window."""
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot,))
    rows = {r["doc_id"]: r["text"] for r in edge.collect()}
    order = sorted(rows.items(), key=lambda x: (x[0] is not None, x[0] or 0))
    want = {i: (n, h) for i, _, n, _, h in _suffix_brute(order)}
    got = suffix_dedup.deduplicated(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        raw = (r["text"] or "").encode()
        kept, gone, _ = suffix_dedup._cut(raw, r["_sa_lo"], r["_sa_hi"])
        assert (gone, hashlib.sha256(b"".join(kept)).hexdigest()) == want[r["doc_id"]], r["doc_id"]


def test_suffix_query_and_stage(spark, small_docs, edge, empty):
    got = [tuple(r) for r in suffix_dedup.op2_suffix_array_dedup(spark, SF001).collect()]
    assert sorted(got) == _suffix_brute(small_docs)
    out = suffix_dedup.without_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert out.where("text is null").count() == 1
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_runs_do_not_depend_on_slices(monkeypatch, small_docs):
    """The windows of all runs together are all windows, whatever the slices."""
    raw = [(t or "").encode() for _, t in small_docs[:40]] + [b"z" * 3000]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.r_[0, np.cumsum([len(x) for x in raw])]
    for size in (suffix_dedup.SLICE, 1000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        row, a, lo, hi, fp, _ = suffix_dedup.runs(data, off)
        seen = sorted((int(r), w) for r, x, y in zip(row, lo, hi) for w in range(x, y + 1))
        assert seen == [(r, w) for r, x in enumerate(raw) for w in range(len(x) - 99)]
        assert ((a >= lo) & (a - hi >= 0) & (a - lo <= 80)).all()


def test_index_family_levels_grow_geometrically():
    family = suffix_dedup.IndexFamily()
    r = np.random.default_rng(3)
    met = set()
    for _ in range(40):
        batch = [bytes(x) for x in r.integers(65, 67, (50, 100), dtype=np.uint8)]
        batch[7] = batch[3]
        batch[9] = next(iter(met), batch[9])
        want = []
        for w in batch:
            want.append(w in met)
            met.add(w)
        assert family.add(np.array(batch, "S100")).tolist() == want
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(met) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_suffix_parts_and_families_are_bounded(spark, edge, monkeypatch):
    """More text makes more parts, and no family holds more than its share."""
    r = np.random.default_rng(5)
    text = r.integers(65, 70, 40_000, dtype=np.uint8).tobytes()
    text += text[:9_000]  # 180 bytes every 41, as contexts overlap
    begin = np.arange(0, len(text) - 180, 41)
    n = len(begin)
    blob = lambda v: [np.asarray(v, np.int64).tobytes()]
    group = pa.table({"part": [0], "doc": blob(np.zeros(n)), "tie": blob(np.zeros(n)),
                      "lo": blob(begin), "hi": blob(begin + 80), "size": blob(np.full(n, 180)),
                      "text": [b"".join(text[b:b + 180] for b in begin.tolist())]})
    want = suffix_dedup._scan_family(group, 3)
    most = []
    add = suffix_dedup.IndexFamily.add

    def counted(self, windows):
        out = add(self, windows)
        most.append(sum(map(len, self.levels)))
        return out

    monkeypatch.setattr(suffix_dedup.IndexFamily, "add", counted)
    monkeypatch.setattr(suffix_dedup, "FAMILY_WINDOWS", 4_000)
    got = suffix_dedup._scan_family(group, 3)
    assert got.equals(want) and want.num_rows and max(most) < 6_000
    monkeypatch.undo()

    def spans():
        rows = suffix_dedup.deduplicated(edge).select("doc_id", "text", "_sa_lo", "_sa_hi")
        return sorted(map(tuple, rows.collect()), key=str)

    # The whole operator, in many parts.
    for hot in (suffix_dedup.HOT_CONTEXTS, 2):
        monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot,))
        want = spans()
        with monkeypatch.context() as m:
            for name, value in (("PART_TEXT", 2_000), ("PART_CONTEXTS", 500),
                                ("PIECE_TEXT", 3_000), ("GATHER", 300), ("FAMILY_WINDOWS", 50)):
                m.setattr(suffix_dedup, name, value)
            made, real = [], suffix_dedup._contexts
            m.setattr(suffix_dedup, "_contexts",
                      lambda docs, parts: made.append(parts) or real(docs, parts))
            got = spans()
        assert got == want and made[0] > 8


def test_merged_spans_of_many_documents():
    """More than 2**23 documents in one part, and none."""
    n = (1 << 23) + 6
    doc, zero = np.arange(n), np.zeros(n, np.int64)
    got = suffix_dedup.merged(np.r_[doc, 3, 3], np.r_[zero, 0, 0],
                              np.r_[zero + 5, 7, 300], np.r_[zero + 9, 20, 400])
    assert np.array_equal(got[0], np.r_[doc[:4], 3, doc[4:]])
    assert np.array_equal(got[2], np.r_[zero[:4] + 5, 300, zero[4:] + 5])
    assert np.array_equal(got[3], np.r_[zero[:3] + 9, 20, 400, zero[4:] + 9])
