import math

import numpy as np
import pytest

from llm_tables import SF001, edge, empty, small_docs  # noqa: F401

from assayline.llm import packing, rp_forest, toxicity_grammar
import corpus_pipeline


def _vectors(seed=4, groups=30, members=8, alone=400, dim=32):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = r.normal(size=dim)
        for _ in range(members):
            out.append(c + r.normal(size=dim) * r.uniform(0.02, 0.16))
    out += list(r.normal(size=(alone, dim)))
    return np.array(out, np.float32)


def _brute(rows):
    ok = [(i, np.array(v, float), l) for i, v, l in rows
          if i is not None and l is not None and v and all(x is not None and math.isfinite(x)
                                                           for x in v) and any(v)]
    links = []
    for k, (i, a, l) in enumerate(ok):
        for j, b, m in ok[:k]:
            if l == m and len(a) == len(b) and a @ b / (
                    np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.append((i, j))
    return links


def test_forest_keeps_doubles(spark):
    """Cosines on either side of the threshold that floats cannot tell apart,
    and components beyond the range of floats."""
    t, e = 0.98, 1e-12
    rows = [(0, [1.0, 0.0])]
    for i, c in ((1, t - e), (2, t + e)):
        rows += [(i, [c, (1 - c * c) ** 0.5])]
    rows += [(3, [1e300, 0.0, 0.0]), (4, [1e299, 1e290, 0.0]), (5, [0.0, 1e-300, 1.0])]
    df = spark.createDataFrame([(i, "x", v) for i, v in rows],
                               "vec_id long, label string, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in rp_forest.near_duplicates(df).collect()}
    norm = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max()
            for i, v in rows}
    for i, _ in rows:
        links = [j for j, _ in rows if j != i and len(norm[i]) == len(norm[j])
                 and norm[i] @ norm[j] >= t]
        assert got[i][0] == len(links), i
    assert got[0][0] == 1 and got[4] == (1, 3)


def test_forest_recall_and_precision(spark, monkeypatch):
    x = _vectors()
    rows = [(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x)]
    links = _brute(rows)
    monkeypatch.setattr(rp_forest, "LEAF", 32)
    docs = spark.createDataFrame(rows, "rep long, v array<float>, label int")
    got = {tuple(r) for r in rp_forest.forest_links(
        docs.select("rep", "label", "v").withColumnRenamed("label", "grp"),
        node_size=100).collect()}
    want = {tuple(sorted(p)) for p in links}
    assert got <= want and len(want) > 100
    assert len(got) >= 0.98 * len(want)


def test_near_copies_that_no_plane_divides(spark):
    """A cloud of near copies larger than a node is compared as blocks."""
    r = np.random.default_rng(1)
    c = r.normal(size=16)
    rows = [(i, [float(z) for z in (c + r.normal(size=16) * 0.001).astype(np.float32)], 1)
            for i in range(150)]
    docs = spark.createDataFrame(rows, "rep long, v array<float>, grp int")
    got = rp_forest.forest_links(docs, node_size=40).count()
    assert got == 150 * 149 // 2


@pytest.mark.parametrize("node_size", [40, 1000])
def test_degrees_of_a_cloud_without_its_pairs(spark, node_size):
    """Counts and components equal those of all pairs, clouds and strangers at
    the edge of a cloud included; no list of pairs is emitted."""
    r = np.random.default_rng(2)
    c = r.normal(size=16)
    x = [c + r.normal(size=16) * s for s in [0.001] * 150 + list(r.uniform(0.05, 0.2, 60))]
    x += list(r.normal(size=(40, 16)))
    rows = [(i, [float(z) for z in v], 1, 1 + i % 3) for i, v in enumerate(x)]
    reps = spark.createDataFrame(rows, "rep long, v array<double>, grp int, m long")
    got = rp_forest.forest_degrees(reps, node_size=node_size).collect()
    links = {tuple(sorted(p)) for p in _brute([(i, v, g) for i, v, g, _ in rows])}
    want = {}
    for a, b in links:
        want[a] = want.get(a, 0) + rows[b][3]
        want[b] = want.get(b, 0) + rows[a][3]
    sums = {}
    for k in got:
        sums[k["rep"]] = sums.get(k["rep"], 0) + k["others"]

    def parts(edges):
        reach = {i: {i} for i in want}
        for p, q in edges:
            both = reach[p] | reach[q]
            reach.update(dict.fromkeys(both, both))
        return {frozenset(r) for r in reach.values()}

    assert sums == want and len(links) > 150 * 149 // 2
    assert parts((k["rep"], k["near"]) for k in got) == parts(links)
    assert len(got) < len(links) // 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2),
            (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
            (8, [1.0, nan], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(str(tuple(r)) for r in rp_forest.near_duplicates(docs).collect())
    # 0, 1, 1 are one class of three rows; 2 is parallel to it.
    want = [(0, 3, 0), (1, 3, 0), (1, 3, 0), (2, 3, 0), (None, 0, None)]
    want += [(i, 0, i) for i in range(3, 12)]
    assert got == sorted(map(str, want))
    assert rp_forest.near_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    from assayline.llm.common import stored, table
    docs = table(spark, SF001, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF001), name)
        out.append((name, docs))
    return dict(out)


def test_pipeline_stages(spark, stages, small_docs):
    from test_exact_and_near import _near_brute, _normal, _suffix_brute
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {n: {r["doc_id"]: r["text"] for r in d.collect()}
            for n, d in stages.items() if n != "packing"}
    assert all(stages[n].columns == cols for n in rows)
    # Toxicity: exactly the rows the scored query marks go.
    marked = {r["doc_id"] for r in toxicity_grammar.op10_toxicity_grammar(spark, SF001).collect()
              if r["predicted"]}
    assert set(rows["toxicity"]) == set(rows["documents"]) - marked
    first = {}
    for i, t in sorted(rows["toxicity"].items()):
        first.setdefault(_normal(t), i)
    assert set(rows["exact_dedup"]) == set(first.values())
    alike = sorted(rows["exact_dedup"].items())
    kept = {eval(x)[0] for x in _near_brute(alike) if eval(x)[0] == eval(x)[2]}
    assert set(rows["near_dedup"]) == kept
    want = {i: k for i, *_, k in _suffix_brute(sorted(rows["near_dedup"].items()))}
    import hashlib
    same = sum(hashlib.sha256((t or "").encode()).hexdigest() == want[i]
               for i, t in rows["repeated_passages"].items())
    # A span may cut through a character, which then goes too.
    assert same >= 0.95 * len(want) and set(rows["repeated_passages"]) == set(want)
    packed = {r["doc_id"] for r in stages["packing"].collect()}
    assert packed == set(want)


def test_run_equals_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF001).select(*key).collect()))
    assert a == sorted(map(tuple, stages["packing"].select(*key).collect()))


def test_registry():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and packing
