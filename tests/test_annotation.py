import random

import pytest

from pyspark.sql import functions as F

from assayline.operators import annotate as AN
from assayline.sources import annotation as SA


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_alignment_score_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [("ABCBDAB", "BDCABA"), ("PEPTIDE", "PETIDES"), ("", "ABC"), (None, "A")]
    pairs += [("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 15))),
               "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 15)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["s"] for r in df.select(AN.alignment_score("a", "b").alias("s")).collect()]
    exp = [None if a is None or b is None else _lcs(a, b) for a, b in pairs]
    assert got[:2] == [4, 6]
    assert got == exp


def _align_by_matrix(a, b):
    """The stated tie rule on a whole matrix."""
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and (not j or dp[i - 1][j] == dp[i][j]):
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return dp[-1][-1], x, y


def test_alignments_against_the_whole_matrix(spark):
    rnd = random.Random(8)
    pairs = [("", ""), ("", "AB"), ("AB", ""), ("PEPTIDE", "PETIDES"), ("A" * 70, "A" * 65)]
    pairs += [tuple("".join(rnd.choice("ACG") for _ in range(rnd.randint(0, 90))) for _ in "ab")
              for _ in range(150)]
    rows = spark.createDataFrame(pairs + [(None, "A")], "a string, b string")
    got = [tuple(r) for r in rows.select(AN.alignment("a", "b").alias("x")).select("x.*").collect()]
    assert got[:-1] == [_align_by_matrix(a, b) for a, b in pairs] and got[-1] == (None, None, None)
    for (score, x, y), (a, b) in zip(got, pairs):
        assert x.replace("-", "") == a and y.replace("-", "") == b
        assert score == sum(p == q for p, q in zip(x, y))


def test_long_alignment_keeps_few_rows():
    a, b = "ACGT" * 2500, "AGCT" * 2500
    score, x, y = AN.align(a, b)
    assert score == AN.lcs_length(a, b) == sum(p == q for p, q in zip(x, y))
    assert x.replace("-", "") == a and y.replace("-", "") == b


def test_peptide_messages_and_defaults(spark):
    rec = spark.createDataFrame(
        [("P1", '{"sequence":{"value":"PEPTIDEXX"},"proteinDescription":{"recommendedName":'
                '{"fullName":{"value":"Alpha"}}}}'),
         ("P2", '{"sequence":{"value":""},"proteinDescription":{}}')], "uniprot string, json string")
    pep = spark.createDataFrame([("P1", "PEP"), ("P1", "TIDE"), ("P1", "ZZZ"), ("P2", "PEP"),
                                 ("P9", "PEP")], "UniProt string, Peptide string")
    out = {(r["UniProt"], r["Peptide"]): r for r in
           AN.join_protein_record(pep, rec, F.col("Peptide")).collect()}
    assert out[("P1", "PEP")]["position"] == 0
    assert out[("P1", "TIDE")]["message"] == AN.FOUND % ("TIDE", 3)
    assert out[("P1", "ZZZ")]["message"] == AN.NOT_FOUND and out[("P1", "ZZZ")]["position"] == -1
    assert out[("P2", "PEP")]["message"] == AN.NO_SEQUENCE
    assert out[("P2", "PEP")]["protein_name"] == AN.NAME_NOT_FOUND
    assert out[("P9", "PEP")]["message"] == AN.NO_SEQUENCE
    assert out[("P9", "PEP")]["protein_length"] is None and out[("P1", "PEP")]["protein_length"] == 9


def _records(spark, sequences, size):
    """Records of whole sequences, cut into segments of ``size``."""
    rows = [(u, k // size, k, len(s), s[k:k + size], "n")
            for u, s in sequences.items() for k in range(0, max(1, len(s)), size)]
    df = spark.createDataFrame(rows, "uniprot string, segment long, start long, length long, "
                                     "residues string, name string")
    return df.select("uniprot", "segment", SA.record_json().alias("json")).repartition(3)


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_positions_in_segments_equal_those_in_whole_sequences(spark, size):
    """Peptides across cuts, longer than a segment, repeated, at both ends."""
    rnd = random.Random(size)
    seqs = {f"P{k}": "".join(rnd.choice("AB") for _ in range(rnd.randint(0, 60))) for k in range(9)}
    seqs.update(P100="ABAB" * 10, P101="")
    rows = [(u, p) for u, s in seqs.items() for p in
            {"", None, s, s + "A", s[:5], s[-4:], "ABABAB", "BB", "A", s[3:20], s[1:], "C"}] * 2
    pep = spark.createDataFrame(rows + [("none", "AB"), (None, "AB")],
                                "UniProt string, Peptide string").withColumn("start", F.lit("x"))
    got = AN.join_protein_record(pep, _records(spark, seqs, size), F.col("Peptide"))
    assert got.columns == ["UniProt", "Peptide", "start", "protein_length", "protein_name",
                           "position", "message"]
    assert got.count() == len(rows) + 2
    for r in got.collect():
        s, p = seqs.get(r["UniProt"]), r["Peptide"]
        want = None if not s or p is None else s.find(p)
        assert r["position"] == want, (r, s)
        if not s:
            assert r["message"] == AN.NO_SEQUENCE
        elif p is not None and p in s:
            assert r["message"] == AN.FOUND % (p, want)
        else:
            assert r["message"] == AN.NOT_FOUND


def test_every_name_stands_in_its_protein(spark, duck):
    """The records' segments join to the whole sequence, with every name in it."""
    from conftest import SF001
    rec = AN.read_records(SA.protein_records(spark, SF001, segment=50)).collect()
    whole, length = {}, {}
    for r in sorted(rec, key=lambda r: (r["uniprot"], r["segment"])):
        assert r["start"] == 50 * r["segment"] == len(whole.get(r["uniprot"], ""))
        whole[r["uniprot"]] = whole.get(r["uniprot"], "") + r["residues"]
        length[r["uniprot"]] = r["length"]
    names = duck.execute("select distinct p_brand, upper(replace(p_name, ' ', '')) from part "
                         "order by 1, 2").fetchall()
    assert whole == {u: "".join(n for b, n in names if b == u) for u, _ in names}
    assert length == {u: len(s) for u, s in whole.items()} and max(length.values()) > 50


def test_running_offsets_over_slices(spark):
    from assayline.operators.ranks import running_offsets
    rows = [(k % 3 == 0, k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g boolean, k long, n long").repartition(5)
    got = {r["k"]: r["o"] for r in running_offsets(df, "n", ["g"], ["k"], "o").collect()}
    for g, k, _ in rows:
        assert got[k] == sum(n for g2, k2, n in rows if g2 == g and k2 < k)


def test_go_terms_dedup_and_default(spark):
    prots = spark.createDataFrame([("P1",), ("P1",)], "UniProt string")
    ann = spark.createDataFrame([("P1", "GO:1"), ("P1", "GO:1"), ("P1", "GO:2")],
                                "uniprot string, go_id string")
    names = spark.createDataFrame([("GO:1", "binding")], "go_id string, name string")
    terms = AN.join_go_terms(prots, ann, names)
    assert sorted((r["go_id"], r["go_name"]) for r in terms.collect()) == \
        [("GO:1", "binding"), ("GO:2", AN.GO_NO_DESCRIPTION)]
    m = AN.go_map(terms).first()["go_terms"]
    assert m == {"GO:1": "binding", "GO:2": AN.GO_NO_DESCRIPTION}
