"""Operators 11 to 13 against brute force, on small tables with the odd cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from llm_tables import edge, empty, small_docs  # noqa: F401

from assayline.llm import conversation_trie as CT
from assayline.llm import license_scan as LS
from assayline.llm import spelling_variants as SV

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# Operator 11 ------------------------------------------------------------------------------
def _scan_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = []
    for t in LS.library():
        for s in range(-len(t["words"]), len(words)):
            if all(s + o >= 0 and words[s + o:s + o + len(p)] == p for o, p in t["phrases"]):
                same = sum(0 <= s + j < len(words) and words[s + j] == w
                           for j, w in enumerate(t["words"]))
                places.append((t["label"], t["base"], s, same / len(t["words"])))
    return len(words), sorted(places)


LICENSE_TEXTS = [
    None, "", "Released under the MIT License.", "under the mit  LICENSE under the mit license",
    "the mit license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
    "not use this file except in compliance with the License.", "CC BY-NC 4.0 cc-by-sa cc/by\tnd",
    "mit " * 3000, "under the " * 50 + "MIT license", "license version 3",
    "This work is licensed under the GNU General Public License, version 3.",
    "gnu general public license version 3", "ünder the mit license", "under the mit licensé",
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU General Public License as published by the Free Software Foundation, either version "
    "2 of the License, or (at your option) any later version.",
    "GNU General Public License as published by me, either version 2 of the license",
    "SPDX-License-Identifier: Apache-2.0", "apache license version 2 apache license version 2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction", "İ under\u0000the\x7fmit`license 日本 under the mit license日"]


def _scan_rows(docs):
    return docs.select("doc_id", "text", "license_scan.n_words", "license_scan.places").collect()


def test_license_scan_brute_force(spark, edge, empty):
    docs = spark.createDataFrame(
        [(None if k % 7 == 3 else k, t, "x", 1.0) for k, t in enumerate(LICENSE_TEXTS)] * 2,
        "doc_id long, text string, labels string, score double").repartition(3)
    out = LS.scan(docs)
    assert out.columns == [*docs.columns, "license_scan"]
    for rows in (_scan_rows(out), _scan_rows(LS.scan(edge))):
        for r in rows:
            n, want = _scan_brute(r["text"])
            got = sorted((p["label"], p["base"], p["start"], p["score"]) for p in r["places"])
            assert r["n_words"] == n
            assert [g[:3] for g in got] == [w[:3] for w in want], r["text"]
            assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert out.count() == 2 * len(LICENSE_TEXTS) and LS.scan(empty).count() == 0


def test_license_scan_is_the_same_for_any_idf(spark):
    """IDF decides what is looked up, never what is found."""
    docs = spark.createDataFrame(list(enumerate(LICENSE_TEXTS)), "doc_id long, text string")
    notices = LS.library()
    df = LS.document_frequencies(docs, notices)
    has = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER)))
           for t in LICENSE_TEXTS]
    assert df == {w: sum(w in words for words in has) for w in df} and df["mit"] > 5
    want = {r["doc_id"]: r["places"] for r in _scan_rows(LS.scan(docs, df=df))}
    for rare, other in ((1, df), (9, df), (3, {w: -n for w, n in df.items()})):
        got = {r["doc_id"]: r["places"]
               for r in _scan_rows(LS.scan(docs, notices=notices, df=other, rare=rare))}
        assert got == want


# Operator 12 ------------------------------------------------------------------------------
def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _word_counts_brute(rows):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    return {w: m for w, m in n.items() if m >= 2}


def _groups_brute(n):
    out = {}
    for w in n:
        near = [v for v in n if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v.encode())) if near else None
        out[w] = (len(near), best if best is not None and n[best] >= 10 * n[w] else None)
    rows = []
    for w, (k, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(rows)


def _groups(words):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
                  for r in SV.variant_groups(words).collect())


def test_word_counts_and_groups_of_documents(spark, edge, empty, small_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    want = _word_counts_brute(rows)
    got = {r["word"]: r["n"] for r in SV.word_counts(edge).collect()}
    assert got == want and len(got) > 10
    assert SV.variant_groups(SV.word_counts(empty)).count() == 0
    docs = spark.createDataFrame(small_docs, "doc_id long, text string")
    n = _word_counts_brute(small_docs)
    assert {r["word"]: r["n"] for r in SV.word_counts(docs).collect()} == n


def test_groups_of_edited_words_brute_force(spark):
    r = random.Random(5)
    words = {"abcdefg", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "babababa", "éàüéàüé",
             "x" * 400, "x" * 399 + "y", "x" * 401, "x" * 402}
    letters = "abcé"
    seeds = ["".join(r.choice(letters) for _ in range(r.randint(7, 13))) for _ in range(25)]
    for s in seeds:  # edits at every place, chains of them
        for _ in range(25):
            at, c = r.randrange(len(s) + 1), r.choice(letters)
            s2 = r.choice([s[:at] + c + s[at:], s[:at] + s[at + 1:], s[:at] + c + s[at + 1:]])
            if len(s2) >= 7:
                words.add(s2)
                s = r.choice([s, s2])
    n = {w: r.choice([2, 3, 20, 30, 200, 300, 2000, 30000, 400000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    want = _groups_brute(n)
    assert _groups(df) == want
    assert max(k[4] for k in want) > 5 and any(k[2] not in (k[0], k[1]) for k in want)


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """Spark sizes key rows by the words' file, so a table just under the
    threshold would reach the driver many times as large."""
    words = spark.createDataFrame([(f"wordword{i:04d}", 1 + 99 * (i % 50 == 0))
                                   for i in range(300)], "word string, n long")
    plans, real = [], SV.stored

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(SV, "stored", kept)
    out = SV.variant_groups(words)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 300
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("Broadcast" in p for p in joins)


def test_a_key_that_many_words_share_loses_no_pair(spark):
    """Thousands of words that share three quarters, one near its neighbours."""
    words = ["prefixprefixprefix" + "".join(chr(97 + (k // 26 ** j) % 26) for j in range(3))
             for k in range(1500)]
    pairs = SV.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    got = {(r["s"], r["t"]) for r in pairs.collect()}
    assert got == {(a, b) for a in words for b in words if a < b and _near(a, b)}


# Operator 13 ------------------------------------------------------------------------------
def _nodes_brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        yield p
        for q in children.get(p, []):
            yield from below(q)

    def saving(p):
        return (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if seqs[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    len(children.get(p, [])), sum(q not in children for q in below(p)),
                    sum(map(saving, below(p))), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _nodes(df, **options):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in cols) for r in CT.trie_nodes(df, **options).collect()),
                  key=str)


def _conversations(seed, n=90):
    r = random.Random(seed)
    turns = [("user", "hi"), ("user", "hi  there\nyou"), ("assistant", "ok"), (None, None),
             ("", ""), ("assistant", "a longer answer of six words"), ("user", "ΣÉ x")]
    rows = [(None, 0, "user", "lost"), (7, None, "user", "first of all"), (7, None, "user", "b")]
    for c in range(n):
        if c % 60 == 40:
            continue  # a family without its first conversation
        if c % 3 == 0:  # a third of all: copies
            rows += [(c, t, "user", "hi") for t in range(5)]
        else:
            rows += [(c, t, *r.choice(turns)) for t in range(r.randint(1, 7))]
    rows += rows[-3:] + [(1_000_000, t, *turns[t % 3]) for t in range(300)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns, fan", [(10 ** 6, 32), (40, 2), (15, 3)])
def test_trie_against_brute_force(spark, shard_turns, fan):
    rows = _conversations(shard_turns)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               CONV + ", seq string, n_convs int").repartition(5)
    assert _nodes(df, shard_turns=shard_turns, fan=fan) == _nodes_brute(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    """One own turn under a head that is missing leaves no turn at all."""
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(gone, 0, "user", "x")]
    assert _nodes(spark.createDataFrame(rows, CONV)) == _nodes_brute(rows)
    assert _nodes_brute(rows)[0][1:6] == (0, None, 1, 0, 1)
    assert _nodes(spark.createDataFrame([], CONV)) == []
    assert _nodes(spark.createDataFrame([(None, 1, "user", "x")], CONV)) == []


def test_ends_stream_over_blocks(spark):
    """Members of one node over many blocks of ids, in numeric order."""
    ids = [20 * k for k in range(3000)] + [10 ** 12 + 20]
    rows = [(c, 0, "user", "same") for c in ids]
    got = _nodes(spark.createDataFrame(rows, CONV), shard_turns=10)
    assert got == _nodes_brute(rows)


def test_median_insertion_keeps_sibling_trees_low():
    tree = CT.TernarySearchTree()
    for i in CT._median_order(1000):
        tree.insert([i])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.child[0]) == 10
