"""Operator 11: licence scan by a positional rare-token index (DataFrame functions only).

A library of licence notices (``TEMPLATES``) has a label, the notice's words
and its mandatory key phrases, each with its offset in the notice. The method:

1. One aggregate counts, over all documents, in how many each word of the key
   phrases occurs (combined before the shuffle; at most one row per library
   word reaches the driver). That gives the words' IDF.
2. The index holds, for the ``RARE`` highest-IDF key-phrase words of every
   notice, their postings (notice, position in the notice). It is a literal:
   the library is fixed, so is its size.
3. In each row the positions of index words are looked up; a hit at word i of a
   posting at position p votes for the start i - p of that notice. Postings are
   intersected by relative position: a (notice, start) stays only with the
   votes of all its postings, found by sorting the row's votes.
4. All mandatory key phrases must then stand at their offsets from that start.

Every key phrase holds only mandatory words, so no place is lost by step 3, and
IDF decides only how much work a row is. Steps 3 and 4 stay inside the row:
texts are never shuffled, no group is built, and memory follows the row's text.

Score of a place: the share of the notice's words that stand at their places
(1.0 for a whole notice); of a row: its best place, 0.0 without one.

Defined cases: a null text is empty (no words, no labels, score 0.0); null and
repeated ids are scanned row by row; an empty table gives an empty result; all
columns are carried, names that start with ``_ls_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import lower_ascii, table, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a notice whose postings are looked up.
RARE = 3

# Phrases and labels of the base scan.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"),
        ("cc-by-nc", "cc by nc"))
# Common licence notices (label, notice, mandatory key phrases).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this "
                 "file except in compliance with the license",
     ("licensed under the apache license version 2 0", "except in compliance with the license")),
    ("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license version 3",)),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free "
              "software foundation either version 3 of the license or at your option any later "
              "version",
     ("gnu general public license as published by", "either version 3 of the license")),
    ("gpl-3", "gnu gpl v3", ("gnu gpl v3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     ("gnu general public license version 2",)),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free "
              "software foundation either version 2 of the license or at your option any later "
              "version",
     ("gnu general public license as published by", "either version 2 of the license")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",
      "permitted provided that the following conditions are met")),
    ("bsd", "released under the bsd license", ("under the bsd license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("subject to the terms of the mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software",
      "with or without fee is hereby granted")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event "
             "will the authors be held liable for any damages",
     ("in no event will the authors be held liable",)),
    ("boost", "boost software license version 1 0", ("boost software license version 1 0",)),
    ("epl-2", "eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software released into the public domain",)),
    ("cc0", "cc0 1 0", ("cc0 1 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international "
                 "license", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international "
                 "license", ("creative commons attribution noncommercial",)),
)


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def library(base=BASE, notices=NOTICES) -> list[dict]:
    """Notices as {label, base, words, phrases: [(offset, words)]}, base first."""
    rows = [(label, text, (text,), True) for label, text in base]
    rows += [(label, text, keys, False) for label, text, keys in notices]
    out = []
    for label, text, keys, own in rows:
        words = text.split()
        phrases = sorted((_find(words, k.split()), k.split()) for k in keys)
        out.append({"label": label, "base": own, "words": words, "phrases": phrases})
    return out


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, notices: list[dict], text: str = "text") -> dict:
    """{word: documents that hold it} for every word of the key phrases; at
    most one row a library word reaches the driver."""
    vocabulary = sorted({w for t in notices for _, p in t["phrases"] for w in p})
    found = F.array_intersect(words_of(text), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()
    return {**dict.fromkeys(vocabulary, 0), **{r["w"]: r["count"] for r in rows}}


def rare_postings(notices: list[dict], df: dict, rare: int = RARE) -> list[list[tuple]]:
    """Per notice the postings (word, position) of its ``rare`` highest-IDF
    (least frequent) key-phrase words; ties in alphabetical order."""
    out = []
    for t in notices:
        at = [(w, off + j) for off, p in t["phrases"] for j, w in enumerate(p)]
        chosen = sorted({w for w, _ in at}, key=lambda w: (df[w], w))[:rare]
        out.append(sorted({(w, p) for w, p in at if w in chosen}))
    return out


def _strings(words) -> Column:
    return F.array(*map(F.lit, words))


def scan(docs: DataFrame, text: str = "text", notices: list[dict] | None = None,
         df: dict | None = None, rare: int = RARE) -> DataFrame:
    """``docs`` plus ``license_scan``: n_words, places (label, base, start,
    length, score; in order of notice and start). ``df``: document frequencies
    if known (see :func:`document_frequencies`)."""
    notices = library() if notices is None else notices
    df = document_frequencies(docs, notices, text) if df is None else df
    postings = rare_postings(notices, df, rare)
    by_word: dict = {}
    for t, own in enumerate(postings):
        for w, p in own:
            by_word.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    index = F.create_map(*[c for w, ps in sorted(by_word.items())
                           for c in (F.lit(w), F.array(*ps))])
    need = F.array(*[F.lit(len(own)) for own in postings])
    phrases = F.array(*[F.array(*[F.struct(F.lit(o).alias("o"), _strings(p).alias("w"))
                                  for o, p in t["phrases"]]) for t in notices])
    whole = F.array(*[_strings(t["words"]) for t in notices])
    labels = _strings([t["label"] for t in notices])
    base = F.array(*[F.lit(t["base"]) for t in notices])

    hits = F.filter(F.transform("_ls_words", lambda w, i: F.when(
        w.isin(sorted(by_word)), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    votes = F.array_sort(F.flatten(F.transform("_ls_hits", lambda h: F.transform(
        F.element_at(index, h["w"]),
        lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("s"))))))
    # Sorted votes: a start has all its notice's votes when the vote that far on is the same.
    agreed = F.filter("_ls_votes", lambda v, k: F.get(
        "_ls_votes", k + F.get(need, v["t"]) - 1).eqNullSafe(v))

    def stands(c: Column) -> Column:
        def one(p: Column) -> Column:
            at = c["s"] + p["o"]
            return (at >= 0) & (F.slice("_ls_words", F.greatest(at + 1, F.lit(1)),
                                        F.size(p["w"])) == p["w"])
        return F.forall(F.get(phrases, c["t"]), one)

    def place(c: Column) -> Column:
        words = F.get(whole, c["t"])
        same = F.filter(words, lambda w, j: F.get("_ls_words", c["s"] + j).eqNullSafe(w))
        return F.struct(F.get(labels, c["t"]).alias("label"), F.get(base, c["t"]).alias("base"),
                        c["s"].cast("long").alias("start"),
                        F.size(words).alias("length"),
                        (F.size(same) / F.size(words)).alias("score"))

    return (docs.withColumn("_ls_words", words_of(text)).withColumn("_ls_hits", hits)
                .withColumn("_ls_votes", votes)
                .withColumn("_ls_places", F.transform(F.filter(agreed, stands), place))
                .withColumn("license_scan", F.struct(
                    F.size("_ls_words").cast("long").alias("n_words"),
                    F.col("_ls_places").alias("places")))
                .select(*[F.col(f"`{c}`") for c in docs.columns], "license_scan"))


def op11_rare_token_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = F.col("license_scan.places")
    own = F.filter(places, lambda p: p["base"])
    starts = F.transform(own, lambda p: p["start"])

    def names(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(
            F.transform(c, lambda p: p["label"]))), ",")

    return scan(docs).select(
        "doc_id", F.col("license_scan.n_words").alias("n_words"),
        F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(own).alias("base_labels"),
        names(places).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0))
        .alias("score"))


def _sql() -> str:
    def words(ws):
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    found, starts = [], set()
    for t in library():
        (off, first), rest = t["phrases"][0], t["phrases"][1:]
        n = len(t["words"])
        starts.add(first[0])
        more = "".join(f" AND w[s + {o + 1}:s + {o + len(p)}] = {words(p)}" for o, p in rest)
        share = (f"list_sum(list_transform(range({n}), lambda j: CASE WHEN s + j >= 0 AND "
                 f"w[s + j + 1] = {words(t['words'])}[j + 1] THEN 1 ELSE 0 END))::DOUBLE / {n}")
        found.append(
            f"SELECT r, '{t['label']}' AS label, {str(t['base']).lower()} AS base, s, "
            f"{share} AS score FROM (SELECT r, i - {off} AS s, w FROM h WHERE x = '{first[0]}' "
            f"AND w[i + 1:i + {len(first)}] = {words(first)}) AS q WHERE true{more}")
    places = "\nUNION ALL ".join(found)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
u AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM d),
h AS MATERIALIZED (SELECT r, i, x, w FROM u JOIN d USING (r)
                   WHERE x IN ({', '.join(f"'{x}'" for x in sorted(starts))})),
p AS ({places}),
g AS (SELECT r, count_if(base) AS n_base, min(s) FILTER (base) AS first_word,
             max(s) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM p GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
