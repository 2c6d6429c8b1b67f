r"""Operator 12: spelling variant grouping by asymmetric q-chunks.

Words are counted over all documents (partial counts before the shuffle); all
that follows works on the distinct words. Two words are near when one inserted,
deleted or replaced code point turns one into the other.

Of a pair, the shorter word s (of equal length: the smaller) contributes its
chunks, the other word t its grams:

- s is cut into two disjoint chunks, its halves. One edit lies in one half, so
  the other half stands in t at its own place or one further on.
- The damaged half is cut in two again in the same way, so the quarter of it
  that the edit leaves alone stands in t too, at its place or one further on.
  A chunk key of s is thus s without one of its four quarters, with the
  quarter's number and the length of s.
- t contributes the positional grams that can meet these: t without the window
  at the same place, as long as the quarter (t as long as s) or one longer (t
  longer by one). All other positional grams of t stand more than one place
  off and cannot join.
- Keys are 64-bit hashes, so rows stay small for long words; every pair that
  meets is verified by its edit distance, in the join, before it is emitted.

A pair found under two keys (a doubled letter) is counted once. Keys share at
least three quarters of a word, so their groups stay small in real vocabulary;
a key that many words share is split by Spark's skew join on either side.

The form of a word (its near word of largest n, if that n is at least ``FACTOR``
times its own) has ``FACTOR`` times its n, so chains of forms are at most
log10(largest n) long; their ends are found by pointer doubling in as many
joins as the binary logarithm of that bound.

Defined cases: null and empty texts hold no words; a null id counts as an empty
string before the colon; repeated rows count as often as they come; an empty
table gives an empty result; other columns are not read. Words of any length
are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import join_hot, lower_ascii, stored, table, text_or_empty

#: Fixed values of the task: least word length and count, deletion rule, factor of a form.
LENGTH, LEAST, EVERY, FACTOR = 7, 2, 31, 10
#: After A-Z are lowered, a run is a word of these letters.
LETTERS = r"a-zÀ-ÿ"


def _without(word: Column, lo: Column, hi: Column) -> Column:
    """``word`` without its code points lo (from 0) up to, not including, hi."""
    return F.concat(word.substr(F.lit(1), lo), word.substr(hi + 1, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of ``length`` code points and ``least``
    occurrences up, after the deletions that the ids' checksums ask for."""
    runs = F.regexp_extract_all(lower_ascii(text_or_empty(text)),
                                F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = (F.when(F.col("h") % EVERY == 0, _without(F.col("run"), at, at + 1))
             .otherwise(F.col("run")))
    return (rows.withColumn("h", h).select(word.alias("word"))
                .where(F.length("word") >= length)
                .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= least))


def _keys(words: DataFrame, more: int) -> DataFrame:
    """(size, piece, key, word, n) for the four quarters of a word's chunk side
    (``more`` 0) or of its gram side against words shorter by one (``more`` 1).
    ``size`` is the length of the shorter word of a pair."""
    w, size = F.col("word"), (F.length("word") - more)
    half = F.floor(size / 2).cast("int")
    cuts = [F.lit(0), F.floor(half / 2).cast("int"), half,
            half + F.floor((size - half) / 2).cast("int"), size]
    rows = F.array(*[F.struct(F.lit(k).cast("byte").alias("piece"),
                              F.xxhash64(_without(w, cuts[k], cuts[k + 1] + more)).alias("key"))
                     for k in range(4)])
    return (words.select("word", "n", size.alias("size"), F.explode(rows).alias("q"))
                 .select("size", "q.piece", "q.key", "word", "n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(s, sn, t, tn) for every pair of near words of (word, n), once."""
    chunks, same = _keys(words, 0), _keys(words, 0)
    longer = _keys(words, 1)

    def met(grams: DataFrame, ordered: bool) -> DataFrame:
        a, b = chunks.alias("a"), grams.alias("b")
        on = ((F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.size"))
              & (F.col("a.piece") == F.col("b.piece"))
              & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
        if ordered:
            on = on & (F.col("a.word") < F.col("b.word"))
        # Never broadcast: Spark sizes either side by the words' compressed
        # file, without the key rows that the explode makes of each word.
        return a.join(b.hint("merge"), on).select(F.col("a.word").alias("s"), F.col("a.n").alias("sn"),
                                    F.col("b.word").alias("t"), F.col("b.n").alias("tn"))

    # A replaced code point lies in one quarter; only other pairs can meet twice.
    return met(same, True).unionByName(met(longer, False).distinct())


def roots(forms: DataFrame, largest: int, factor: int = FACTOR) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms, by pointer
    doubling. ``largest`` is the largest n, which bounds the chains."""
    steps = max(1, math.ceil(math.log(max(largest, 2), factor)))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ends = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Many words share a form: its one row meets them in several places.
        # Its copies are not in Spark's estimate either.
        at = stored(join_hot(at, ends.hint("merge"), ["root"], "word", "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def variant_groups(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``words`` (word, n; distinct) plus n_near, form, form_n and root."""
    words = stored(words, "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("s").alias("word"), F.col("t").alias("near"),
                        F.col("tn").alias("m")).unionByName(
        pairs.select(F.col("t").alias("word"), F.col("s").alias("near"), F.col("sn").alias("m")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    largest = words.agg(F.max("n")).first()[0] or 0
    ok = -F.col("best.m") >= factor * F.col("n")
    own = stored(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(ok, F.col("best.near")).alias("form"),
        F.when(ok, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(own.where("form is not null"), largest, factor)
    return own.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_chunk_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variant_groups(word_counts(docs)).select("word", "form", "root", "n", "n_near",
                                                    "form_n")


#: Unsigned CRC-32 of a string expression in DuckDB, by the checksum's own rule.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
  range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))
  AS tab)"""


def crc_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    return (f"xor(4294967295, list_reduce(list_transform(range(0, len({hexed}), 2), lambda i: "
            f"('0x' || {hexed}[i + 1:i + 2])::BIGINT), lambda c, b: "
            f"xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))")


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-zÀ-ÿ]+')) AS run FROM documents),
q AS (SELECT id, run, count(*) AS m FROM r WHERE len(run) >= {LENGTH} GROUP BY ALL),
c AS (SELECT run, m, {crc_sql("id || ':' || run")} AS h FROM q, crc),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:]
             ELSE run END AS word, m FROM c),
v AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM w WHERE len(word) >= {LENGTH}
                   GROUP BY 1 HAVING sum(m) >= {LEAST}),
x AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS cut
                   FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
p AS MATERIALIZED (
  SELECT a.word AS s, a.n AS sn, b.word AS t, b.n AS tn
  FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON x.cut = v.word
  UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON x.cut = v.word),
o AS (SELECT s, count(*) AS n_near, max(tn) AS m FROM p GROUP BY s),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(o.n_near, 0) AS n_near,
         CASE WHEN o.m >= {FACTOR} * v.n THEN
           (SELECT min(t) FROM p WHERE p.s = v.word AND p.tn = o.m) END AS form,
         CASE WHEN o.m >= {FACTOR} * v.n THEN o.m END AS form_n
  FROM v LEFT JOIN o ON v.word = o.s),
z AS (SELECT word, form AS root, 1 AS d FROM f WHERE form IS NOT NULL
      UNION ALL SELECT z.word, f.form, d + 1 FROM z JOIN f ON z.root = f.word
      WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM f LEFT JOIN (SELECT word, arg_max(root, d) AS root FROM z GROUP BY word) e USING (word)
"""
