"""Operator 7: exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass 1 hashes every normalised text and counts, per Bloom position, how many
texts touch it; positions touched twice form a bitmap filter. Pass 2 tests
each row against the filter: a row whose positions are not all touched twice
has no equal and passes straight through; only the others are shuffled and
grouped exactly by SHA-256. The filter never decides equality, so a false
positive costs a shuffle of one row and nothing else.

The filter is blocked (all positions of a text lie in one block of 32,768
bits), so a probe is one broadcast lookup. It has ``bits_per_row`` bits a row,
at most ``max_bits`` (2**27 bits are 16 MB: the proven bound of what is
broadcast). Beyond that bound more rows take the exact way.

Defined cases: null text counts as empty; the query and ``kept_rows`` tell rows
apart by their id, so rows that share the smallest id of a group all stay
there, while ``single_rows`` (the pipeline's stage) keeps one row of each text;
null ids lose against any other id and equal each other; an empty table gives an empty result;
other columns are carried untouched (their names must not start with ``_bd_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import (SPACES, bit_is_set, bitmaps, power_of_two, stored, table,
                                  text_or_empty)

BLOCK_BITS = 32768
SALTS = 8


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus _bd_sha: SHA-256 (binary) of the normalised text."""
    norm = F.regexp_replace(text_or_empty(text), SPACES, " ")
    return df.withColumn("_bd_sha", F.unhex(F.sha2(norm, 256)))


def _probes(blocks: int):
    h = F.xxhash64("_bd_sha")
    block = F.pmod(F.shiftright(h, 30), F.lit(blocks))
    return block, [h.bitwiseAND(BLOCK_BITS - 1),
                   F.shiftright(h, 15).bitwiseAND(BLOCK_BITS - 1)]


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(block, bits) of positions that at least two rows touch."""
    block, offsets = _probes(bits // BLOCK_BITS)
    own = F.array_distinct(F.array(*[block * BLOCK_BITS + o for o in offsets]))
    return bitmaps(digests.select(F.explode(own).alias("p")), at_least=2)


def _prober(digests: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 27):
    """Pass 1 over ``digests``; the function returned adds _bd_maybe (may have
    an equal row) to rows that have _bd_sha."""
    bits = power_of_two(bits_per_row * digests.count(), BLOCK_BITS, max_bits)
    filt = stored(repeated_filter(digests, bits), "bloom")
    block, offsets = _probes(bits // BLOCK_BITS)
    maybe = bit_is_set(F.col("_bd_bits"), offsets[0]) & bit_is_set(F.col("_bd_bits"), offsets[1])

    def probed(rows: DataFrame) -> DataFrame:
        f = F.broadcast(filt.select(F.col("block").alias("_bd_block"),
                                    F.col("bits").alias("_bd_bits")))
        return (rows.withColumn("_bd_block", block).join(f, "_bd_block", "left")
                    .withColumn("_bd_maybe", maybe).drop("_bd_block", "_bd_bits"))

    return probed


def exact_dedup(df: DataFrame, id_col: str = "doc_id", bits_per_row: int = 16,
                max_bits: int = 1 << 27, digests: DataFrame | None = None) -> DataFrame:
    """``df`` (which has _bd_sha) plus _bd_keep (id that stays) and _bd_size.

    ``digests``: a table with the same rows' _bd_sha that is cheaper to scan
    for pass 1."""
    first = df if digests is None else digests
    probed = _prober(first, bits_per_row, max_bits)

    def out(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], "_bd_keep", "_bd_size")

    same = {f.name: f.dataType for f in first.schema}
    source = first if same.get(id_col) == df.schema[id_col].dataType else df
    groups = (probed(source).where("_bd_maybe").groupBy("_bd_sha")
              .agg(F.min(id_col).alias("_bd_keep"), F.count(F.lit(1)).alias("_bd_size"))
              # A hot group meets its one group row in SALTS places.
              .withColumn("_bd_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))))
    rows = probed(df)
    alone = (rows.where(~F.col("_bd_maybe")).withColumn("_bd_keep", F.col(id_col))
                 .withColumn("_bd_size", F.lit(1).cast("long")))
    shared = (rows.where("_bd_maybe")
                  .withColumn("_bd_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
                  .join(groups, ["_bd_sha", "_bd_salt"]))
    return out(alone).unionByName(out(shared))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id stays, with their columns unchanged; a
    smallest id that comes twice stays twice (see :func:`single_rows`)."""
    own = with_digest(docs, text)
    digests = stored(own.select(id_col, "_bd_sha"), "digests")
    return (exact_dedup(own, id_col, digests=digests)
            .where(F.col(id_col).eqNullSafe(F.col("_bd_keep"))).select(*docs.columns))


def single_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each normalised text, unchanged: the smallest id, a
    null id after any other, ties by a stored row number."""
    own = stored(with_digest(docs, text).withColumn("_bd_row", F.monotonically_increasing_id()),
                 "digests")
    probed = _prober(own.select("_bd_sha"))
    stays = (probed(own.select(id_col, "_bd_sha", "_bd_row")).where("_bd_maybe")
             .groupBy("_bd_sha")
             .agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_bd_row")).alias("_bd_least"))
             .select("_bd_least._bd_row"))
    rows = probed(own)
    # Row numbers are unique, so no group meets in one place here.
    return (rows.where(~F.col("_bd_maybe")).select(*docs.columns).unionByName(
        rows.where("_bd_maybe").join(stays, "_bd_row", "left_semi").select(*docs.columns)))


def op7_bloom_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = stored(with_digest(docs).select("doc_id", "_bd_sha"), "digests")
    return exact_dedup(digests).select(
        "doc_id", F.col("_bd_keep").alias("keep_id"), F.col("_bd_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_bd_keep")).alias("kept"),
        F.lower(F.hex("_bd_sha")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
         AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
