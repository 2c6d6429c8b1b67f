"""Protein sequences as segments, and peptides located in them: J7, F7.

A sequence is a table of segments (UniProt, segment, start, residues); no cell
holds a whole one. Peptides are located by a seed join:

1. A peptide's seed is its first q residues, q being the largest power of two
   that it holds, so a seed covers more than half of its peptide.
2. Each segment is lengthened by the residues that follow it, up to the longest
   peptide less one, so every window lies whole in the segment it starts in.
3. For each q in use (at most one a binary digit of the longest peptide) the
   windows of every segment meet the seeds by (UniProt, q, hash of q residues);
   the join verifies the whole peptide and only hits leave it.
4. The first position is the least hit, combined before the shuffle.

Rows grow with the residues and the peptides; a protein that holds a third of
all residues is dealt over its windows' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.session import store


def _joined(parts: str) -> Column:
    """The ``text`` fields of collected (``at``, ``text``) structs, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["text"]), "")


def cut_segments(pieces: DataFrame, size: int, by: str) -> DataFrame:
    """(by, segment, start, residues) from consecutive (by, start, residues)
    pieces: the sequence cut every ``size`` residues. A group is one segment."""
    end = F.col("start") + F.length("residues")
    lo, hi = F.greatest(F.col("k") * size, "start"), F.least((F.col("k") + 1) * size, end)
    part = F.substring("residues", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    first = F.floor(F.col("start") / size)
    last = F.floor((end - 1) / size)
    return (pieces.withColumn("k", F.explode(F.sequence(first, last)))
            .select(by, F.col("k").alias("segment"),
                    F.struct(lo.alias("at"), part.alias("text")).alias("part"))
            .groupBy(by, "segment").agg(_joined("part").alias("residues"))
            .select(by, "segment", (F.col("segment") * size).alias("start"), "residues"))


def lengthened(segments: DataFrame, by: str, more: int) -> DataFrame:
    """``segments`` (by, segment, start, residues), each followed by up to
    ``more`` residues of its successors."""
    # All segments but a sequence's last are of one size.
    inner = segments.select(by, (F.col("segment") - 1).alias("segment"))
    size = (segments.join(inner, [by, "segment"], "left_semi")
                    .agg(F.min(F.length("residues"))).first()[0])
    if not size or more <= 0:
        return segments
    reach = -(-more // size)
    steps = F.sequence(F.lit(0), F.least(F.lit(reach), F.col("segment").cast("int")))
    back = (segments.withColumn("i", F.explode(steps))
            .withColumn("text", F.when(F.col("i") == 0, F.col("residues")).otherwise(
                F.expr(f"substring(residues, 1, {int(more)} - int((i - 1) * {int(size)}))")))
            .select(by, (F.col("segment") - F.col("i")).alias("segment"),
                    F.struct(F.col("i").alias("at"), "text").alias("part")))
    return (back.groupBy(by, "segment").agg(_joined("part").alias("residues"))
                .select(by, "segment", (F.col("segment") * int(size)).alias("start"), "residues"))


def seed_length(c: Column) -> Column:
    """Largest power of two up to the length of ``c``, by its binary digits."""
    return F.pow(F.lit(2.0), F.length(F.bin(F.length(c))) - 1).cast("int")


def first_positions(peptides: DataFrame, segments: DataFrame, by: str, peptide: str) -> DataFrame:
    """(by, peptide, position) of every distinct peptide that stands in its
    protein, position being its first place from 0. Empty peptides are left out."""
    pep = store(peptides.where(F.length(peptide) > 0).select(by, peptide).distinct()
                .withColumn("q", seed_length(F.col(peptide))), "seeds")
    longest = pep.agg(F.max(F.length(peptide))).first()[0]
    if longest is None:
        return pep.select(by, peptide, F.lit(None).cast("long").alias("position"))
    sizes = [r["q"] for r in pep.select("q").distinct().collect()]  # at most 31
    seeds = pep.withColumn("seed", F.xxhash64(F.expr(f"substring(`{peptide}`, 1, q)")))
    own = segments.select(by, "segment", F.length("residues").alias("own"))
    text = lengthened(segments, by, longest - 1).join(own, [by, "segment"])
    windows = (text.withColumn("q", F.explode(F.array(*[F.lit(q) for q in sorted(sizes)])))
               .where(F.length("residues") >= F.col("q"))
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.least(
                   F.col("own") - 1, F.length("residues") - F.col("q")))))
               .select(by, "q", F.expr("xxhash64(substring(residues, i + 1, q))").alias("seed"),
                       (F.col("start") + F.col("i")).alias("position"),
                       # No peptide of this seed length is longer than the window.
                       F.expr("substring(residues, i + 1, 2 * q - 1)").alias("window")))
    hit = seeds.join(windows, [by, "q", "seed"]).where(F.col("window").startswith(F.col(peptide)))
    return hit.groupBy(by, peptide).agg(F.min("position").alias("position"))
