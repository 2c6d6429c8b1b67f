"""Protein and GO annotation sources (S12, S13), re-aimed from HTTP services
to snapshot tables. On the driver's tables the snapshots are derived from
``part`` (no service is called):

* protein records per UniProt (= p_brand), JSON like the service's record, one
  per segment of the sequence. The sequence is all of the brand's distinct part
  names in residue form (upper case, no spaces), in order, joined. Each name's
  start is a distributed prefix sum of lengths, and the sequence is cut every
  ``SEGMENT`` residues, so no cell and no task holds a whole sequence.
  ``sequence.value`` is the segment, ``sequence.segment`` its number,
  ``sequence.start`` its offset, ``sequence.length`` the whole length;
  ``proteinDescription.recommendedName.fullName.value`` is the brand's
  smallest part type. A brand without residues has one record of an empty one.
* GO annotations: one (UniProt, GO id) row per part, GO id from the part
  size (ids repeat); a GO name per size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.ranks import running_offsets
from assayline.operators.sequences import cut_segments
from assayline.sources.adapter import _read

SEGMENT = 256


def residues(name) -> Column:
    """Sequence form of a part (peptide) name: upper case, no spaces."""
    c = F.col(name) if isinstance(name, str) else name
    return F.upper(F.regexp_replace(c, " ", ""))


def go_id(size) -> Column:
    return F.concat(F.lit("GO:"), F.lpad(F.col(size).cast("string"), 7, "0"))


def record_json(segment: str = "segment", start: str = "start", length: str = "length",
                value: str = "residues", name: str = "name", uniprot: str = "uniprot") -> Column:
    """A record in the service's form."""
    return F.to_json(F.struct(
        F.col(uniprot).alias("primaryAccession"),
        F.struct(F.col(segment).alias("segment"), F.col(start).alias("start"),
                 F.col(length).alias("length"), F.col(value).alias("value")).alias("sequence"),
        F.struct(F.struct(F.struct(F.col(name).alias("value")).alias("fullName"))
                 .alias("recommendedName")).alias("proteinDescription")))


def protein_records(spark: SparkSession, sf_dir: str, segment: int = SEGMENT) -> DataFrame:
    """(uniprot, segment, json), one row per protein and segment."""
    pt = _read(spark, sf_dir, "part")
    own = pt.groupBy(F.col("p_brand").alias("uniprot")).agg(F.min("p_type").alias("name"))
    names = (pt.select(F.col("p_brand").alias("uniprot"), residues("p_name").alias("residues"))
               .where(F.length("residues") > 0).distinct())
    pieces = running_offsets(names.withColumn("size", F.length("residues").cast("long")),
                             "size", by=["uniprot"], order=["residues"], out="start")
    total = names.groupBy("uniprot").agg(F.sum(F.length("residues")).alias("length"))
    cut = cut_segments(pieces, segment, "uniprot")
    # A protein without residues keeps its one, empty record.
    rec = (own.join(total, "uniprot", "left").join(cut, "uniprot", "left")
              .select("uniprot", F.coalesce("segment", F.lit(0).cast("long")).alias("segment"),
                      F.coalesce("start", F.lit(0).cast("long")).alias("start"),
                      F.coalesce("length", F.lit(0).cast("long")).alias("length"),
                      F.coalesce("residues", F.lit("")).alias("residues"), "name"))
    return rec.select("uniprot", "segment", record_json().alias("json"))


def go_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uniprot, go_id), one row per part (ids repeat)."""
    pt = _read(spark, sf_dir, "part")
    return pt.select(F.col("p_brand").alias("uniprot"), go_id("p_size").alias("go_id"))


def go_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(go_id, name) of every size."""
    pt = _read(spark, sf_dir, "part")
    return pt.select(go_id("p_size").alias("go_id"),
                     F.concat(F.lit("size term "), F.col("p_size").cast("string")).alias("name")
                     ).distinct()
