"""Operator 1: contiguous byte-balanced shards from global prefix sums.

Rows are put in one global order (id, then text checksum and size) by range
partitioning their small metadata; each partition reports its byte and row
totals (one row a partition reaches the driver), exclusive prefix sums of the
totals place every partition, and a running sum inside the partition places
every row. A row goes to the shard in whose equal share of all bytes its
middle byte lies, so a shard misses its target by less than one row at each
end. Law: ``bytes``.

Defined cases: null text has no bytes; null ids come first; rows that agree
in id, checksum and size are interchangeable and are told apart by their place
in the input, which also lets a hot id spread over partitions; an empty table gives an empty result; more shards
than rows leave shards empty; other columns are ignored by the digest query
and carried by :func:`assign`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import extended, partitions, stored, table, text_or_empty

OVERHEAD = 16


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32): bytes of the text plus a fixed overhead a row."""
    t = text_or_empty(text)
    return docs.select(id_col, (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"))


def assign(meta: DataFrame, order_by: list[str], size: str, n_shards: int) -> DataFrame:
    """``meta`` plus shard (int) and slot (long, gapless from 0 in a shard)."""
    spark = meta.sparkSession
    cols = list(meta.columns)
    base = stored(meta.withColumn("_sh_tie", F.monotonically_increasing_id()), "sizes")
    dealt = (base.repartitionByRange(partitions(spark), *order_by, "_sh_tie")
                 .withColumn("_sh_part", F.spark_partition_id()))
    # Stored with its partition number, so that totals and rows agree for good.
    dealt = stored(dealt, "dealt")
    totals = {r["_sh_part"]: r["b"] for r in
              dealt.groupBy("_sh_part").agg(F.sum(size).alias("b")).collect()}
    parts = sorted(totals)
    starts = dict(zip(parts, accumulate([totals[p] for p in parts], initial=0)))
    total = sum(totals.values())

    schema = extended(dealt, shard="int")
    placed_in = [*order_by, "_sh_tie"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("_sh_part").to_numpy()
            s = b.column(size).to_numpy().astype(np.int64)
            shard = np.empty(len(s), np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for lo, hi in zip(cuts, cuts[1:]):
                if int(p[lo]) != part:
                    part, run = int(p[lo]), starts[int(p[lo])]
                ends = run + np.cumsum(s[lo:hi])
                run = int(ends[-1])
                middle = ends - s[lo:hi] + s[lo:hi] // 2
                # Exact whatever the total: equal targets cut at k * total / n.
                edges = np.array([-(-k * total // n_shards) for k in range(1, n_shards)], np.int64)
                shard[lo:hi] = np.searchsorted(edges, middle, side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)],
                                             names=[*b.schema.names, "shard"])

    rows = (dealt.repartition(partitions(spark), "_sh_part")
                 .sortWithinPartitions("_sh_part", *placed_in))
    cut = stored(rows.mapInArrow(place, schema), "cut")
    # At most one row a partition and one more a shard.
    counts = sorted((r["_sh_part"], r["shard"], r["n"]) for r in
                    cut.groupBy("_sh_part", "shard").agg(F.count(F.lit(1)).alias("n")).collect())
    before, first = {}, {}
    for p, k, n in counts:
        first[p, k] = before.get(k, 0)
        before[k] = first[p, k] + n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            p, k = b.column("_sh_part").to_numpy(), b.column("shard").to_numpy()
            slot = np.empty(len(p), np.int64)
            change = np.flatnonzero((np.diff(p) != 0) | (np.diff(k) != 0)) + 1
            cuts = [0, *change.tolist(), len(p)] if len(p) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if (int(p[lo]), int(k[lo])) != key:
                    key = int(p[lo]), int(k[lo])
                    at = first[key]
                slot[lo:hi] = np.arange(at, at + hi - lo)
                at += hi - lo
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot)],
                                             names=[*b.schema.names, "slot"])

    schema = extended(cut, slot="long")
    ordered = (cut.repartition(partitions(spark), "_sh_part")
                  .sortWithinPartitions("_sh_part", "shard", *placed_in))
    return ordered.mapInArrow(number, schema).select(*cols, "shard", "slot")


def op1_prefix_sum_shards(spark, sf_dir: str) -> DataFrame:
    meta = sizes(table(spark, sf_dir, "documents"))
    out = assign(meta, ["doc_id", "text_crc32", "size"], "size", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))
