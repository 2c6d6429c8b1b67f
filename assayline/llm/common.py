"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.session import ensure_checkpoint_dir

#: Bytes that count as white space in the contracts of this package.
SPACES = r"[\x20\x09-\x0D]+"
#: Places in which the rows of a hot key meet.
SALTS = 8
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read
    back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bitmaps(positions: DataFrame, at_least: int = 1) -> DataFrame:
    """(block, bits): bitmaps of 32,768 bits over column ``p`` (0 and up) of
    ``positions``, with a bit set where a position occurs ``at_least`` times.
    Counts are combined before the shuffle."""
    hit = (positions.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") >= at_least))
    return (hit.groupBy(F.shiftright("p", 15).alias("block"))
               .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits")))


def bit_is_set(bits: Column, offset: Column) -> Column:
    """Bit ``offset`` (0..32767) of a bitmap made by :func:`bitmaps`; a null
    bitmap has no bit set."""
    byte = F.ascii(F.decode(F.substring(bits, (F.shiftright(offset, 3) + 1).cast("int"), F.lit(1)),
                            "ISO-8859-1"))
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]),
                        (offset.bitwiseAND(7) + 1).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))


def power_of_two(n: int, low: int, high: int) -> int:
    """Smallest power of two from ``n`` up, held between two powers."""
    return max(low, min(high, 1 << max(0, int(n) - 1).bit_length()))


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], spread: str,
             how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``one``, which has one row a key: a hot key's rows
    (dealt by column ``spread``) meet copies of that row in ``salts`` places."""
    copies = F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))
    return (rows.withColumn("_jh_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
                .join(one.withColumn("_jh_salt", copies), [*keys, "_jh_salt"], how)
                .drop("_jh_salt"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = (both.groupBy("u").agg(F.min("v").alias("m"))
                 .select("u", F.least("u", "m").alias("m")))
    return (join_hot(both, least, ["u"], "v").where(F.col("v") > F.col("u"))
                .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges come as (u, v) with v < u."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    kept = join_hot(e, least, ["u"], "v")
    moved = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over undirected links, for
    every node that has a link to another one.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each
    round is stored in the shared folder, minima are combined before the
    shuffle, and only a count and a checksum reach the driver. The rounds
    grow with the logarithm of the graph's diameter; ``max_rounds`` only
    guards against an endless loop and raises when reached.
    """
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u <> v").distinct())
    e = stored(e, "links")
    mark = None
    for _ in range(max_rounds):
        nxt = stored(_small_star(_large_star(e)), "stars")
        new = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        e = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def extended(df: DataFrame, **types: str) -> T.StructType:
    """Schema of ``df`` with columns added (name="type")."""
    more = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in types.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def without_ids(df: DataFrame, drop: DataFrame, id_col: str, max_bits: int = 1 << 26) -> DataFrame:
    """``df`` without the rows whose id is in ``drop``. A bitmap filter of
    bounded size (broadcast) lets rows whose id is surely not there pass
    unshuffled; the others are joined exactly."""
    drop = stored(drop.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_wo_id")),
                  "dropped")
    bits = power_of_two(16 * drop.count(), 1 << 15, max_bits)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    filt = F.broadcast(stored(bitmaps(drop.select(place("_wo_id").alias("p"))), "filter")
                       .select(F.col("block").alias("_wo_block"), F.col("bits").alias("_wo_bits")))
    marked = (df.withColumn("_wo_p", place(F.col(id_col)))
                .withColumn("_wo_block", F.shiftright("_wo_p", 15))
                .join(filt, "_wo_block", "left")
                .withColumn("_wo_maybe", bit_is_set(F.col("_wo_bits"),
                                                    F.col("_wo_p").bitwiseAND(32767))))
    passed = marked.where(~F.col("_wo_maybe")).select(*df.columns)
    tested = marked.where("_wo_maybe").select(*df.columns)
    return passed.union(tested.join(drop, tested[id_col] == drop["_wo_id"], "left_anti"))
