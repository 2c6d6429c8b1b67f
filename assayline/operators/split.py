"""Sampling and splitting: M1-M7, M10, U2, U4, J6, P16-P19, P23.

Membership follows the order of the rows' md5 of ``seed|key...``: the smallest
hashes are the test rows, the next ones validation, so a split is reproducible
on any cluster layout and its sizes are exact to a row. The hashes that bound
the parts are found by ``order_thresholds`` without a sort; the split itself is
then a comparison with literals. Rows of one key always stay together.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.scalar import hash_bucket
from assayline.tables import TARGETS

# Seed and shares of the published split schemes.
SEED = 42
ROW_KEYS = ("visit_id", "UniProt", "Peptide")
SCHEMES = {
    # name: (test share, validation share of the rest)
    "60_20_20": (0.2, 0.25),
    "80_20": (0.2, 0.0),
    "64_16_20": (0.2, 0.2),
}
TRAIN_SIZES = (0.1, 0.325, 0.55, 0.775, 1.0)   # five sizes from 10 % to 100 %
STAT_TOKENS = ("mean", "median", "min", "max", "std", "var")


def split_bucket(seed: int = SEED, keys: Sequence[str] = ROW_KEYS) -> F.Column:
    return hash_bucket(seed, *keys)


def row_hash(seed: int, keys: Sequence[str]) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


#: Hex digits by which a pass of order_thresholds refines its cells (65,536 each).
_DIGITS = 4


def order_thresholds(df: DataFrame, h: F.Column,
                     sizes: Callable[[int], Sequence[int]]) -> list[str]:
    """Texts t such that exactly k rows have ``h`` <= t, for every k of
    ``sizes`` (a function of the row count). ``h`` is an md5 in hex.

    Radix selection: a pass counts rows by their leading digits (combined
    before the shuffle); the cell that holds the k-th row is refined by the next
    digits until its end is the k-th row. A pass returns at most 65,536 counts
    for each k; two passes resolve about 10^9 rows. Equal hashes stay together,
    on the smaller side."""
    hashes = df.select(h.alias("h"))
    want, found = None, {}
    for width in range(_DIGITS, 33, _DIGITS):
        rows = hashes
        if want is not None:
            rows = rows.where(F.substring("h", 1, width - _DIGITS).isin(
                sorted({prefix for prefix, _ in want.values()})))
        cells = sorted((r["cell"], r["count"]) for r in
                       rows.groupBy(F.substring("h", 1, width).alias("cell")).count().collect())
        if want is None:
            ks = list(sizes(sum(n for _, n in cells)))
            want = {i: ("", k) for i, k in enumerate(ks)}
            found = {i: "" for i, (_, k) in want.items() if k <= 0}
            want = {i: w for i, w in want.items() if w[1] > 0}
        for i, (prefix, left) in list(want.items()):
            for cell, n in cells:
                if cell.startswith(prefix):
                    if left <= n:
                        break
                    left -= n
            want[i] = cell, left
            if left >= n or width == 32:  # the cell ends with the k-th row, or holds ties
                found[i] = cell + "g"     # after all hashes that begin like this
                del want[i]
        if not want:
            break
    return [found[i] for i in range(len(ks))]


def split_sizes(n: int, scheme: str) -> tuple[int, int]:
    """(test rows, validation rows) of n, rounded up as the reference's splitter does."""
    test, val = SCHEMES[scheme]
    n_test = math.ceil(test * n)
    return n_test, math.ceil(val * (n - n_test))


def assign_split(df: DataFrame, scheme: str = "60_20_20", seed: int = SEED,
                 keys: Sequence[str] = ROW_KEYS, by_patient: bool = False,
                 out: str = "split") -> DataFrame:
    """M4-M6: ``split`` in ('train', 'val', 'test'), sizes exact to a row.
    ``by_patient`` splits the patients instead, so one patient's rows never
    straddle the split."""
    keys = ["patient_id"] if by_patient else list(keys)
    units = df.select("patient_id").distinct() if by_patient else df.select(*keys)

    def sizes(n: int) -> list[int]:
        test, val = split_sizes(n, scheme)
        return [test, test + val]

    h = row_hash(seed, keys)
    test, val = order_thresholds(units, h, sizes)
    return df.withColumn(out, F.when(h <= F.lit(test), F.lit("test"))
                               .when(h <= F.lit(val), F.lit("val"))
                               .otherwise(F.lit("train")))


def assign_folds(df: DataFrame, k: int = 5, seed: int = SEED,
                 keys: Sequence[str] = ROW_KEYS, out: str = "fold") -> DataFrame:
    """M7: shuffled k folds (bucket mod k)."""
    return df.withColumn(out, F.pmod(split_bucket(seed, keys), F.lit(k)).cast("int"))


def _share_thresholds(df: DataFrame, fractions: Sequence[float], seed: int,
                      keys: Sequence[str]) -> list[str]:
    return order_thresholds(df.select(*keys), row_hash(seed, keys),
                            lambda n: [int(f * n) for f in fractions])


def train_size_subset(df: DataFrame, fraction: float, seed: int = SEED + 1,
                      keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """The ``fraction`` of the rows with the smallest hashes (rounded down;
    a second, independent hash), so subsets of larger fractions hold those of
    smaller ones."""
    t, = _share_thresholds(df, [fraction], seed, keys)
    return df.where(row_hash(seed, keys) <= F.lit(t))


def train_size_counts(df: DataFrame, fractions: Sequence[float], seed: int = SEED + 1,
                      keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """(size_index, fraction, n_rows) of all nested subsets, counted in
    one pass."""
    cuts = _share_thresholds(df, fractions, seed, keys)
    wide = df.select(row_hash(seed, keys).alias("_h")).agg(
        *[F.count_if(F.col("_h") <= F.lit(t)).alias(f"n{i}") for i, t in enumerate(cuts)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("size_index"), F.lit(float(f)).alias("fraction"),
                 F.col(f"n{i}").alias("n_rows")) for i, f in enumerate(fractions)])))


def union_train_val(df: DataFrame, col: str = "split") -> DataFrame:
    """U4: train and validation rows for the refit."""
    return df.where(F.col(col).isin("train", "val"))


# Sampling by key -------------------------------------------------------------------
def union_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys over all tables."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def sample_keys(frames: Sequence[DataFrame], key: str, n: int, seed: int = SEED) -> DataFrame:
    """M1/M2: n keys, the n smallest md5(seed|key) over the key union. A
    top-n (each task keeps n rows), so the result is bounded by n."""
    keys = union_keys(frames, key)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return keys.orderBy(order, key).limit(n)


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in ``keys`` (left semi join; Spark
    broadcasts the keys when their size allows)."""
    return df.join(keys, key, "left_semi")


def sample_tables(tables, key: str = "patient_id", n: int = 50, seed: int = SEED):
    """M1: each table reduced to one sampled key set."""
    ks = sample_keys([tables.proteins, tables.peptides, tables.clinical], key, n, seed)
    return tables.map(lambda d: semi_join(d, ks, key))


def sample_rows(df: DataFrame, n: int = 100, seed: int = SEED,
                keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """M3: n rows by hash order (a sampling operator: the limit is the feature)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(order, *keys).limit(n)


# Column selection --------------------------------------------------------------------
def project_target(df: DataFrame, target: str, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Keep one target, drop the other three."""
    return df.drop(*[t for t in targets if t != target])


def target_columns(columns: Sequence[str]) -> list[str]:
    """Columns starting with 'updrs'."""
    return [c for c in columns if c.startswith("updrs")]


def name_token(column: str, index: int = 2) -> str | None:
    """the index-th '_' token of a column name."""
    parts = column.split("_")
    return parts[index] if len(parts) > index else None


def statistic_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose third '_' token is a statistic name."""
    return [c for c in columns if name_token(c) in STAT_TOKENS]


def feature_columns(df: DataFrame, label: str,
                    exclude: Sequence[str] = ("split", "fold", "visit_id", "visit_month",
                                              "UniProt", "Peptide", "patient_id")) -> list[str]:
    return [c for c in df.columns if c != label and c not in exclude]


def split_xy(df: DataFrame, label: str, features: Sequence[str] | None = None,
             out: str = "features") -> DataFrame:
    """Features as one vector column beside the label."""
    from pyspark.ml.feature import VectorAssembler
    feats = list(features or feature_columns(df, label))
    va = VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep")
    return va.transform(df)
